"""Joins on likeness against plain loops, and how many pairs they look at."""

import difflib
import functools
import hashlib
import math
import random

import pytest

from weftline.operators import match, matcher, neighbours


def _plain(label, keys, ratio=0.85):
    key = label.strip(" ").lower()
    if key in keys:
        return keys[key], "exact"
    inside = [(-len(k), k) for k in keys if (k in key or key in k) and min(len(k), len(key)) >= 5 and min(len(k), len(key)) / max(len(k), len(key)) >= 0.5]
    if inside:
        return keys[min(inside)[1]], "contained"
    alike = [(-r, k) for k in keys if (r := difflib.SequenceMatcher(None, key, k).ratio()) >= ratio]
    return (keys[min(alike)[1]], "alike") if alike else (None, "miss")


def _edited(rng, word, letters):
    out = list(word)
    for _ in range(rng.randint(0, 1 + len(word) // 6)):
        at, what = rng.randrange(len(out) + 1), rng.randrange(3)
        if what == 0:
            out.insert(at, rng.choice(letters))
        elif at < len(out) and len(out) > 1:
            out[at : at + 1] = [rng.choice(letters)] if what == 1 else []
    return "".join(out)


@pytest.mark.parametrize("letters, least, most", [("ab", 1, 14), ("abcé", 3, 40), ("0123456789abcdef", 28, 36), ("abcdef", 50, 90)])
def test_labels_resolve_as_in_plain_loops(spark, letters, least, most):
    rng = random.Random(f"{letters}{most}")
    words = ["".join(rng.choices(letters, k=rng.randint(least, most))) for _ in range(60)]
    asked = [_edited(rng, w, letters) for w in words * 3]
    asked += [w[i : i + max(1, len(w) * 2 // 3)] for i, w in enumerate(words[:20])] + [rng.choice(letters) * (i % 9) + w for i, w in enumerate(words[20:40])]
    entries = spark.createDataFrame([(w, f"i{n}", n) for n, w in enumerate(words)], "label string, id string, priority long")
    keys = {r.key: r.id for r in match.label_index(entries).collect()}
    found = match.resolve_labels(spark.createDataFrame([(x,) for x in sorted(set(asked))], "label string"), match.label_index(entries)).collect()
    assert {r.label: (r.id, r.strategy) for r in found} == {x: _plain(x, keys) for x in set(asked)}
    assert len({r.strategy for r in found}) > 2


@pytest.mark.parametrize("query", ["ded10_applied", "ded10_verdicts", "joi05_strategies", "lif15_preview", "prj33_temporary", "prj36_committed"])
def test_digests_as_labels_are_not_compared_with_all(spark, sf, query, monkeypatch):
    """The labels of the drafts' queries are digests: of all pairs none but alike ones come to a comparison of blocks."""
    seen, real = [], match._near_keys
    monkeypatch.setattr(match, "_near_keys", lambda *a: seen.append(real(*a)) or seen[-1])
    from weftline.plans import catalog

    catalog.queries()[query](spark, sf).count()
    assert seen and sum(df.count() for df in seen) < 20


def test_only_alike_digests_are_paired(spark):
    digest = [hashlib.md5(str(i).encode()).hexdigest() for i in range(900)]
    index = spark.createDataFrame([(d,) for d in digest[:600]], "key string")
    near = digest[5][:9] + "x" + digest[5][10:20] + digest[5][21:]
    asked = spark.createDataFrame([(d,) for d in [*digest[600:], near, digest[7][3:]]], "key string")
    assert {(r.k0, r.k1) for r in match._near_keys(asked, index, 0.85).collect()} == {(near, digest[5]), (digest[7][3:], digest[7])}


def _cosine(a, b):
    dot = lambda x, y: functools.reduce(lambda s, pq: s + pq[0] * pq[1], zip(x, y, strict=True), 0.0)  # noqa: E731  sum() corrects its errors
    n = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return dot(a, b) / n if n else 0.0


@pytest.mark.parametrize("k, least, strict, others, bounded", [(3, 0.2, False, True, False), (1, 0.3, True, False, False), (1, -0.5, False, True, True), (4, -2.0, False, True, True)])
def test_nearest_in_blocks_as_in_plain_loops(spark, monkeypatch, k, least, strict, others, bounded):
    """Across tiles and strips, with copies that tie, a vector of no length, missing ones and ones of another size."""
    monkeypatch.setattr(neighbours, "TILE", 20)
    monkeypatch.setattr(neighbours, "STRIP", 7)
    rng = random.Random(k)
    vectors = [[float(rng.randint(-2, 2)) / 3 for _ in range(5)] for _ in range(12)] + [[0.0] * 5, [1.0, 2.0], None, [1.0, None, 1.0, 1.0, 1.0]]
    rows = [(i, None if i % 31 == 0 else i % 3, (i * 7) % 50, vectors[rng.randrange(len(vectors))]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, block int, at int, v array<double>")
    queries, corpus = (df.selectExpr("id", "block", "at + 5 AS at", "v"), df) if bounded else (df.drop("at"), df.drop("at"))
    want = set()
    whole = lambda r: r[1] is not None and r[3] is not None and None not in r[3]
    for q in filter(whole, rows):
        near = [(-_cosine(q[3], c[3]), c[0]) for c in filter(whole, rows) if c[1] == q[1] and len(c[3]) == len(q[3]) and not (others and c[0] == q[0]) and not (bounded and c[2] < q[2] + 5)]
        near = sorted((s, i) for s, i in near if (-s > least if strict else -s >= least))[:k]
        want |= {(q[0], i, -s, n + 1) for n, (s, i) in enumerate(near)}
    got = neighbours.nearest_in_blocks(queries, corpus, k, least, strict, others)
    assert {tuple(r) for r in got.select("query_id", "id", "similarity", "rank").collect()} == want and want


@pytest.mark.parametrize("query", ["ded05_already_held", "joi14_supersession", "top08_affinity"])
def test_vectors_meet_in_tiles_not_row_by_row(spark, sf, query):
    from weftline.plans import catalog

    plan = catalog.queries()[query](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "zip_with" not in plan


@pytest.mark.parametrize("least", [None, 0.3])
def test_best_similarities_as_in_plain_loops(spark, monkeypatch, least):
    """Across tiles and strips, with equal phrases that tie; zero and missing vectors have none."""
    monkeypatch.setattr(neighbours, "STRIP", 1)
    rng = random.Random(5)
    vectors = [[float(rng.randint(-2, 2)) / 3 for _ in range(5)] for _ in range(15)] + [[0.0] * 5, None]
    probes = [(i, rng.choice(vectors)) for i in range(40)]
    phrases = [(i % 9, f"p{i * 7 % 50}", rng.choice(vectors)) for i in range(50)]
    want = {}
    for t, v in probes:
        for h, p, w in phrases:
            if v and w and any(v) and any(w) and (least is None or _cosine(v, w) >= least):
                want[t, h] = max(want.get((t, h), (-2.0, "")), (_cosine(v, w), p))
    got = matcher.best_similarities(spark.createDataFrame(probes, "text_id long, v array<double>"), spark.createDataFrame(phrases, "id long, phrase string, v array<double>"), block=16, least=least)
    assert {(r.text_id, r.id): (r.similarity, r.phrase) for r in got.collect()} == want


def test_the_matcher_does_not_multiply_row_by_row(spark):
    probes = spark.createDataFrame([(1, [1.0, 2.0])], "text_id long, v array<double>")
    phrases = spark.createDataFrame([(1, "a", [1.0, 2.0])], "id long, phrase string, v array<double>")
    plan = matcher.best_similarities(probes, phrases)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "zip_with" not in plan
