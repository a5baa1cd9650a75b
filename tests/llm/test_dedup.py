"""SimHash, fingerprints, chunks and lines against brute force."""

import hashlib
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import chunks, fingerprints, lines, simhash
from weftline.operators.components import connected_components
from weftline.session import Scratch


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_simhash(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs):
    fps = {i: f for i, f in pairs}
    ids = [i for i, _ in pairs]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if bin(fps[a] ^ fps[b]).count("1") <= 3]
    return components(ids, links)


def test_simhash_matches_brute_force(docs, rows):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    want = [(i, brute_simhash(t)) for i, t in rows]
    comp = brute_components(want)
    assert len(got) == len(rows)
    for i, f in want:
        assert got[i].fingerprint == f"{f:016x}"
        assert got[i].component_id == comp[i]


@pytest.mark.parametrize("limit", [1, 3, 8192])
def test_hot_segments_lose_no_link(spark, limit):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 6)
    fps = set()
    for b in base.tolist():
        fps.add(b)
        for _ in range(12):
            x = b
            for k in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << k
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    scratch = Scratch(spark)
    links = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), scratch, bucket_limit=limit).collect()]
    mask = (1 << 64) - 1
    assert all(bin((a ^ b) & mask).count("1") <= 3 for a, b in links)
    want = components(signed, [(a, b) for k, a in enumerate(signed) for b in signed[:k] if bin((a ^ b) & mask).count("1") <= 3])
    assert components(signed, links) == want


def test_simhash_edges(edge, empty):
    got = defaultdict(list)
    for r in simhash.near_duplicates(edge).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == edge.count()
    zero = {got[i][0].fingerprint for i in (2, 3, 4)}
    assert zero == {"0" * 16} and got[4][0].component_id == 2
    assert got[5][0].component_id == 1 and got[6][0].component_id == 1
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(edge).collect()]
    assert 1 in kept and 5 not in kept and kept.count(9) == 2 and None in kept


def test_rows_that_share_an_id_go_by_their_own_component(spark):
    a, b = "the first text of some plain words that stand here", "another one about quite different things, longer than the first"
    df = spark.createDataFrame([(3, a), (7, a), (7, b), (9, b), (None, b)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in simhash.keep_one(df).collect()) == sorted([("3", a), ("7", b), ("None", b)])


def test_components_on_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, i) for i in range(101, 160)] + [(160, 160), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain + hub + chain, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def brute_report(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        out.append((i, len(t), t[: len(t) - h] + n[:h], t, n))
    return out


def canon(t):
    if t.isascii():
        return " ".join(t.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())


def check_report(got, rows, digest=lambda raw: xxhash.xxh3_128_hexdigest(raw)):
    want = sorted((str(i), n, hashlib.sha256(e.encode()).hexdigest(), float(canon(e) == canon(t)), float(canon(x) == canon(t))) for i, n, e, t, x in brute_report(rows))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == want


def test_edit_report_matches_brute_force(docs, rows):
    got = fingerprints.edit_report(docs).collect()
    check_report(got, rows)
    by_canon = defaultdict(set)
    prints = {r.doc_id: r.fingerprint for r in got}
    for i, t in rows:
        by_canon[canon(t)].add(prints[i])
    assert all(len(v) == 1 for v in by_canon.values())
    assert len({next(iter(v)) for v in by_canon.values()}) == len(by_canon)


def test_edit_report_edges(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    check_report(fingerprints.edit_report(edge).collect(), rows)
    assert fingerprints.edit_report(empty).count() == 0
    one = spark.createDataFrame([(7, "only row")], "doc_id long, text string")
    assert fingerprints.edit_report(one).first().near_next == 1.0


def test_colliding_digests_are_told_apart_by_bytes(docs, rows):
    weak = lambda raw: f"{len(raw) % 5}"
    got = fingerprints.edit_report(docs, weak).collect()
    check_report(got, rows)
    prints = {r.doc_id: r.fingerprint for r in got}
    texts = dict(rows)
    assert len(set(prints.values())) == len({canon(t) for t in texts.values()})
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs, weak).collect()}
    for a in list(texts)[:60]:
        for b in list(texts)[:60]:
            assert (plain[a] == plain[b]) == (canon(texts[a]) == canon(texts[b]))


@given(st.text(max_size=3000))
@settings(max_examples=40, deadline=None)
def test_chunks_join_to_the_text(text):
    parts = chunk = chunks.chunk(text)
    assert b"".join(parts) == text.encode("utf-8", "surrogatepass")
    assert all(len(c) <= chunks.GREATEST for c in chunk)


def rolled_chunks(raw):
    """Chunks by a hash rolled byte by byte, with the rule of marks, least and greatest length."""
    g, h, out, last = chunks.gear_table().tolist(), 0, [], 0
    for t, b in enumerate(raw, 1):
        h = ((h << 1) + g[b]) & 0xFFFFFFFF
        mark = h >> (32 - chunks.BITS) == 0
        if t - last == chunks.GREATEST or (mark and t - last >= chunks.LEAST):
            out.append(raw[last:t])
            last = t
    return [*out, raw[last:]] if last < len(raw) else out


@given(st.one_of(st.binary(max_size=4000), st.integers(0, 10**6).map(lambda n: np.random.default_rng(n).integers(97, 110, 6000, dtype=np.uint8).tobytes())))
@settings(max_examples=60, deadline=None)
def test_boundaries_equal_a_rolling_scan(raw):
    ends = chunks.boundaries(np.frombuffer(raw, np.uint8))
    assert [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)] == rolled_chunks(raw)


def test_gear_hash_is_a_rolling_sum():
    raw = np.frombuffer(b"some text that is longer than the window of the gear hash, much longer", np.uint8)
    g, h = chunks.gear_table(), 0
    for t, b in enumerate(raw):
        h = ((h << 1) + int(g[b])) & 0xFFFFFFFF
        assert int(chunks.gear_hash(raw)[t]) == h


def brute_spans(rows, least):
    seen, places = {}, []
    for doc, key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        at = 0
        for c in chunks.chunk(text):
            places.append((doc, key, at, at + len(c), c))
            at += len(c)
    count = defaultdict(int)
    for p in places:
        seen.setdefault(p[4], p)
        count[p[4]] += 1
    out, now = [], None
    for doc, key, a, b, c in places:
        if count[c] < 2:
            now = None
            continue
        kept = seen[c][:3] == (doc, key, a)
        if now and now[0] == doc and now[1] == key and now[3] == a and now[5] == kept:
            now[3] = b
        else:
            now = [doc, key, a, b, seen[c][0], kept]
            out.append(now)
    return sorted((str(x[0]), x[1], x[2], x[3], str(x[4]), x[5]) for x in out if x[3] - x[2] >= least)


def keyed(rows):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(i, signed(xxhash.xxh64_intdigest(t.encode(), 42)) if t is not None else 42, t) for i, t in rows]


@pytest.mark.parametrize("least", [40, chunks.MIN_BYTES])
def test_repeated_spans_match_brute_force(docs, rows, least):
    got = sorted((str(r.doc_id), r.row_key, r.begin, r.finish, str(r.first_doc_id), r.kept) for r in chunks.repeated_spans(docs, least).collect())
    assert got == brute_spans(keyed(rows), least)


def test_first_of_spans_in_many_batches(spark, docs):
    rows = [(i, f"Begin of {i}. {' '.join(f'shared{k}' for k in range(60))} End of {i}.") for i in range(10, 50)] + [(r.doc_id + 100, r.text) for r in docs.collect()]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "8")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(5, "doc_id")
        got = sorted((str(r.doc_id), r.row_key, r.begin, r.finish, str(r.first_doc_id), r.kept) for r in chunks.repeated_spans(df).collect())
    finally:
        spark.conf.set(size, before)
    assert got == brute_spans(keyed(rows), chunks.MIN_BYTES)


@pytest.mark.parametrize("batch", [1, 2, 10_000])
def test_repeated_rows_count_as_one_document(spark, batch):
    shared = " ".join(f"shared{k}" for k in range(60))
    alone = " ".join(f"alone{k}" for k in range(60))
    rows = [(1, f"One begins. {shared} One ends."), (2, f"Two begins. {shared} Two ends."), (3, alone), (4, shared), (None, f"None begins. {shared}")]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(batch))
    try:
        for times in (rows * 3, [r for r in rows for _ in range(3)]):
            df = spark.createDataFrame(times, "doc_id long, text string").coalesce(1)
            got = sorted((str(r.doc_id), r.row_key, r.begin, r.finish, str(r.first_doc_id), r.kept) for r in chunks.repeated_spans(df).collect())
            assert got == brute_spans(keyed(rows), chunks.MIN_BYTES)
            assert {x[0] for x in got} == {"1", "2", "4", "None"}
            cut = [r["__kept_text"] for r in chunks.without_repeats(df).where("doc_id = 2").collect()]
            assert len(cut) == 3 and not any("shared30" in t for t in cut)
    finally:
        spark.conf.set(size, before)


def test_spans_of_planted_passages(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    found = chunks.repeated_spans(edge).collect()
    got = sorted((str(r.doc_id), r.row_key, r.begin, r.finish, str(r.first_doc_id), r.kept) for r in found)
    assert got == brute_spans([r for r in keyed(rows) if r[2] is not None], chunks.MIN_BYTES)
    assert {13, 14} <= {r.doc_id for r in found} and not {1, 2, 3, 4, 15} & {r.doc_id for r in found if not r.kept}
    assert chunks.repeated_spans(empty).count() == 0
    kept = {r.doc_id: r["__kept_text"] for r in chunks.without_repeats(edge).collect()}
    assert "passage30" in kept[13] and "passage30" not in kept[14] and kept[2] is None and kept[1] == rows[[i for i, _ in rows].index(1)][1]


def jaccard(a, b):
    f = lambda s: {s[i : i + 5] for i in range(max(1, len(s) - 4))}
    return len(f(a) & f(b)) / len(f(a) | f(b))


def brute_lines(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    first, own = {}, defaultdict(list)
    for doc, key, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            if n := lines.normalised(line):
                first.setdefault(n, (doc, key, no))
                own[doc, key].append((no, n))
    distinct = sorted(first, key=len)
    sets = {s: {s[i : i + 5] for i in range(max(1, len(s) - 4))} for s in distinct}
    links = []
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if not 0.8 <= len(sets[a]) / len(sets[b]) <= 1.25:
                continue
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    comp = components(distinct, links)
    order = {k: v for k, v in first.items()}
    best = {}
    for s in distinct:
        c, p = comp[s], order[s]
        rank = (p[0] is not None, p[0] or 0, p[1], p[2])
        if c not in best or rank < best[c][0]:
            best[c] = (rank, p)
    return {(d, k): [no for no, n in v if best[comp[n]][1] != (d, k, no)] for (d, k), v in own.items()}


@pytest.mark.parametrize(("block", "run"), [(2, lines.RUN), (3, 32), (lines.BLOCK, lines.RUN)])
def test_removed_lines_match_brute_force(docs, rows, block, run):
    got = {(r.doc_id, r.row_key): r.removed for r in lines.removed_lines(docs, block=block, run=run).collect()}
    want = {k: v for k, v in brute_lines(keyed(rows)).items() if v}
    assert got == want


def test_line_edges(edge, empty):
    out = {r.doc_id: r for r in lines.dedup_lines(edge).collect()}
    assert out[2]["__kept_text"] is None and out[3]["__kept_text"] == "" and out[4]["__removed"] == 0
    assert out[11]["__kept_text"] == "before\nafter" and out[5]["__kept_text"] == "" and out[10]["__removed"] == 0
    kept = lines.kept_documents(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 not in ids and 2 in ids and 3 in ids and ids.count(9) == 2
    assert lines.dedup_lines(empty).count() == 0 and lines.kept_documents(empty).count() == 0


def test_short_lines_and_signature_recall():
    texts = [f"line number {i} has words that are like those of its neighbour, not all of them" for i in range(40)]
    sig = lines.signatures(texts + ["a", "ab", ""])
    assert sig.shape == (43, lines.BANDS)
    hits = [bool((sig[i] == sig[j]).any()) for i in range(40) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert hits and sum(hits) / len(hits) > 0.97


def test_lines_that_stand_in_many_places(spark, monkeypatch):
    line, near = "one line that stands in each and every document of them all", "one line that stands in each and every document of them all!"
    rows = [(i, f"{line}\nown line of the document with the number {i * 7919}\n{line}") for i in range(50)] + [(50, near), (51, None)]
    got = {r.doc_id: r.removed for r in lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    want = brute_lines(keyed(rows))
    assert got == {d: v for (d, _), v in want.items() if v} and got[50] == [0] and got[0][0] > 0 and 51 not in got


def test_recall_by_line_length(spark):
    rng = np.random.default_rng(8)
    sizes, pairs = (4, 8, 16, 48, 60, 64, 100), 300  # shingles of the shorter line; the longer one has a quarter more
    rows = []
    for k, n in enumerate(sizes):
        for i in range(pairs):
            line = "".join(chr(c) for c in rng.integers(ord("a"), ord("z") + 1, n + 4 + n // 4))
            at = 2 * (k * pairs + i)
            rows += [(at, line[: n + 4]), (at + 1, line)]
    removed = [r.doc_id for r in lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert all(i % 2 for i in removed)
    found = np.bincount([i // 2 // pairs for i in removed], minlength=len(sizes)) / pairs
    assert (found > 0.97).all(), found
