"""Tokens, quality, mixing, search, sharding, licences and the pipeline."""

import hashlib
import json
import math
import os
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import bpe, licenses, lines, mixing, quality, queries, sharding, simhash, topk
from weftline.session import Scratch



@pytest.fixture(scope="session")
def both():
    pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    with open(path, encoding="utf-8") as f:
        own = bpe.Bpe(f.read())
    return own, tokenizers.Tokenizer.from_file(path)


@given(st.one_of(st.text(max_size=200), st.text(alphabet="abcdefgh'st <|endoftext|>éÀß1½²_\x1c\x85 　ΣİK漢", max_size=120)))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_library(both, text):
    own, lib = both
    ids = own.encode(text)
    assert ids == lib.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_letters_newer_than_the_interpreter(both):
    own, lib = both
    for a, b in [r for c in bpe.NEWER.values() for r in c] + [r[:2] for r in bpe.NEWER_CAPITALS]:
        for i in {a, b, a - 1, b + 1, (a + b) // 2}:
            text = f"a{chr(i)}:{chr(i)}1"
            assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids, hex(i)


def test_other_definitions_are_refused():
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"model": spec["model"] | {"unk_token": "?"}}):
        with pytest.raises(ValueError, match="not a definition"):
            bpe.Bpe(json.dumps(spec | change))


def test_long_words_and_short_ones_merge_alike(both):
    own, lib = both
    for word in ("a" * 3000, "thereandhere" * 50, "x"):
        assert own.encode(word) == lib.encode(word, add_special_tokens=False).ids
    words = ["there", "anthonerth", "a", "zzzzzz", "interesting"]
    assert own.words(words) == [own._one(w) for w in ([int(own.inner[b]) for b in x.encode()[:-1]] + [int(own.final[x.encode()[-1]])] for x in words)]


def test_token_digests(docs, rows, both, edge, empty):
    own, lib = both
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def want(text):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        return len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))

    path = queries.tokenizer_path()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(docs, path).collect()}
    assert got == {i: want(t) for i, t in rows}
    there = Counter((r.doc_id, want(r.text)) for r in edge.collect())
    assert Counter((r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in bpe.token_digests(edge, path).collect()) == there
    assert bpe.token_digests(empty, path).count() == 0
    r = bpe.encode_documents(edge, path).where("doc_id = 15").first()
    assert r.decoded == lib.decode(r.ids, skip_special_tokens=False) and len(r.ids) == r.n_tokens


def plain_score(net, text):
    """The network of the score by plain loops: byte by byte, filter by filter, chunk by chunk."""
    raw = text + bytes(max(0, quality.WIDTH - len(text)))
    n = len(raw) - quality.WIDTH + 1
    response = [[sum(float(net.tables[k][raw[i + k]][f]) for k in range(quality.WIDTH)) for i in range(n)] for f in range(quality.FILTERS)]
    starts = range(0, max(1, -(-n // quality.STRIDE) - 1) * quality.STRIDE, quality.STRIDE)
    pooled = [[max(0.0, max(r[a : a + quality.CHUNK]) + float(b)) for a in starts] for r, b in zip(response, net.bias, strict=True)]
    z = sum(sum(p) / len(p) * float(w) for p, w in zip(pooled, net.out[: quality.FILTERS], strict=True))
    z += sum(max(p) * float(w) for p, w in zip(pooled, net.out[quality.FILTERS :], strict=True)) + float(net.base) + net.shift
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_scores_match_plain_loops(spark, edge):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "zz##11 ") * (i + 1)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    for n in (0, 1, 3, 4, 5, 127, 128, 131, 132, 255, 256, 259, 260, 384, 387, 388, 1000, 8200, 8500):
        text = bytes((i * 31 + i // 7) % 251 for i in range(n))
        assert net.score(text) == pytest.approx(plain_score(net, text), rel=1e-4, abs=1e-6), n
    for r in quality.scores(edge.where("length(text) < 1000 or text is null"), net).join(edge.select("doc_id", "text"), "doc_id").collect():
        assert r.score == pytest.approx(plain_score(net, (r.text or "").encode()), rel=1e-4, abs=1e-6)
    few = quality.train(docs, labels, sample_bytes=200)  # the bound leaves out rows, never parts of a text
    assert 0 <= few.score(b"any text") <= 1


def test_quality_on_held_out_rows(spark, sf, edge, empty):
    folder = os.path.join(os.path.dirname(sf), "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = quality.classify(docs, labels)
    got = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    y, p, s = (np.array([r[k] for r in got]) for k in ("quality", "predicted", "score"))
    assert (y == p).mean() > 0.97 and p[y == 1].mean() > 0.98
    rank = s.argsort().argsort()
    assert (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum() > 0.98
    net = quality.train(docs, labels)
    text = b"Some text. " * 3000
    assert net.score(b"") == net.score(b"\0" * quality.WIDTH) and 0 <= net.score(text) <= 1
    odd = quality.classify(edge, labels).collect()
    assert len(odd) == edge.count() and all(r.score is not None for r in odd)
    assert {r.doc_id: r.held_out for r in odd}[1] == (zlib.crc32(b"1") % 5 == 0)
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(edge, labels.limit(0)).count() == edge.count()
    kept = quality.accepted(edge, labels)
    assert kept.columns == edge.columns and kept.count() == sum(r.predicted for r in odd)


def test_pair_tables_score_as_single_ones():
    net = quality.ByteNet(4)
    for n in (1, 5, 127, 128, 131, 300, 20_000):
        raw = net.padded(bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)))
        assert np.allclose(net.chunk_values(raw), net.pooled(raw)[0], atol=1e-5)


def words(text):
    return len((text or "").encode().split())


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
            free.discard(s)
    return out


def check_mix(got, rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    goal = brute_targets(dict(sizes))
    taken, biggest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s]) and 0 <= r.taken <= 3 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r.size)
    assert sum(taken.values()) <= sum(sizes.values()) + 1e-6
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 2 * biggest[s] + max(biggest.values())


def test_mix_meets_targets(spark, docs, edge, empty):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mixing.mix(docs).collect()
    check_mix(got, rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    check_mix(mixing.mix(edge).collect(), [(r.doc_id, r.text, r.source) for r in edge.collect()])
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert all(copies.get(r.doc_id, 0) == r.taken // r.size for r in got if r.size)
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]


def brute_top(vectors, k, every=100):
    own = {i: np.floor(1024 * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in vectors if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in own:
        if q % every == 0:
            best = sorted((-int(own[q] @ v), i) for i, v in own.items() if i != q and len(v) == len(own[q]))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("shard", [64, topk.SHARD])
def test_top_k_is_exact(spark, sf, shard):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = topk.top_k(table, F.col("vec_id") % 100 == 0, shard=shard)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top([(r.vec_id, r.embedding) for r in table.collect()], 10)


def test_top_k_edges(spark):
    rows = [(i, [0.5, 0.25], 1) for i in range(0, 300)] + [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan"), 1.0], 1), (500, [float("inf"), 0.0], 1)]
    rows += [(600, [1.0, 2.0, 3.0], 1), (601, [-1.0, 0.5, 0.1], 1), (700, [-0.001, -3.7], 1), (None, [1.0, 1.0], 1), (800, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int")
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, shard=50).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top([r[:2] for r in rows], 10)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize(("low", "high"), [(1e5, 2e5), (1e6, 2e6)])
def test_scores_are_whole_numbers_of_any_size(spark, low, high):
    rng = np.random.default_rng(3)
    rows = [(i, rng.uniform(low, high, 8).tolist()) for i in range(101)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, shard=20)
    own = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = set()
    for q in (0, 50, 100):
        whole = {i: min(sum(a * b for a, b in zip(own[q], v, strict=True)), (1 << 63) - 1) for i, v in own.items() if i != q}
        want |= {(q, r, i, s) for r, (i, s) in enumerate(sorted(whole.items(), key=lambda x: (-x[1], x[0]))[:10], 1)}
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want


def test_queries_skip_shards_that_cannot_hold_their_best(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 30, (16, 8))
    rows = [(i, (centres[i % 16] + rng.normal(0, 0.5, 8)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = F.col("vec_id") % 40 == 0
    got = topk.top_k(df, asked, shard=100)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == {x for x in brute_top(rows, 10, every=40)}
    scratch = Scratch(spark)
    own = df.select("vec_id", topk.whole_numbers().alias("v")).withColumn("dim", F.size("v"))
    shards = topk.build_shards(own, scratch, 100)
    kth = got.where("rank = 10").select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    ready = own.join(kth, "vec_id").withColumn("home", F.lit(""))
    n, sent = shards.count(), topk.routes(ready, shards, scratch, False).count()
    assert n >= 16 and sent < 0.2 * n * 40 and shards.agg(F.sum(F.size("ids"))).first()[0] == 1600


@given(st.integers(1, 400), st.integers(1, 6), st.integers(0, 10**6))
@settings(max_examples=30, deadline=None)
def test_tree_boxes_hold_their_points(n, dim, seed):
    pts = np.random.default_rng(seed).integers(-50, 50, (n, dim)).astype(float)
    tree = topk.KdTree(pts, leaf=8)
    q = np.random.default_rng(seed + 1).integers(-50, 50, (1, dim)).astype(float)
    bound = tree.bounds(q)[0]
    assert sorted(tree.order) == list(range(n))
    for (a, b), u, c in zip(tree.spans, bound, tree.children, strict=True):
        assert (pts[tree.order[a:b]] @ q[0]).max() <= u and (c or b - a <= 8 or np.ptp(pts[tree.order[a:b]], axis=0).max() == 0)
    got = tree.search(q[0], bound, np.arange(n), -1, 5, None)
    assert [(-s, i) for s, i in got] == sorted((-float(s), i) for i, s in enumerate(pts @ q[0]))[:5]


def brute_shards(rows, limit):
    h = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)
    own = [(i, len((t or "").encode()), h(i, t)) for i, t in rows]
    out = []

    def split(part, depth, prefix):
        if sum(r[1] for r in part) <= limit or len({r[2] for r in part}) == 1:
            seen = Counter()
            for i, n, x in part:
                page = 0 if n == 0 else seen[x] // max(1, limit // n)
                seen[x] += 1
                out.append((str(i), n, prefix, depth, page))
        else:
            for bit in (0, 1):
                if some := [r for r in part if r[2] >> (59 - depth) & 1 == bit]:
                    split(some, depth + 1, prefix + str(bit))

    if own:
        split(own, 0, "")
    return Counter(out)


@pytest.mark.parametrize("limit", [1, 5000, 40_000, 1 << 40])
def test_shards_fit(docs, rows, edge, empty, limit):
    for df in (docs, edge.union(edge).union(edge)):
        want = brute_shards([(r.doc_id, r.text) for r in df.collect()], limit)
        got = Counter((str(r.doc_id), r.n_bytes, r.shard, r.depth, r.page) for r in sharding.shard(df, limit).collect())
        assert got == want
    assert sharding.shard(empty, limit).count() == 0


def test_every_known_sentence_has_a_trigger_and_normal_form():
    for s in licenses.SENTENCES.values():
        assert any(t in s for t in licenses.TRIGGERS), s
        assert s == " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    assert {i for _, run in licenses.RULES for i in run} <= set(licenses.SENTENCES)


def test_licence_rules(spark, edge, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    cases = {
        1: ("Intro text here\nReleased under the MIT License.\nMore", "MIT"),
        2: (mit, "MIT"),
        3: ("LICENSED UNDER CC BY-NC 4.0. All rights reserved.", "CC-BY-NC-4.0,all-rights-reserved"),
        4: ("A licence plate is not licensed under anything. Free software!", ""),
        5: (None, ""),
        6: ("This work is licensed under the GNU General Public License, version 3.\n" * 2, "GPL-3.0-only"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert {k: r.licenses for k, r in got.items()} == {k: v[1] for k, v in cases.items()}
    assert got[2].sentence_ids == "<7><8>" and got[6].n_sentences == 2
    assert licenses.scan(edge).count() == edge.count() and licenses.scan(empty).count() == 0
    assert licenses.scan(edge).where("doc_id = 15").first().licenses == "Apache-2.0"


def test_standard_notices_are_found_however_they_are_wrapped(spark):
    """Each notice on one line, wrapped, and wrapped as a comment, after a line without an end; in Spark and in SQL."""
    cases = []
    for name, text in licenses.NOTICES:
        body = [textwrap.wrap(p, 72) for p in text.split("\n\n")]
        plain = "\n\n".join("\n".join(p) for p in body)
        comment = "\n#\n".join("\n".join(f"# {x}" for x in p) for p in body)
        indented = "\r\n\r\n".join("\r\n".join(f" *  {x}" for x in p) for p in body)
        cases += [(name, text), (name, plain), (name, f"#!/bin/sh\n#\n{comment}\n\nx = 1\n"), (name, f"/*\n\n{indented}\n\n */")]
    gpl2 = (
        "/*\n * Copyright (C) 2020 Someone\n * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n */"
    )
    cases += [
        ("GPL-2.0-or-later", gpl2),
        ("all-rights-reserved", "All rights  reserved."),
        ("MPL-2.0", "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0."),
        ("", "All rights of way are reserved. The license expired. Software is free."),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, (name, text) in enumerate(cases):
        assert got[i].licenses == name, (text, got[i])
    documents = df.toPandas()  # noqa: F841 - read by the SQL
    sql = {r[0]: r[1:] for r in duckdb.sql(licenses.sql()).fetchall()}
    assert sql == {i: (r.n_sentences, r.sentence_ids, r.licenses) for i, r in got.items()}


def test_native_operators_run_no_python(docs):
    for df in (sharding.shard(docs, 5000), licenses.scan(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stages(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    net = quality.train(docs, labels)
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    want = [r.doc_id for r in docs.collect() if net.score(r.text.encode()) >= quality.THRESHOLD]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == columns
    lined = corpus_pipeline.line_stage(spark, kept, sf)
    gone = {r.doc_id: set(r.removed) for r in lines.removed_lines(kept).collect()}
    before = {r.doc_id: r.text for r in kept.collect()}
    for r in lined.collect():
        assert r.text == "\n".join(x for i, x in enumerate(before[r.doc_id].split("\n")) if i not in gone.get(r.doc_id, ()))
        assert r.doc_id not in gone or r.n_chars == len(r.text)
    assert lined.columns == columns
    near = corpus_pipeline.simhash_stage(spark, lined, sf)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(lined).collect()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(groups.values())) and near.columns == columns
    mixed = corpus_pipeline.mixing_stage(spark, near, sf)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(near).collect() if r.size}
    assert Counter(r.doc_id for r in mixed.collect() if r.text.split()) == Counter({i: n for i, n in taken.items() if n}) and mixed.columns == columns
    out = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in mixed.collect())
