"""Small cases computed by hand, and properties."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators import aggregate, dedup, graph, lifecycle, match, rank, segment, windows
from weftline.sources import conversations as conv
from weftline.streaming import sessions


# -- segments and outlines ------------------------------------------------------------------------
@given(st.lists(st.text(alphabet="ab. \n", min_size=1, max_size=5000), max_size=5), st.integers(0, 30_000))
@settings(max_examples=50, deadline=None)
def test_segments_keep_all_words_within_the_limit(parts, limit):
    raw = "\n\n".join(parts)
    out = segment.segments(raw, limit)
    cap = max(2000, min(20_000, limit))
    assert all(0 < len(s) <= cap for s in out)
    assert "".join("".join(out).split()) == "".join(raw.split())


def test_segments_of_one_long_paragraph():
    out = segment.segments("x" * 4500, 1)
    assert [len(s) for s in out] == [2000, 2000, 500]


def test_outline_ends_and_parents():
    raw = "# A\ntext\n## B\nmore\n### C\n## D\n# E\n"
    got = [(h["label"], h["parent"], raw[h["start"] : h["end"]].split("\n")[0]) for h in segment.outline(raw)]
    assert got == [("A", None, "# A"), ("B", 0, "## B"), ("C", 1, "### C"), ("D", 0, "## D"), ("E", None, "# E")]
    ends = [raw[h["end"] :][:3] for h in segment.outline(raw)]
    assert ends == ["# E", "## ", "## ", "# E", ""]
    assert segment.outline("# only one\n") == [] and segment.outline(None) == []


def test_spans():
    assert segment.spans("a *b c* d **e** *f") == [{"kind": "plain", "text": "a"}, {"kind": "span", "text": "b c"}, {"kind": "plain", "text": "d **e**"}, {"kind": "tail", "text": "f"}]


# -- conversations --------------------------------------------------------------------------------
def test_export_formats():
    chat = [{"chat_messages": [{"sender": "human", "text": "hello there"}, {"sender": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "tool"}]}, {"sender": "human", "text": " "}]}]
    node = lambda role, t, body: {"message": {"author": {"role": role}, "create_time": t, "content": {"parts": [body]}}}
    tree = {"mapping": {"b": node("assistant", 2, "second"), "a": node("user", None, "first"), "s": node("system", 0, "no"), "x": {"message": None}}}
    lines = "\n".join(json.dumps(x) for x in ({"type": "user", "message": {"content": "a question of some length"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "an answer of some length"}]}}, {"type": "user", "message": {"content": "@file skip this one"}}, {"type": "user", "message": {"content": "a question of some length"}}))
    cases = [
        (json.dumps(chat), "messages_export", [("user", "hello there"), ("assistant", "hi")]),
        (json.dumps(tree), "mapping_export", [("user", "first"), ("assistant", "second")]),
        (json.dumps([{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]), "mapping_export", [("user", "q"), ("assistant", "a")]),
        (lines, "transcript_jsonl", [("user", "a question of some length"), ("assistant", "an answer of some length")]),
        ("## Human\nhi\n\n## Assistant\nyes\n", "markdown", [("user", "hi"), ("assistant", "yes")]),
        ("x\nUser: one\nAI: two", "plaintext", [("user", "one"), ("assistant", "two")]),
        ("short text", "plaintext", [("user", "short text")]),
        ("", "plaintext", []),
    ]
    for raw, kind, want in cases:
        assert conv.export_format(raw) == kind
        assert [(x["role"], x["content"]) for x in conv.exchanges(raw)] == want
    long = ("a" * 60 + ". ") + ("b" * 60 + ". ") + "\n\n" + "c" * 120 + "\n\n" + "tail"
    assert [len(x["content"]) for x in conv.exchanges(long)] == [123, 125]


# -- rules ----------------------------------------------------------------------------------------
def test_gate_rules(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"], (True, 0.5)), (2, "b", [], (False, 0.9))], "k int, name string, tags array<string>, c struct<explicit:boolean,confidence:double>")
    rule = lambda p, c, o: {"priority": p, "condition": c, "outcome": o}
    out = rules.gate([rule(3, "c.explicit == True", "THREE"), rule(1, "c.nothing == 1", "ONE"), rule(2, "'x' in tags and not (name == 'b')", "TWO"), rule(0, "import os", "ZERO")], "NONE", df.schema)
    assert [r.o for r in df.select(out.alias("o")).collect()] == ["TWO", "NONE"]
    with pytest.raises(rules.RuleError):
        rules.rule_sql("name.lower() == 'a'", df.schema)
    stop = rules.gate_pipeline([F.lit("DEFER"), F.when(F.col("k") == 1, "ESCALATE").otherwise("ALLOW"), F.lit("DENY")])
    assert [r.o for r in df.select(stop.alias("o")).collect()] == ["ESCALATE", "DENY"]


def test_output_checks(spark):
    long = "This sentence makes a claim that goes on for more than fifty characters"
    cases = [
        (". ".join([long] * 5), False, 0, "REGENERATE"), (". ".join([long] * 5), True, 0, "BLOCK"), (". ".join([long + " [FACT]"] * 5), False, 0, "PASS"), ("You should go. You must stay.", False, 0, "FLAGGED"),
        ("You should go. You must stay.", False, 2, "REGENERATE"), ("Let me be clear", False, 0, "FLAGGED"), ("studies show it", False, 0, "REGENERATE"), ("", False, 0, "PASS"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, retry boolean, streak int, want string")
    out = df.select("want", rules.validated(F.col("t"), F.col("retry"), F.col("streak")).alias("v")).select("want", "v.status").collect()
    assert [r.status for r in out] == [r.want for r in out]


# -- drift ----------------------------------------------------------------------------------------
def test_batch_and_stream_drift_agree(spark):
    rows = [(s, t, (t * 7 % 10) / 10, (t * 3 % 10) / 10, (t % 4) / 4, "internal" if s % 2 else "external") for s in (1, 2) for t in range(1, 71)]
    df = spark.createDataFrame(rows, "session long, turn long, affect double, volatility double, rigor double, mode string")
    got = {(r.session, r.turn): r for r in windows.drift(df).collect()}
    for s in (1, 2):
        own = [r for r in rows if r[0] == s]
        for i, r in enumerate(own):
            want = sessions.assess([x[2:5] for x in own[max(0, i - 49) : i + 1]], 1, r[1], r[5])
            g = got[s, r[1]]
            assert abs(g.composite - want["composite"]) < 1e-9 and g.severity == want["severity"] and g.window == want["window"]


def test_recent_heat_counts_more_and_internal_work_is_judged_milder(spark):
    hot, calm = (0.9, 0.9, 0.9), (0.1, 0.1, 0.1)
    a = sessions.assess([calm, calm, hot], 1, 3, "external")
    b = sessions.assess([hot, calm, calm], 1, 3, "external")
    assert a["composite"] > b["composite"]
    order = ["low", "medium", "high"]
    assert order.index(sessions.assess([hot], 1, 9, "internal")["severity"]) <= order.index(sessions.assess([hot], 1, 9, "external")["severity"])
    assert sessions.assess([(1, 1, 1)], 1, 99, "internal")["severity"] == "high" and sessions.assess([(0, 0, 0)], 1, 1, "external")["severity"] == "low"


# -- ranks, packs, dedup --------------------------------------------------------------------------
def test_bm25_prefers_titles_and_numbers(spark):
    docs = spark.createDataFrame([("a", "length 12 of the tank", "dimensions"), ("b", "the tank is long", ""), ("c", "salt-water pod_v2 meter", ""), ("d", "", "")], "id string, text string, title string")
    got = [r.id for r in rank.bm25(docs, ["dimensions", "12"], 5, title=F.col("title")).collect()]
    assert got == ["a"]
    assert rank.bm25(docs, ["the", "of"], 5).count() == 0
    assert [r.id for r in rank.bm25(docs, ["saltwater", "metres"], 5).collect()] == ["c"]


def test_greedy_pack_goes_on_after_an_overflow(spark):
    df = spark.createDataFrame([([("a", 5.0), ("b", 9.0), ("c", 4.0)],)], "items array<struct<id:string,cost:double>>")
    r = df.select(rank.greedy_pack(F.col("items"), 10.0).alias("p")).first().p
    assert r.taken == ["a", "c"] and r.used == 9.0
    msgs = spark.createDataFrame([(1, t, "x" * n) for t, n in ((1, 20), (2, 980), (3, 20))], "chat long, turn long, text string")
    assert [r.turn for r in rank.newest_within(msgs, 50).collect()] == [3]


def test_blank_texts_survive_and_groups_keep_the_smallest(spark):
    df = spark.createDataFrame([(1, " a "), (2, "a"), (3, ""), (4, " "), (5, None)], "id long, text string")
    assert {r.id: r.survivor for r in dedup.survivors(df, F.col("text")).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_merged_candidates_join_refs(spark):
    df = spark.createDataFrame([("anchor", "Deep  Water", "x1", 0.5, 1, ["r1"], ["a", "b"]), ("anchor", "deep water", "x2", 0.9, 2, ["r2"], ["b", "c"])], "kind string, label string, id string, confidence double, ord long, refs array<string>, aliases array<string>")
    r = dedup.merged_candidates(df).first()
    assert (r.id, r.confidence, r.refs, r.aliases) == ("x1", 0.9, ["r1", "r2"], ["a", "b", "c"])


def test_bundles_merge_by_shared_constraints(spark):
    df = spark.createDataFrame([("b1", ["A", "b"], ["s"]), ("b2", ["a", "B", "c"], ["s", "t"]), ("b3", ["z"], []), ("b4", [], [])], "id string, constraints array<string>, depends_on array<string>")
    assert {r.id: r.canonical for r in dedup.merged_bundles(df).collect()} == {"b1": "b2", "b2": "b2", "b3": "b3", "b4": "b4"}


# -- graphs ---------------------------------------------------------------------------------------
N = "id string, type string"
E = "type string, src string, dst string, weight double, confidence double"


def brute_rank(ids, edges, teleport, d=0.85, rounds=200):
    n = len(ids)
    w = {i: {} for i in ids}
    for a, b, x in edges:
        for p, q in ((a, b), (b, a)):
            w[p][q] = w[p].get(q, 0) + (x or 1.0)
    r = dict(teleport)
    for _ in range(rounds):
        new = {i: (1 - d) * teleport[i] for i in ids}
        for i in ids:
            total = sum(w[i].values())
            for j in ids:
                new[j] += d * r[i] * (w[i].get(j, 0) / total if total else 1 / n)
        r = new
    return r


def test_ranks_with_loops_parallels_and_lonely_nodes(spark):
    ids = ["a", "b", "c", "d", "e"]
    edges = [("a", "b", 1.0), ("a", "b", 2.0), ("b", "c", 0.0), ("c", "c", 0.5), ("d", "a", None)]
    nodes = spark.createDataFrame([(i, "slab") for i in ids], N)
    e = spark.createDataFrame([("LINKS", a, b, x, 1.0) for a, b, x in edges], E)
    got = {r.id: r.score for r in graph.power_iteration(nodes, e, rounds=60, tolerance=1e-9).collect()}
    want = brute_rank(ids, edges, dict.fromkeys(ids, 0.2))
    assert all(abs(got[i] - want[i]) < 1e-6 for i in ids) and abs(sum(got.values()) - 1) < 1e-9
    seeds = spark.createDataFrame([("a",), ("ghost",)], "id string")
    got = {r.id: r.score for r in graph.power_iteration(nodes, e, seeds, rounds=60, tolerance=1e-9).collect()}
    want = brute_rank(ids, edges, {i: float(i == "a") for i in ids})
    assert all(abs(got[i] - want[i]) < 1e-6 for i in ids)
    assert {r.score for r in graph.power_iteration(nodes, e, seeds.where("id = 'ghost'")).collect()} == {0.0}
    assert graph.power_iteration(nodes.limit(0), e).count() == 0


def test_budgeted_walk_takes_the_strongest_within_budgets(spark):
    nodes = spark.createDataFrame([("a", "anchor")] + [(f"s{i}", "slab") for i in range(20)] + [("x", "anchor")], N)
    e = spark.createDataFrame([("INVOKES", "a", f"s{i}", i / 20, 1.0) for i in range(12)] + [("LINKS", "a", "s15", 0.1, 1.0), ("LINKS", "s11", "s16", 0.1, 1.0), ("TENSIONS", "a", "s17", 1.0, 1.0), ("INVOKES", "a", "x", 1.0, 1.0)], E)
    got = graph.budgeted_subspace(nodes, e, ["a"])
    assert [x[0] for x in got if x[1] == 1] == [f"s{i}" for i in range(11, 3, -1)] + ["s15"]
    assert [x for x in got if x[1] == 2] == [("s16", 2, "LINKS")]


def test_conflicts_orphans_depths_and_communities(spark):
    nodes = spark.createDataFrame([(i, "slab") for i in "abcdefg"], N)
    e = spark.createDataFrame([("CONFLICTS", "a", "b", 1.0, 1.0), ("CONFLICTS", "b", "c", 1.0, 1.0), ("LINKS", "d", "e", 1.0, 1.0), ("LINKS", "e", "f", 1.0, 1.0), ("LINKS", "d", "f", 1.0, 1.0)], E)
    ab = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(tuple(r) for r in graph.conflicts(e, ab).collect()) == [("a", "b"), ("b", "a"), ("c", "b")]
    assert {r.id: r.missing for r in graph.orphans(nodes, e).collect()} == {"a": "in", "c": "out", "d": "in", "f": "out", "g": "both"}
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "zz")], "id string, dep string")
    assert {r.id: r.depth for r in graph.depths(nodes, needs).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 0, "f": 0, "g": 0}
    com = {r.id: r.community for r in graph.label_communities(nodes, e).collect()}
    assert len({com[i] for i in "def"}) == 1 and com["a"] != com["d"] and com["g"] not in {com["a"], com["d"]}
    assert {r.id: r.size for r in graph.components(nodes, e).collect()} == {"a": 3, "b": 3, "c": 3, "d": 3, "e": 3, "f": 3, "g": 1}


def test_shapes_follow_the_first_rule(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (10, 2, 0.0), (100, 100, 0.9), (10, 30, 0.1), (100, 300, 0.1), (100, 110, 0.39)], "n long, e long, r double")
    assert [r.s for r in df.select(aggregate.shape(F.col("n"), F.col("e"), F.col("r")).alias("s")).collect()] == ["sparse", "sparse", "spine", "flat", "highway", "flat"]


# -- matching and states --------------------------------------------------------------------------
def test_label_resolution_tiers(spark):
    index = match.label_index(spark.createDataFrame([("Salt Tank", "1", 0), ("salt tank ", "2", 1), ("Deep water anchor", "3", 0), (" ", "4", 0)], "label string, id string, priority int"))
    asked = spark.createDataFrame([("SALT TANK",), ("deep water",), ("deep wader anchor",), ("unknown",)], "label string")
    got = {r.label: (r.id, r.strategy) for r in match.resolve_labels(asked, index).collect()}
    assert got == {"SALT TANK": ("1", "exact"), "deep water": ("3", "contained"), "deep wader anchor": ("3", "alike"), "unknown": (None, "miss")}


def test_phrases_match_by_whole_words(spark):
    texts = spark.createDataFrame([(1, "The deep-water anchor holds."), (2, "deep watery anchors"), (3, None)], "text_id long, text string")
    phrases = spark.createDataFrame([("p", "Deep water"), ("q", "anchor"), ("r", "  ")], "id string, phrase string")
    assert sorted(tuple(r) for r in match.phrase_hits(texts, phrases).collect()) == [(1, "p"), (1, "q")]


def test_review_refuses_drift_and_unverified_facts(spark):
    rows = [(1, "TENTATIVE", "promote_corpus", "low", True), (2, "TENTATIVE", "promote_corpus", "high", True), (3, "TENTATIVE", "promote_corpus", "low", None), (4, "COMMITTED", "discard", "low", True), (5, "DRAFT_UNAUTHORIZED", "discard", "low", True)]
    df = spark.createDataFrame(rows, "id long, status string, action string, severity string, facts_ok boolean")
    got = {r.id: (r.new_status, r.reason) for r in lifecycle.reviewed(df).collect()}
    assert got == {1: ("COMMITTED", None), 2: ("TENTATIVE", "drift"), 3: ("TENTATIVE", "facts"), 4: ("COMMITTED", "closed"), 5: ("DISCARDED", None)}


def test_text_functions(spark):
    df = spark.createDataFrame([("“Salt-Water” m³ v2 3.5 meters",)], "t string")
    r = df.select(text.search_tokens(F.col("t")).alias("tok"), text.fold_punctuation(F.col("t")).alias("p"), text.slug(F.col("t"), 9).alias("s"), text.light_title(F.lit("deep DNA water")).alias("l"), text.jaccard(F.array(), F.array()).alias("j")).first()
    assert r.tok == ["saltwater", "cubic", "metres", "3.5", "metres"] and r.p.startswith('"Salt-Water"') and r.s == "salt_wate" and r.l == "Deep DNA Water" and r.j == 0.0
