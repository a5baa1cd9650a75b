"""Outlines, heading paths, renderers and miners on worked examples."""

import re

from pyspark.sql import functions as F

from weftline.functions import render
from weftline.operators import miners, outline, records
from weftline.session import ship
from weftline.sources import docx


def test_marked_sections_tile_the_text():
    raw = "intro\r\nThis part is one. This part is two. End."
    marks = [("one", "This part"), ("two", "This part"), ("gone", "nowhere"), ("", "End"), ("end", "End.")]
    got = miners.marked_sections(raw, marks)
    text = raw.replace("\r\n", "\n")
    assert [g["label"] for g in got] == ["one", "two", "end"] and "".join(text[g["start"] : g["end"]] for g in got) == text
    assert miners.marked_sections("", marks) == [] == miners.marked_sections(None, marks)


def test_heading_paths_and_evidence(spark):
    ship(spark)
    rows = [(1, "1 Top"), (None, "under the top stands a paragraph"), (2, "1.1 Inner"), (None, "this paragraph is about the inner things of it"), (3, "Deep"), (None, "deep down there is one more of them"), (2, "1.2 Next"), (None, " "), (None, "after the next heading comes this one"), (1, "2 Last"), (None, "the last words of the text")]
    df = spark.createDataFrame([(0, i, lv, t) for i, (lv, t) in enumerate(rows)], "doc int, pos int, level int, text string")
    paths = outline.heading_paths(df)
    got = {r.pos: r.path for r in paths.collect()}
    assert got[1] == ["1 Top"] and got[3] == ["1 Top", "1.1 Inner"] and got[5] == ["1 Top", "1.1 Inner", "Deep"] and got[8] == ["1 Top", "1.2 Next"] and got[10] == ["2 Last"] and 7 not in got
    side = [
        ("quote", ["About the ÍNNER things"], [], []), ("number", ["short"], ["see 1.2"], []), ("locator", [], [], ["section 1.1"]), ("fuzzy", ["after the next headin comes thus one"], ["x"], []),
        ("kept", [], ["segment 3", "Real topic"], []), ("none", [], ["chunk 9"], []),
    ]
    s = spark.createDataFrame([(i, 0, q, t, lo) for i, q, t, lo in side], "id string, doc int, quotes array<string>, topics array<string>, locators array<string>")
    found = {r.id: (r.path, r.how) for r in outline.evidence_paths(s, paths).collect()}
    assert found == {
        "quote": (["1 Top", "1.1 Inner"], "quote"), "number": (["1 Top", "1.2 Next"], "section_number"), "locator": (["1 Top", "1.1 Inner"], "section_number"), "fuzzy": (["1 Top", "1.2 Next"], "fuzzy_quote"),
        "kept": (["Real topic"], "retained"), "none": ([], "unresolved"),
    }


def test_outline_of_many_tiers(spark):
    rows = [(0, 0, None, "A", 1, 0), (0, 1, 0, "B", 2, 1), (0, 2, 1, "C", 3, 2), (0, 3, None, "D", 1, 3), (0, 4, 77, "E", 2, 4)]
    s = spark.createDataFrame(rows, "doc int, idx int, parent int, label string, level int, start int")
    got = {r.idx: (r.path, r.tier) for r in outline.paths(s).collect()}
    assert got == {0: ("A", 0), 1: ("A / B", 1), 2: ("A / B / C", 2), 3: ("D", 0), 4: ("E", 0)}


def test_renderers(spark):
    df = spark.createDataFrame([("t", " d ", "x"), ("t", None, "y" * 300), (None, None, None)], "t string, d string, x string")
    assert [r[0] for r in df.select(render.summary_item(F.col("t"), F.col("d"), F.col("x"))).collect()] == ["t: d", "t: " + "y" * 160, ": "]
    one = df.limit(1).select(render.system_prompt([F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit("b")]).alias("s"), render.cut(F.lit("abcdef"), 3).alias("c")).first()
    assert one.s == "a\n\nb" and one.c == "abc..."


def test_failing_models_leave_nothing_behind(spark):
    ship(spark)
    prompts = spark.createDataFrame([("k", "t", "p")], "key string, topic string, prompt string")
    assert miners.proposals(prompts, lambda p: {"proposals": "no list"}).count() == 0
    assert miners.proposals(prompts, lambda p: {}).count() == 0

    def down(prompt):
        raise RuntimeError("down")

    assert miners.proposals(prompts, down).count() == 0


def test_orphans_go_in_batches(spark):
    out = miners.orphan_batches(spark.range(250).withColumnRenamed("id", "i"), [F.col("i")]).groupBy("batch").count().collect()
    assert sum(r["count"] for r in out) == 250 and {r.batch for r in out} <= set(range(5))


def brute_place(text, marker, cursor):
    if not marker.strip():
        return -1
    at = text.find(marker, cursor)
    if at >= 0:
        return at
    wanted = set(re.findall(r"\w+", marker.lower()))
    best, score = -1, 0.0
    for m in re.finditer(r"\n\s*\n", text):
        if m.end() >= cursor and len(wanted) >= 3:
            share = len(wanted & set(re.findall(r"\w+", text[m.end() : m.end() + max(len(marker) + 40, 160)].lower()))) / len(wanted)
            if share > score:
                best, score = m.end(), share
    return best if score >= 0.6 else -1


def test_markers_are_placed_by_text_or_by_words(spark):
    text = "Opening words stand here.\n\nThe second part is about salt and water.\n \n\nA third one follows, about sand.\n\nThe second part again, of salt and water."
    cases = [("Opening", 0), ("Opening", 5), ("second part is about salty water", 0), ("second part is about salty water", 60), ("about sand follows third one more", 0), ("no such thing here", 0), ("", 0), ("salt", 70), ("two words", 0)]
    df = spark.createDataFrame([(i, text, m, c) for i, (m, c) in enumerate(cases)], "i int, t string, m string, c int")
    got = {r.i: r.p for r in df.select("i", records.marker_place(F.col("t"), F.col("m"), F.col("c")).alias("p")).collect()}
    assert got == {i: brute_place(text, m, c) for i, (m, c) in enumerate(cases)}


def test_headings_and_concepts(spark):
    cases = {"Ends, Means, and Ways": True, "Neural Gravity": False, "the pull of words": False, "": True, "Scope and Aim": True, "sand and salt": False, "First Second Third Fourth": True, "First of the Many": False}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string")
    got = {r.p: r.h for r in df.select("p", records.is_heading(F.col("p")).alias("h")).collect()}
    assert got == cases | {None: True}


def test_word_documents():
    rows = [(1, "Table of Contents"), (None, "1 Intro ... 3"), (1, "Intro & more"), (None, "text <here>"), (3, "Deep"), (None, "more")]
    raw = docx.written(rows)
    assert docx.paragraphs(raw) == [{"level": n, "text": t} for n, t in rows]
    assert docx.markdown(raw) == "# Intro & more\n\ntext <here>\n\n### Deep\n\nmore"
    assert docx.paragraphs(b"no zip") == [] == docx.paragraphs(None) and docx.markdown(b"") == ""
