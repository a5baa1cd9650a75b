"""Section trees: nested outlines, the choice of a pillar builder, heading paths of paragraphs and of evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.models import accent_folded
from weftline.operators.match import sequence_ratio
from weftline.session import Scratch

# A section number, path parts that say nothing, lengths of quotes, and the least likeness of a quote to a paragraph.
SECTION_NUMBER = r"(\d+(?:\.\d+)+|\d+)"
MECHANICAL = r"(?i)^(?:segment|chunk|part|section)?\s*\d*$"
QUOTE_LEAST, FRAGMENT_LEAST, ALIKE, NOWHERE = 20, 16, 0.62, 10**12
DEPTH = 8


def paths(sections: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``sections(doc, idx, parent, label, …)`` with path, the labels from the root joined by `` / ``, and tier, 0 at the root.

    One join a level; sections deeper than ``depth`` have no row, those whose parent is missing are roots.
    """
    ids = sections.select(F.col("doc").alias("d"), F.col("idx").alias("i")).distinct()
    rooted = sections.join(ids, (F.col("doc") == F.col("d")) & (F.col("parent") == F.col("i")), "left")
    here = rooted.where("i is null").drop("d", "i").withColumns({"path": F.col("label"), "tier": F.lit(0)})
    inner = rooted.where("i is not null").drop("d", "i")
    out = here
    for tier in range(1, depth):
        up = here.select("doc", F.col("idx").alias("parent"), F.col("path").alias("above"))
        here = inner.join(up, ["doc", "parent"]).select(*inner.columns, F.concat("above", F.lit(" / "), "label").alias("path"), F.lit(tier).alias("tier"))
        out = out.unionByName(here)
    return out


def outline_rows(sections: DataFrame, slabs: DataFrame, crossings: DataFrame, summaries: DataFrame) -> DataFrame:
    """(doc, path, tier, parent_path, label, start, leaf, summary, slab_titles, cross_edges): the nested outline, a row a node.

    ``sections(doc, idx, parent, label, level, start)``; leaves carry the titles of ``slabs(doc, path, n, title)`` and
    ``crossings(doc, home, target, weight)``, the heaviest first. Nesting is left to the reader of the rows: children by start.
    """
    p = paths(sections)
    parents = sections.select("doc", F.col("parent").alias("idx")).where("idx is not null").distinct().withColumn("inner", F.lit(True))
    listed = slabs.groupBy("doc", "path").agg(F.array_sort(F.collect_list(F.struct("n", "title"))).alias("s"))
    cross = crossings.groupBy("doc", F.col("home").alias("path")).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "target"))).alias("c"))
    node = p.join(parents, ["doc", "idx"], "left").join(listed, ["doc", "path"], "left").join(cross, ["doc", "path"], "left").join(summaries, ["doc", "path"], "left")
    leaf = F.col("inner").isNull()
    none = F.array().cast("array<string>")
    above = F.when(F.contains("path", F.lit(" / ")), F.regexp_extract("path", r"^(.*) / ", 1))
    return node.select(
        "doc", "path", "tier", above.alias("parent_path"), "label", "start", leaf.alias("leaf"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.when(leaf, F.coalesce(F.transform("s", lambda x: x["title"]), none)).alias("slab_titles"),
        F.when(leaf, F.coalesce(F.transform("c", lambda x: F.concat(F.element_at(F.split(x["target"], " / "), -1), F.lit(" ("), (-x["w"]).cast("string"), F.lit(")"))), none)).alias("cross_edges"),
    )


def pillar_builder(requests: DataFrame, sections: DataFrame) -> DataFrame:
    """(request, builder) of ``requests(request, cluster, session, doc)``: clustering, session, outline of two tiers or of more, or collection.

    An outline has more tiers where a child of a top section has a child of its own.
    """
    kids = sections.where("parent is not null").select("doc", "idx", "parent")
    deep = kids.alias("a").join(kids.alias("b"), (F.col("a.doc") == F.col("b.doc")) & (F.col("b.parent") == F.col("a.idx"))).select(F.col("a.doc").alias("doc")).distinct().withColumn("deep", F.lit(True))
    some = sections.select("doc").distinct().withColumn("known", F.lit(True))
    own = requests.join(deep, "doc", "left").join(some, "doc", "left")
    builder = (
        F.when(F.coalesce("cluster", F.lit(False)), "clustering").when(F.col("session").isNotNull(), "session").when(F.col("deep"), "outline_deep").when(F.col("known"), "outline").otherwise("collection")
    )
    return own.select("request", builder.alias("builder"))


def heading_paths(paragraphs: DataFrame) -> DataFrame:
    """(doc, pos, text, path, heading) of ``paragraphs(doc, pos, level, text)``: each paragraph with the headings that hold it.

    ``level`` is 1 to 6 for headings and null for others. A heading ends all that are as deep or deeper; its own path
    ends with itself. Blank paragraphs are left out.
    """
    own = paragraphs.where(F.trim("text") != "").withColumn("text", F.trim("text"))
    order = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    latest = {k: F.last(F.when(F.col("level") == k, F.struct("pos", "text")), True).over(order) for k in range(1, 7)}
    shallower = {k: F.max(F.when(F.col("level") < k, F.col("pos"))).over(order) for k in range(1, 7)}
    marked = own.withColumns({f"h{k}": v for k, v in latest.items()} | {f"s{k}": v for k, v in shallower.items()})
    part = lambda k: F.when(F.col(f"h{k}").isNotNull() & ((F.col("level").isNull()) | (F.col("level") >= k)) & (F.coalesce(f"s{k}", F.lit(-1)) < F.col(f"h{k}.pos")), F.col(f"h{k}.text"))
    return marked.select("doc", "pos", "text", F.array_compact(F.array(*[part(k) for k in range(1, 7)])).alias("path"), F.col("level").isNotNull().alias("heading"))


def evidence_paths(sidecars: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(id, path, how) of ``sidecars(id, doc, quotes, topics, locators)`` in ``heading_paths`` rows of their document.

    By a quote of twenty characters or more that is part of a paragraph or holds one; by a section number among the topics
    and locators; by the likest paragraph at .62 or more; else the topics that say something are kept.
    """
    scratch = Scratch(sidecars.sparkSession)
    texts = scratch.save(paragraphs.where(~F.col("heading")).select("doc", "pos", "path", accent_folded(F.col("text")).alias("t")))
    quotes = scratch.save(sidecars.select("id", "doc", F.posexplode("quotes").alias("n", "quote")).where("quote <> ''").select("id", "doc", "n", accent_folded(F.col("quote")).alias("q")))
    pairs = quotes.join(texts, "doc")
    holds = (F.length("q") >= QUOTE_LEAST) & (F.contains("t", F.col("q")) | F.contains("q", F.col("t")))
    share = F.least(F.length("q"), F.length("t")) / F.greatest(F.length("q"), F.length("t"))
    by_quote = pairs.where(holds).groupBy("id").agg(F.min(F.struct((-share).alias("s"), "n", "pos", "path")).alias("m")).select("id", "m.path", F.lit("quote").alias("how"))
    number = lambda c: F.regexp_extract(c, SECTION_NUMBER, 1)
    numbered = paragraphs.where("heading").withColumn("number", number(F.col("text"))).where("number <> ''").groupBy("doc", "number").agg(F.max_by("path", "pos").alias("path"))
    asked = sidecars.select("id", "doc", F.posexplode(F.concat("topics", "locators")).alias("n", "v")).select("id", "doc", "n", F.posexplode(F.regexp_extract_all("v", F.lit(SECTION_NUMBER), F.lit(1))).alias("k", "number"))
    by_number = asked.join(numbered, ["doc", "number"]).groupBy("id").agg(F.min(F.struct("n", "k", "path")).alias("m")).select("id", "m.path", F.lit("section_number").alias("how"))
    by_number = by_number.join(by_quote.select("id"), "id", "left_anti")
    found = by_quote.unionByName(by_number)
    longer = F.greatest(F.length("q"), F.length("t"))
    near = pairs.join(found.select("id"), "id", "left_anti").where(2 * F.least(F.length("q"), F.length("t")) >= ALIKE * (longer + F.least(F.length("q"), F.length("t"))))
    alike = near.withColumn("r", sequence_ratio("q", "t")).where(F.col("r") >= ALIKE).groupBy("id").agg(F.min(F.struct((-F.col("r")).alias("r"), "n", "pos", "path")).alias("m")).select("id", "m.path", F.lit("fuzzy_quote").alias("how"))
    found = scratch.save(found.unionByName(alike))
    kept = sidecars.join(found.select("id"), "id", "left_anti").select("id", F.filter("topics", lambda t: ~F.trim(t).rlike(MECHANICAL)).alias("path"))
    return found.unionByName(kept.select("id", "path", F.when(F.size("path") > 0, "retained").otherwise("unresolved").alias("how")))


def evidence_order(quotes: Column, path: Column, text: Column, temp_id: Column) -> Column:
    """Where evidence stands in a text, times 1000, plus the number at the end of its temporary id.

    The least place of a quote, found by its first fragment of sixteen characters or more that stands there; else that of the
    deepest heading of the path; else beyond any text.
    """
    low = F.lower(text)
    pieces = F.transform(quotes, lambda q: F.filter(F.transform(F.split(F.lower(q), r"\.{3}|…", -1), lambda p: F.regexp_replace(p, r"^[ .…]+|[ .…]+$", "")), lambda p: F.length(p) >= FRAGMENT_LEAST))
    at = F.transform(pieces, lambda ps: F.get(F.filter(F.transform(ps, lambda p: F.instr(low, p)), lambda i: i > 0), F.lit(0)))
    by_quote = F.array_min(F.filter(at, lambda i: i.isNotNull())) - 1
    by_head = F.get(F.filter(F.transform(F.reverse(path), lambda h: F.instr(low, F.lower(h))), lambda i: i > 0), F.lit(0)) - 1
    place = F.coalesce(by_quote.cast("long"), by_head.cast("long"), F.lit(NOWHERE))
    return place * 1000 + F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(temp_id, r"(\d+)$", 1), F.lit("")), F.lit("999999")).cast("long"), F.lit(0))


def is_mechanical(part: str) -> bool:
    return re.match(MECHANICAL, part.strip()) is not None
