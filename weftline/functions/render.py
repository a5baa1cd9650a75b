"""Texts made of result sets: summary lines, blocks of a prompt, and a synthesis prompt by the role of its nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lengths of excerpts, and how many nodes, conflicts and points a block has.
SUMMARY_CHARS, GROUPING_CHARS, NODE_CHARS, PARTNER_CHARS = 160, 80, 600, 180
FRAME_NODES, FRAME_CONFLICTS, FRICTION_POINTS = 24, 8, 3
#: Sections of a synthesis prompt in their order, with the heading of each.
SECTIONS = (
    ("seed", "=== DIRECT MATCHES ==="),
    ("conflict", "=== DIRECT OPPOSITION: name both sides ==="),
    ("tension", "=== PRODUCTIVE TENSION: both sides hold ==="),
    ("supported", "=== SUPPORTING DETAIL ==="),
    ("support2", "=== ADDITIONAL SUPPORT ==="),
    ("divergent", "=== ADJACENT, NOT CONNECTED ==="),
)


def _plain(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def summary_item(title: Column, description: Column, text: Column) -> Column:
    """``title: tail``, the tail being the description, or else the first 160 characters of the text."""
    tail = F.when(_plain(description) != "", F.trim(description)).otherwise(F.substring(F.coalesce(text, F.lit("")), 1, SUMMARY_CHARS))
    return F.concat(F.coalesce(title, F.lit("")), F.lit(": "), tail)


def grouping_line(ident: Column, title: Column, text: Column, chars: int = GROUPING_CHARS) -> Column:
    """A slab as one line of a grouping prompt, its line breaks as blanks."""
    excerpt = F.substring(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), 1, chars)
    return F.concat(F.lit("- id="), ident, F.lit(" | title: "), F.coalesce(title, F.lit("")), F.lit(" | text: "), excerpt)


def cut(text: Column, chars: int) -> Column:
    """A text, or its first characters and an ellipsis."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def node_line(kind: Column, text: Column) -> Column:
    return F.concat(F.lit("  ["), kind, F.lit("] "), cut(_plain(text), NODE_CHARS))


def joined(rows: DataFrame, keys: list[str], order: list[str], line: str, between: str = "\n") -> DataFrame:
    """(keys, text): the lines of each key in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, line)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x[line]), between).alias("text"))


def synthesis_prompt(nodes: DataFrame, partners: DataFrame) -> DataFrame:
    """(query, text) of ``nodes(query, section, place, id, type, text, conflicts_with, why)``: the sections that have nodes, in their order.

    A conflicting node names its partner by the text in ``partners(id, text)``, or by id, and why they conflict.
    """
    own = nodes.join(partners.select(F.col("id").alias("conflicts_with"), _plain(F.col("text")).alias("partner")), "conflicts_with", "left")
    against = F.when(F.coalesce("partner", F.lit("")) != "", cut(F.col("partner"), PARTNER_CHARS)).otherwise(F.col("conflicts_with"))
    told = F.when((F.col("section") == "conflict") & F.col("conflicts_with").isNotNull(), F.concat(F.lit("\n      [in opposition to: "), against, F.lit("]"))).otherwise("")
    why = F.when(F.col("section").isin("conflict", "tension") & (_plain(F.col("why")) != ""), F.concat(F.lit("\n      [why: "), F.trim("why"), F.lit("]"))).otherwise("")
    lines = own.withColumn("line", F.concat(node_line(F.col("type"), F.col("text")), told, why))
    body = joined(lines, ["query", "section"], ["place"], "line")
    place = F.lit(None).cast("int")
    heading = F.lit(None).cast("string")
    for n, (name, text) in enumerate(SECTIONS):
        place, heading = F.when(F.col("section") == name, n).otherwise(place), F.when(F.col("section") == name, text).otherwise(heading)
    blocks = body.select("query", place.alias("n"), F.concat(heading, F.lit("\n\n"), "text").alias("block")).where("n is not null")
    return joined(blocks, ["query"], ["n"], "block", "\n\n")


def system_prompt(parts: list[Column]) -> Column:
    """The parts that are there, in their order, a blank line apart."""
    some = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(some, "\n\n")


def frame_block(nodes: Column, conflicts: Column, mismatch: Column) -> Column:
    """A frame from ordered arrays of struct(id, salience) and struct(a, b, tension): 24 nodes and 8 conflicts at most."""
    two = lambda x: F.format_string("%.2f", x.cast("double"))
    node = F.transform(F.slice(nodes, 1, FRAME_NODES), lambda n: F.concat(F.lit("  "), n["id"], F.lit(": salience="), two(F.coalesce(n["salience"], F.lit(0.0)))))
    pair = F.transform(F.slice(conflicts, 1, FRAME_CONFLICTS), lambda c: F.concat(F.lit("  "), c["a"], F.lit(" <-> "), c["b"], F.lit(": tension="), two(c["tension"])))
    some = F.when(F.size(pair) > 0, F.concat(F.array(F.lit("conflicts:")), pair)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.lit("[ACTIVE FRAME]")), node, some, F.array(F.concat(F.lit("mismatch_score: "), two(mismatch)), F.lit("[/ACTIVE FRAME]")))
    return F.array_join(lines, "\n")


def friction_block(fired: Column, verdict: Column, claim: Column, alternatives: Column, breaks: Column, conflicts: Column, note: Column) -> Column:
    """What a fired challenge has to say, three points of each kind at most; empty where none fired or the claim passed."""
    none = F.array().cast("array<string>")

    def points(title: str, items: Column) -> Column:
        some = F.filter(F.coalesce(items, none), lambda x: F.coalesce(x, F.lit("")) != "")
        return F.when(F.size(some) > 0, F.concat(F.array(F.lit(title)), F.transform(F.slice(some, 1, FRICTION_POINTS), lambda x: F.concat(F.lit("  - "), x)))).otherwise(none)

    one = lambda title, text: F.when(_plain(text) != "", F.array(F.concat(F.lit(title), text))).otherwise(none)
    lines = F.concat(
        F.array(F.lit("[GAUNTLET]")), one("Claim: ", claim), points("Alternatives:", alternatives), points("Would break if:", breaks), points("Corpus conflicts:", conflicts), one(">> ", note),
        F.array(F.concat(F.lit("Verdict: "), verdict), F.lit("[/GAUNTLET]")),
    )
    return F.when(F.coalesce(fired, F.lit(False)) & (verdict != "passed"), F.array_join(lines, "\n")).otherwise("")
