"""Activation of invariant slabs in a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weight of a linked anchor, mismatch, words of slabs that answer to it, and the cascade's strength without an edge.
LINKED_LEAST, MISMATCH, PUSHBACK, FALLBACK = 0.8, 0.6, ("pushback", "gauntlet"), 0.8


def invariants(slabs: DataFrame, frame: DataFrame, fired: DataFrame, invokes: DataFrame, links: DataFrame, mismatch: float) -> DataFrame:
    """(id, rule, ref) of the invariant ``slabs(id)`` that a turn activates, by the first rule that holds.

    ``frame(id, weight)`` is active already, ``fired(id, place)`` are the handles matched this turn, ``invokes(anchor, target)`` and
    ``links(slab, n, target)`` the references of anchors and slabs. The rules: a fired handle invokes the slab; a linked anchor weighs .8 or
    more; the mismatch is above .6 and the slab is one for pushback.
    """
    idle = slabs.select("id").distinct().join(frame.select("id"), "id", "left_anti")
    called = fired.join(invokes, F.col("id") == F.col("anchor")).groupBy(F.col("target").alias("id")).agg(F.min_by("anchor", "place").alias("by_match"))
    heavy = frame.where(F.col("weight") >= LINKED_LEAST).select(F.col("id").alias("target"))
    linked = links.join(heavy, "target", "left_semi").groupBy(F.col("slab").alias("id")).agg(F.min_by("target", "n").alias("by_link"))
    low = F.lower("id")
    tense = F.lit(mismatch > MISMATCH) & (F.contains(low, F.lit(PUSHBACK[0])) | F.contains(low, F.lit(PUSHBACK[1])))
    found = idle.join(called, "id", "left").join(linked, "id", "left")
    rule = F.when(F.col("by_match").isNotNull(), "anchor_invokes").when(F.col("by_link").isNotNull(), "linked_anchor_active").when(tense, "mismatch_escalation")
    return found.select("id", rule.alias("rule"), F.coalesce("by_match", "by_link").alias("ref")).where("rule is not null")


def invariant_cascade(activated: DataFrame, frame: DataFrame, links: DataFrame, bundles: DataFrame, invokes: DataFrame, strengths: DataFrame) -> DataFrame:
    """(id, weight): bundles that activated slabs bring along and the frame does not hold, with the first slab's strength.

    A slab brings its linked bundles; one that a linked anchor activated only those that this anchor invokes as well.
    ``strengths(src, dst, strength)`` of pairs without an edge are .8.
    """
    reach = activated.join(links, F.col("id") == F.col("slab")).join(bundles.select(F.col("id").alias("target")), "target", "left_semi")
    narrow = reach.where("rule = 'linked_anchor_active'").join(invokes.select(F.col("anchor").alias("ref"), "target"), ["ref", "target"], "left_semi")
    wide = reach.where("rule <> 'linked_anchor_active'")
    own = wide.select("slab", "target").unionByName(narrow.select("slab", "target")).distinct()
    weighed = own.join(strengths, (F.col("slab") == F.col("src")) & (F.col("target") == F.col("dst")), "left").withColumn("weight", F.coalesce("strength", F.lit(FALLBACK)))
    return weighed.groupBy(F.col("target").alias("id")).agg(F.min_by("weight", "slab").alias("weight")).join(frame.select("id"), "id", "left_anti")
