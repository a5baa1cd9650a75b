"""Hybrid ranking, tiered selection, deduplication by meaning, clusters and frames of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.operators import graph as G
from weftline.operators.neighbours import nearest_in_blocks
from weftline.session import Scratch

GATE, PPR_WEIGHT, RANK_WEIGHT = 0.55, 0.5, 0.3


def hybrid_rank(similar: DataFrame, personal: DataFrame, general: DataFrame, k: int, gate: float = GATE) -> DataFrame:
    """(id, score): similarity of at least ``gate`` plus half the personalised and 0.3 of the general rank, each over its maximum."""
    p = G.peak_normalised(personal).select("id", F.col("score").alias("ppr"))
    g = G.peak_normalised(general).select("id", F.col("score").alias("rank"))
    out = similar.where(F.col("similarity") >= gate).join(p, "id", "left").join(g, "id", "left")
    score = F.col("similarity") + PPR_WEIGHT * F.coalesce("ppr", F.lit(0.0)) + RANK_WEIGHT * F.coalesce("rank", F.lit(0.0))
    return out.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def divergent(similar: DataFrame, selected: DataFrame, confidence: DataFrame, k: int = 6) -> DataFrame:
    """Near rows (0.55) of high confidence (0.80) that were not selected, the k nearest."""
    rest = similar.join(selected.select("id"), "id", "left_anti").join(confidence, "id").where("similarity >= 0.55 AND confidence >= 0.80")
    return rest.select("id", "similarity").orderBy(F.desc("similarity"), "id").limit(k)


def selection(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, supported: list[str], structural: list[str]) -> DataFrame:
    """(id, tier, hop) of a synthesis: seeds are tier 0, a hop over supporting types 1, up to two over structural ones 2, conflicting ends 3.

    A node stands in its first tier.
    """
    zero = seeds.select("id", F.lit(0).alias("tier"), F.lit(0).alias("hop"))
    one = G.typed_walk(edges, seeds, supported, 1).where("hop > 0").select("id", F.lit(1).alias("tier"), "hop")
    two = G.typed_walk(edges, seeds, structural, 2).where("hop > 0").select("id", F.lit(2).alias("tier"), "hop")
    near = zero.unionByName(one).unionByName(two)
    three = G.conflicts(edges, near.select("id")).select("id", F.lit(3).alias("tier"), F.lit(1).alias("hop"))
    best = near.unionByName(three).groupBy("id").agg(F.min(F.struct("tier", "hop")).alias("b"))
    return best.join(nodes.select("id"), "id", "left_semi").select("id", "b.tier", "b.hop")


def already_held(drafts: DataFrame, corpus: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(id, held_by): the corpus row that a draft repeats: an equal label, else the nearest vector above the threshold.

    ``drafts(id, label, v, block)`` meet ``corpus(id, label, v, block)`` on equal labels, and for vectors on
    equal blocks only, so that no draft meets the whole corpus.
    """
    key = T.label_key(F.col("label")).alias("key")
    exact = drafts.select("id", key).join(corpus.select(F.col("id").alias("held_by"), key), "key").groupBy("id").agg(F.min("held_by").alias("held_by"))
    near = nearest_in_blocks(drafts.join(exact, "id", "left_anti"), corpus, 1, threshold, strict=True)
    return exact.unionByName(near.select(F.col("query_id").alias("id"), F.col("id").alias("held_by")))


def cosine_kmeans(vectors: DataFrame, k: int, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(id, cluster, similarity): k-means by cosine; the first centres are the k rows of least hash.

    A round is one pass with k centres broadcast, of fixed size; sums are taken by position before they
    are gathered. A cluster that loses all rows keeps its centre.
    """
    scratch = Scratch(vectors.sparkSession)
    unit = scratch.save(vectors.select("id", V.normalised(F.col("v")).alias("v")))
    first = unit.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).withColumn("cluster", F.row_number().over(W.orderBy(F.xxhash64("id", F.lit(seed)), "id")) - 1)
    centres = scratch.save(first.select("cluster", F.col("v").alias("c")))

    def assigned(centres: DataFrame) -> DataFrame:
        sims = unit.crossJoin(F.broadcast(centres)).select("id", "v", F.struct(V.dot(F.col("v"), F.col("c")).alias("s"), (-F.col("cluster")).alias("n")).alias("m"))  # k rows
        return sims.groupBy("id").agg(F.max("m").alias("m"), F.first("v").alias("v")).select("id", "v", (-F.col("m.n")).alias("cluster"), F.col("m.s").alias("similarity"))

    for _ in range(rounds):
        sums = assigned(centres).select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
        means = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
        nxt = centres.join(means, "cluster", "left").select("cluster", F.coalesce(V.normalised(F.col("m")), F.col("c")).alias("c"))
        nxt = scratch.save(nxt)
        same = nxt.join(centres.withColumnRenamed("c", "old"), "cluster").where(V.dot(F.col("c"), F.col("old")) < 1 - 1e-9).isEmpty()
        centres = nxt
        if same:
            break
    return assigned(centres).select("id", "cluster", "similarity")


def medoids(clusters: DataFrame) -> DataFrame:
    """(cluster, id, size): the member nearest to each centre."""
    return clusters.groupBy("cluster").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "id")).alias("m"), F.count("*").alias("size")).select("cluster", "m.id", "size")


def frame_turn(frame: DataFrame, hits: DataFrame, edges: DataFrame, top: int = 24) -> DataFrame:
    """One turn of a session's frame ``(session, id, weight, smoothed)``: decay, activation, smoothing, eviction.

    Weights decay to at least 0.10; ``hits(session, id, weight)`` and what they pass on along INVOKES edges are merged by
    the greatest; salience now is the weight hit in this turn, or 0.9 of the smoothed one; the ``top`` smoothed stay.
    """
    pairs = G.cascade_strength(edges.where("type = 'INVOKES'").select("src", "dst").distinct(), edges, 0.5)
    passed = hits.join(pairs, hits["id"] == pairs["src"]).select("session", F.col("dst").alias("id"), (F.col("weight") * F.col("strength")).alias("weight"))
    live = hits.select("session", "id", "weight").unionByName(passed).groupBy("session", "id").agg(F.max("weight").alias("now"))
    old = frame.select("session", "id", F.greatest(F.lit(0.10), F.col("weight") * 0.85).alias("old"), F.col("smoothed").alias("before"))
    both = old.join(live, ["session", "id"], "full")
    now = F.coalesce("now", F.col("before") * 0.9)
    out = both.select("session", "id", F.greatest("old", "now").alias("weight"), F.when(F.col("before").isNull(), now).otherwise(0.3 * now + 0.7 * F.col("before")).alias("smoothed"))
    rank = F.row_number().over(W.partitionBy("session").orderBy(F.desc("smoothed"), "id"))
    return out.withColumn("k", rank).where(F.col("k") <= top).drop("k")


def superseding(verdicts: DataFrame, drafts: DataFrame, least: float = 0.4) -> DataFrame:
    """(id, by): of the drafts of a session raised at or after a draft's reference turn, the most similar one at ``least`` or more."""
    rows = lambda df, at: df.select("id", F.col("session").alias("block"), F.col(at).alias("at"), "v")
    near = nearest_in_blocks(rows(verdicts, "reference_turn"), rows(drafts, "raised"), 1, least, others=True)
    return near.select(F.col("query_id").alias("id"), F.col("id").alias("by"))
