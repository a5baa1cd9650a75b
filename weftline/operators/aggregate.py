"""Corpus reports: shapes, utilisation, inequality, status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Thresholds of the shape rules.
SPARSE_EDGES_PER_NODE, SPINE_SEQ_RATIO, SPINE_MAX_EDGES_PER_NODE = 0.5, 0.4, 1.5
FLAT_MAX_NODES, HIGHWAY_MIN_EDGES_PER_NODE, HIGHWAY_MAX_SEQ_RATIO = 60, 1.2, 0.35


def shape(nodes: Column, edges: Column, ratio: Column) -> Column:
    """sparse, spine, flat or highway, by the first rule that holds."""
    per = edges / F.greatest(nodes, F.lit(1))
    return (
        F.when((nodes == 0) | (per < SPARSE_EDGES_PER_NODE), "sparse")
        .when((ratio >= SPINE_SEQ_RATIO) & (per <= SPINE_MAX_EDGES_PER_NODE), "spine")
        .when((nodes <= FLAT_MAX_NODES) & (ratio < SPINE_SEQ_RATIO), "flat")
        .when((per >= HIGHWAY_MIN_EDGES_PER_NODE) | (ratio <= HIGHWAY_MAX_SEQ_RATIO), "highway")
        .otherwise("flat")
    )


def shapes(nodes: DataFrame, edges: DataFrame, scope: str = "collection") -> DataFrame:
    """Shape report of each scope and, with a null scope, of all: (scope, nodes, edges, edges_per_node, seq_ratio, shape)."""
    n = nodes.groupingSets([[scope], []], scope).agg(F.count("*").alias("nodes"), F.grouping(scope).alias("g"))
    e = edges.groupingSets([[scope], []], scope).agg(F.count("*").alias("edges"), F.count_if(F.col("type") == "SEQUENCE").alias("seq"), F.grouping(scope).alias("g"))
    both = n.join(e, n[scope].eqNullSafe(e[scope]) & (n["g"] == e["g"]), "left").select(
        n[scope].alias("scope"), "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("seq", F.lit(0)).alias("seq")
    )
    ratio = F.col("seq") / F.greatest("edges", F.lit(1))
    return both.select(
        "scope", "nodes", "edges", F.round(F.col("edges") / F.greatest("nodes", F.lit(1)), 3).alias("edges_per_node"), F.round(ratio, 3).alias("seq_ratio"),
        shape(F.col("nodes"), F.col("edges"), ratio).alias("shape"),
    )


def gini(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Gini coefficient of a value within each group; 0 if the values sum to 0.

    Rows of one value are counted first, so that a window ranks the different values of a group and not its rows.
    """
    v, c = F.col("__v"), F.col("__c")
    counted = df.groupBy(*group, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum(c).over(W.partitionBy(*group).orderBy(v).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.withColumn("__ranks", v * (c * before + c * (c + 1) / 2))  # the ranks of equal rows, summed
    n, total = F.sum(c), F.sum(v * c)
    g = 2 * F.sum("__ranks") / (n * total) - (n + 1) / n
    return ranked.groupBy(*group).agg(F.when(total == 0, 0.0).otherwise(g).alias("gini"))


def utilisation(nodes: DataFrame, hits: DataFrame, hot: int = 8) -> tuple[DataFrame, DataFrame]:
    """Fired and dead nodes by collection and type with subtotals, and the ``hot`` most used with their share.

    ``hits(id, hits, last_turn)`` has a row for each node that fired.
    """
    all_ = nodes.join(hits, "id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    fired = F.count_if(F.col("hits") > 0)
    table = all_.rollup("collection", "type").agg(F.count("*").alias("n"), fired.alias("fired"), F.round(100 * fired / F.count("*"), 1).alias("fired_pct"), F.sum("hits").alias("hits"))
    top = all_.where("hits > 0").orderBy(F.desc("hits"), "id").limit(hot)
    total = all_.agg(F.sum("hits").alias("total"))
    return table, top.crossJoin(F.broadcast(total)).select("id", "collection", "hits", F.round(100 * F.col("hits") / F.col("total"), 2).alias("share_pct"))  # one row


def average_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, nodes, avg_degree): distinct neighbours in either direction, nodes without edges counting 0."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.where("src <> dst").distinct().groupBy("src").agg(F.count("*").alias("d"))
    return nodes.join(degree, nodes["id"] == degree["src"], "left").groupBy("type").agg(F.count("*").alias("nodes"), F.avg(F.coalesce("d", F.lit(0))).alias("avg_degree"))


def topic_scores(texts: DataFrame, banks: dict[str, list[str]]) -> DataFrame:
    """(id, topic, score) of the best topic: keywords found over keywords in the bank; ties to the first bank, none at 0."""
    low = F.lower("text")
    scored = [
        F.struct((sum((F.contains(low, F.lit(k)).cast("int") for k in words), F.lit(0)) / len(words)).alias("score"), F.lit(-i).alias("place"), F.lit(topic).alias("topic"))
        for i, (topic, words) in enumerate(banks.items())
    ]
    best = F.array_max(F.array(*scored))
    return texts.select("id", best.alias("b")).select("id", F.when(F.col("b.score") > 0, F.col("b.topic")).otherwise("").alias("topic"), F.col("b.score").alias("score"))


def cluster_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n): edges between different clusters of ``members(id, cluster)``, by unordered pair."""
    s = members.select(F.col("id").alias("src"), F.col("cluster").alias("ca"))
    d = members.select(F.col("id").alias("dst"), F.col("cluster").alias("cb"))
    pairs = edges.select("src", "dst").join(s, "src").join(d, "dst").where("ca <> cb")
    return pairs.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("n"))
