"""The typed graph that the table queries run on, made from the relational tables.

Regions are bundles, nations and suppliers slabs, customers anchors; ids carry a letter and the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.sources.tables import table


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, type, collection, label, ord)."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    kind = lambda x: F.lit(x).alias("type")
    parts = [
        table(spark, sf, "region").select(key("r", "r_regionkey"), kind("bundle"), F.lit("geo").alias("collection"), F.col("r_name").alias("label"), F.col("r_regionkey").cast("long").alias("ord")),
        table(spark, sf, "nation").select(key("n", "n_nationkey"), kind("slab"), F.lit("geo").alias("collection"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("long").alias("ord")),
        table(spark, sf, "supplier").select(key("s", "s_suppkey"), kind("slab"), F.lit("supply").alias("collection"), F.col("s_name").alias("label"), F.col("s_suppkey").cast("long").alias("ord")),
        table(spark, sf, "customer").select(key("c", "c_custkey"), kind("anchor"), F.lower("c_mktsegment").alias("collection"), F.col("c_name").alias("label"), F.col("c_custkey").cast("long").alias("ord")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(type, src, dst, weight, confidence, collection)."""
    c, s, n = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    at = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    seg = F.lower("c_mktsegment")

    def part(df: DataFrame, kind: str, src, dst, weight, confidence: float, collection) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), weight.cast("double").alias("weight"), F.lit(confidence).alias("confidence"), collection.alias("collection"))

    after = c.withColumn("nxt", F.lead("c_custkey").over(W.partitionBy("c_nationkey").orderBy("c_custkey"))).where("nxt is not null")
    other = n.select((F.col("n_nationkey") - 10).alias("k"), F.col("n_nationkey").alias("m"))
    parts = [
        part(c, "PARENT_OF", at("n", "c_nationkey"), at("c", "c_custkey"), F.lit(0.5) + (F.col("c_custkey") % 5) / 10, 1.0, seg),
        part(n, "SUPPORTS", at("r", "n_regionkey"), at("n", "n_nationkey"), F.lit(1.0), 0.9, F.lit("geo")),
        part(s, "LINKS", at("s", "s_suppkey"), at("n", "s_nationkey"), (F.col("s_suppkey") % 4) / 4, 0.8, F.lit("supply")),
        part(after, "SEQUENCE", at("c", "c_custkey"), at("c", "nxt"), F.lit(0.98), 0.98, seg),
        part(s.join(c, F.col("s_suppkey") == F.col("c_custkey")).where("s_suppkey % 7 = 0"), "CONFLICTS", at("s", "s_suppkey"), at("c", "c_custkey"), F.lit(0.3), 1.0, F.lit("supply")),
        part(c.join(s, F.col("s_suppkey") == F.col("c_custkey") % 10), "INVOKES", at("c", "c_custkey"), at("s", "s_suppkey"), F.lit(0.9), 1.0, seg),
        part(n.join(other, F.col("n_nationkey") == F.col("k")), "TENSIONS", at("n", "n_nationkey"), at("n", "m"), F.lit(0.6), 1.0, F.lit("geo")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES_SQL = """nodes AS (
  SELECT 'r' || r_regionkey AS id, 'bundle' AS type, 'geo' AS collection, r_name AS label, CAST(r_regionkey AS BIGINT) AS ord FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'slab', 'geo', n_name, CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'slab', 'supply', s_name, CAST(s_suppkey AS BIGINT) FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'anchor', lower(c_mktsegment), c_name, CAST(c_custkey AS BIGINT) FROM customer)"""

EDGES_SQL = """edges AS (
  SELECT 'PARENT_OF' AS type, 'n' || c_nationkey AS src, 'c' || c_custkey AS dst, CAST(0.5 AS DOUBLE) + CAST(c_custkey % 5 AS DOUBLE) / 10 AS weight, CAST(1.0 AS DOUBLE) AS confidence, lower(c_mktsegment) AS collection FROM customer
  UNION ALL SELECT 'SUPPORTS', 'r' || n_regionkey, 'n' || n_nationkey, 1.0, 0.9, 'geo' FROM nation
  UNION ALL SELECT 'LINKS', 's' || s_suppkey, 'n' || s_nationkey, CAST(s_suppkey % 4 AS DOUBLE) / 4, 0.8, 'supply' FROM supplier
  UNION ALL SELECT 'SEQUENCE', 'c' || c_custkey, 'c' || nxt, 0.98, 0.98, lower(c_mktsegment) FROM (SELECT *, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nxt FROM customer) WHERE nxt IS NOT NULL
  UNION ALL SELECT 'CONFLICTS', 's' || s_suppkey, 'c' || c_custkey, 0.3, 1.0, 'supply' FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_suppkey % 7 = 0
  UNION ALL SELECT 'INVOKES', 'c' || c_custkey, 's' || s_suppkey, 0.9, 1.0, lower(c_mktsegment) FROM customer JOIN supplier ON s_suppkey = c_custkey % 10
  UNION ALL SELECT 'TENSIONS', 'n' || a.n_nationkey, 'n' || b.n_nationkey, 0.6, 1.0, 'geo' FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 10)"""
