"""Smaller queries of every family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query
GRAPH = f"{NODES_SQL}, {EDGES_SQL}"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


@query(f"WITH {GRAPH} SELECT id, type, coalesce(nullif(label, ''), id) AS name, CAST(0.85 AS DOUBLE) AS confidence FROM nodes")
def prj05_selected_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).select("id", "type", T.first_of(F.col("label"), F.col("id")).alias("name"), F.lit(0.85).alias("confidence"))



@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, least(1, greatest(0, coalesce(nullif(value / 100, 0), 0.5))) AS confidence FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 30")
def prj24_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Raw answers read by a schema, filtered and clamped."""
    k = F.from_json("props", "k int")["k"]
    conf = T.clamp01(F.coalesce(F.nullif(F.col("value") / 100, F.lit(0.0)), F.lit(0.5)))
    return table(spark, sf, "events").select("event_id", k.alias("k"), conf.alias("confidence")).where("k >= 30")


@query("""WITH h AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, source, doc_id % 4 AS level FROM documents) SELECT source, doc_id, max(CASE WHEN level = 0 THEN doc_id END) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM h""")
def win16_heading_stack(spark: SparkSession, sf: str) -> DataFrame:
    """The last shallower heading before each row."""
    before = W.partitionBy("source").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    return _docs(spark, sf).select("source", "doc_id", F.max(F.when(F.col("doc_id") % 4 == 0, F.col("doc_id"))).over(before).alias("parent"))


@query(f"""WITH {GRAPH}, s AS (SELECT dst AS id, weight FROM edges WHERE src = 'n3' UNION ALL SELECT src, weight FROM edges WHERE dst = 'n3') SELECT id, max(weight) AS weight FROM s GROUP BY id ORDER BY weight DESC, id LIMIT 12""")
def top15_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    near = e.where("src = 'n3'").select(F.col("dst").alias("id"), "weight").unionByName(e.where("dst = 'n3'").select(F.col("src").alias("id"), "weight"))
    return near.groupBy("id").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "id").limit(12)


@query(f"""WITH {GRAPH}, m AS (SELECT a.collection AS home, b.collection AS target, count(*) AS n FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.collection <> b.collection GROUP BY ALL) SELECT home, target, least(1, n / CAST(5 AS DOUBLE)) AS weight FROM m""")
def grf28_pillar_edges(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    m = edges(spark, sf).join(n.select(F.col("id").alias("src"), F.col("collection").alias("home")), "src").join(n.select(F.col("id").alias("dst"), F.col("collection").alias("target")), "dst").where("home <> target")
    return m.groupBy("home", "target").agg(F.least(F.lit(1.0), F.count("*") / 5).alias("weight"))


@query("SELECT doc_id, trim(regexp_replace(string_split(text, chr(10))[1], '^#{1,6}[ \\t]+|[ \\t]*#*[ \\t]*$', '', 'g')) AS heading FROM documents")
def sca11_markup(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.heading_text(F.split("text", "\n", -1)[0]).alias("heading"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, '. '), 1, 2), '; ') AS label FROM documents")
def sca17_bundle_label(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(F.slice(F.split("text", r"\. ", -1), 1, 2), "; ").alias("label"))


@query("WITH c AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 300 THEN 'rigor_work' ELSE 'object_of_work' END AS f FROM conversations) SELECT c.conv_id, c.turn, coalesce(f, 'unknown') AS function, coalesce(l.quality, -1) AS drift FROM c LEFT JOIN labels l ON l.doc_id = c.conv_id * 10 + c.turn")
def str05_joined_record(spark: SparkSession, sf: str) -> DataFrame:
    """Classification and drift of a turn in one record, with a default where one is missing."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.length("text") > 300, "rigor_work").otherwise("object_of_work").alias("function"), (F.col("conv_id") * 10 + F.col("turn")).alias("doc_id"))
    return c.join(table(spark, sf, "labels"), "doc_id", "left").select("conv_id", "turn", "function", F.coalesce("quality", F.lit(-1)).alias("drift"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' UNION SELECT conv_id FROM conversations WHERE role = 'system'")
def lif05_holders(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "events").where("event_type = 'signup'").select("user_id")
    return a.union(table(spark, sf, "conversations").where("role = 'system'").select(F.col("conv_id").alias("user_id"))).distinct()
