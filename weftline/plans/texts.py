"""Queries of parsers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import segment as G
from weftline.plans.registry import Registry
from weftline.plans.sequences import _DRIFT, signals
from weftline.session import scratch_root, ship
from weftline.sources import conversations as C
from weftline.sources.tables import table
from weftline.streaming import sessions as S

registry = Registry()
query = registry.query


def _transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, raw): each conversation written as a transcript with role labels."""
    label = F.when(F.col("role") == "assistant", "Assistant").otherwise("User")
    line = F.concat(F.lit("\n"), label, F.lit(": "), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.concat_ws("", F.transform(ordered, lambda x: x["line"])).alias("raw"))


@query("""SELECT conv_id, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS "index", length(trim(text, ' ' || chr(10))) AS chars FROM conversations WHERE trim(text) <> ''""")
def src18_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts read back into their messages."""
    ship(spark)
    out = C.normalised(_transcripts(spark, sf))
    return out.select("conv_id", "role", "index", F.length("content").cast("long").alias("chars"))


@query("SELECT conv_id, 'chat_json' AS kind, count(*) AS messages FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def src15_export(spark: SparkSession, sf: str) -> DataFrame:
    """Exports of message arrays read back."""
    ship(spark)
    m = table(spark, sf, "conversations").where("role <> 'system'")
    sender = F.when(F.col("role") == "user", "human").otherwise("assistant")
    msgs = F.transform(F.array_sort(F.collect_list(F.struct("turn", sender.alias("sender"), "text"))), lambda x: F.struct(x["sender"].alias("sender"), x["text"].alias("text")))
    raws = m.groupBy("conv_id").agg(F.to_json(F.struct(msgs.alias("chat_messages"))).alias("raw"))
    return C.normalised(raws).groupBy("conv_id").agg(F.lit("chat_json").alias("kind"), F.count("*").alias("messages"))


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)")
def src10_tail(spark: SparkSession, sf: str) -> DataFrame:
    return C.event_tail(table(spark, sf, "events"), 50, [F.col("ts"), F.col("event_id")]).select("event_id", "event_type")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def src23_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and links scraped from pages."""
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(h, F.lit("<a href=")).cast("long").alias("links"))


@query()
def prj10_segments(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    out = G.segmented(table(spark, sf, "documents").select("doc_id", "text"), 2000)
    return out.select("doc_id", "segment", F.length("part").cast("long").alias("chars"))


@query()
def prj11_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines of documents whose every third line is made a heading."""
    ship(spark)
    line = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), 1 + (i / 3).cast("int") % 3), F.lit(" "), F.substring(x, 1, 30))).otherwise(x))
    return G.outlined(table(spark, sf, "documents").select("doc_id", F.array_join(line, "\n").alias("text")))


@query()
def sca10_spans(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return G.spanned(table(spark, sf, "documents").select("doc_id", "text")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(_DRIFT + """ SELECT session, turn, round(composite + 1e-12::DOUBLE, 6) AS composite, CASE WHEN composite <= CASE mode WHEN 'internal' THEN 0.54 ELSE 0.39 END THEN 'low' WHEN composite <= CASE mode WHEN 'internal' THEN 0.79 ELSE 0.69 END THEN 'medium' ELSE 'high' END AS severity FROM c""")
def str01_drift_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The drift assessments once more, from a file stream with a state for each session."""
    ship(spark)
    base = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    signals(table(spark, sf, "events")).repartition(1).sortWithinPartitions("turn").write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    stream = S.drift_stream(spark.readStream.schema(schema).parquet(f"{base}/in"))
    out = S.run_to_table(stream, spark, f"{base}/out", f"{base}/check")
    return out.select("session", "turn", F.round(F.col("composite") + 1e-12, 6).alias("composite"), "severity")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def str04_event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended by a stream, a folder for each topic, and read again."""
    base = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    e.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{base}/in")
    S.append_log(stream, f"{base}/out", f"{base}/check", "event_type").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH w AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) SELECT user_id, event_type, event_id AS promoted_at FROM w WHERE k = 3""")
def str06_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """The turn at which a concept is mentioned the third time."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    return table(spark, sf, "events").withColumn("k", k).where("k = 3").select("user_id", "event_type", F.col("event_id").alias("promoted_at"))
