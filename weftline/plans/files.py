"""Queries of session files, chats, logs, caches and registries, written from the tables and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import Registry
from weftline.session import scratch_root
from weftline.sources import sessions as S
from weftline.sources.tables import table

registry = Registry()
query = registry.query
_DRAFT = "id string, chat_id string, phrase string, title string, label string, text string"


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/files-{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf: str) -> str:
    """Drafts of two sessions: suppliers, and those with an even key once more, later."""
    path = _folder(spark)
    s = table(spark, sf, "supplier")
    ident = F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("id")
    chat = F.concat(F.lit("chat"), (F.col("s_nationkey") % 3).cast("string")).alias("chat_id")
    s.select(ident, chat, F.lit("old").alias("phrase")).coalesce(1).write.json(f"{path}/session=a")
    s.where("s_suppkey % 2 = 0").select(ident, chat, F.lit("new").alias("phrase")).coalesce(1).write.json(f"{path}/session=b")
    return path


@query("SELECT 'd' || s_suppkey AS id, 1 + CAST(s_suppkey % 2 = 0 AS INTEGER) AS copies FROM supplier")
def src06_drafts(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.schema(_DRAFT).json(f"{_written(spark, sf)}/*")
    return rows.groupBy("id").agg(F.count("*").cast("int").alias("copies"))


@query("SELECT 'd' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS phrase FROM supplier WHERE s_nationkey % 3 = 1")
def src07_drafts_of_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts of a chat over sessions; the newest file of an id holds, here by session as both are written at once."""
    rows = spark.read.schema(_DRAFT).json(f"{_written(spark, sf)}/*").select("*", F.col("_metadata.file_path").alias("file"))
    stamped = rows.withColumn("modified", F.regexp_extract("file", "session=(.)", 1))
    return S.drafts_of_chat(stamped, "chat1").select("id", "phrase")


@query("SELECT 's' || l_orderkey % 7 AS session, l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'A'")
def src08_edges_of_chat(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), (F.col("l_orderkey") % 7).cast("string")).alias("session"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("source_chat_id"))
    return S.edges_of_chat(e, "A").drop("source_chat_id")


@query("SELECT CAST(turn AS INTEGER) AS turn, role, text AS content FROM (SELECT row_number() OVER (ORDER BY turn) - 1 AS turn, role, text FROM conversations WHERE conv_id = 5)")
def src09_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Chats written with their messages, one of them read back."""
    path = _folder(spark)
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    c.select("id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")).write.json(path)
    rows = spark.read.schema("id string, messages array<struct<role:string,content:string>>").json(path)
    return S.messages_of(rows, "5")


@query("SELECT count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS turns FROM (SELECT count(*) AS turns FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def src11_durations(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.count("*").cast("int").alias("turns")).write.json(path)
    found = S.session_durations(spark, path)
    return spark.createDataFrame([(len(found), sum(found))], "sessions long, turns long")


@query("SELECT 'd' || s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'phrase' WHEN 1 THEN s_name WHEN 2 THEN 'label' WHEN 3 THEN substr(repeat(s_name, 9), 1, 80) ELSE 'f' || s_suppkey END AS shown FROM supplier")
def src24_library(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    only = lambda n, c: F.when(k == n, c).otherwise(F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise(F.lit(None)))
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("id"), only(0, F.lit("phrase")).alias("phrase"), only(1, F.col("s_name")).alias("title"), only(2, F.lit("label")).alias("label"),
        only(3, F.repeat("s_name", F.lit(9))).alias("text"), F.concat(F.lit("file:/x/f"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("file"),
    )
    return S.labelled_library(rows).select("id", "shown")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'a / b' END AS path, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_nationkey END AS INTEGER) AS ord FROM supplier WHERE s_nationkey < 20")
def src25_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    own = s.select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" "), "s_name")).alias("topic"), F.array(F.lit("a "), F.lit(""), F.lit("b")).alias("topics"), F.lit(None).cast("array<string>").alias("cross"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).cast("int").alias("order"),
    )
    return S.slab_records(own, s.where("s_nationkey < 20").select(F.col("s_suppkey").alias("id"))).select("id", "path", F.col("order").alias("ord"))


@query("SELECT n_nationkey AS id, 2 AS version, n_name || '!' AS name FROM nation")
def snk01_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """A table replaced as a whole: readers see the second version alone."""
    path = _folder(spark)
    n = table(spark, sf, "nation")
    S.replace(n.select(F.col("n_nationkey").alias("id"), F.lit(1).alias("version"), F.col("n_name").alias("name")), path)
    S.replace(n.select(F.col("n_nationkey").alias("id"), F.lit(2).alias("version"), F.concat("n_name", F.lit("!")).alias("name")), path)
    return S.current(spark, path, "id int, version int, name string")


@query("SELECT CASE event_type WHEN 'error' THEN 'drift' ELSE 'match' END AS topic, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def snk03_logged(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    e = table(spark, sf, "events").select("event_id", "event_type")
    S.log_event(spark, path, "drift", e.where("event_type = 'error'"))
    S.log_event(spark, path, "match", e.where("event_type = 'view'"))
    rows = spark.read.json(path).where("at is not null")
    return rows.groupBy("topic").agg(F.count("*").alias("n"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS status, arg_max(event_id, event_id) FILTER (value > 50) AS title FROM events GROUP BY user_id")
def snk07_settings(spark: SparkSession, sf: str) -> DataFrame:
    """The last value of each setting of a chat, from its changes."""
    changes = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.col("event_type").alias("status"), F.when(F.col("value") > 50, F.col("event_id")).alias("title"))
    return S.latest_settings(changes, ["status", "title"])


@query("SELECT c_mktsegment AS scope, c_nationkey AS cluster, CASE WHEN c_nationkey % 3 = 0 THEN 'anew' ELSE 'label ' || c_nationkey END AS label FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL UNION ALL SELECT DISTINCT c_mktsegment, c_nationkey, 'anew' FROM customer WHERE c_mktsegment = 'BUILDING'")
def snk08_label_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Labels kept for clusters whose members are the same, after one scope was made invalid."""
    now = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("scope"), F.col("c_nationkey").alias("cluster")).agg(F.count("*").alias("fingerprint"))
    cache = now.select("scope", "cluster", F.when(F.col("cluster") % 3 == 0, F.col("fingerprint") + 1).otherwise(F.col("fingerprint")).alias("fingerprint"), F.concat(F.lit("label "), F.col("cluster").cast("string")).alias("label"))
    held, new = S.cached_labels(S.without_scope(cache, "BUILDING"), now)
    return held.select("scope", "cluster", "label").unionByName(new.select("scope", "cluster", F.lit("anew").alias("label")))


@query("SELECT CAST(count(*) AS INTEGER) AS n, min(session) AS first FROM (SELECT 's' || conv_id AS session, count(*) FILTER (role = 'assistant') AS turns FROM conversations WHERE conv_id < 4 GROUP BY conv_id) WHERE turns >= 1")
def snk09_session_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of four sessions recorded, those without a turn left out."""
    path = _folder(spark)
    turns = table(spark, sf, "conversations").where("conv_id < 4").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n")).collect()  # four rows
    for r in turns:
        S.session_ended(spark, path, f"s{r.conv_id}", int(r.n))
    return spark.read.json(path).agg(F.count("*").cast("int").alias("n"), F.min("session").alias("first"))


@query("""WITH r AS (SELECT n_nationkey AS place, n_name AS id, n_regionkey AS k FROM nation) SELECT place * 5 AS place, '## ' || id AS line FROM r UNION ALL SELECT place * 5 + 1, '- mode: ' || CASE WHEN k < 2 THEN 'CODE' ELSE 'DOMAIN' END || ' (0.5000)' FROM r
UNION ALL SELECT place * 5 + 2, '- changed: ' || CASE WHEN k = 3 THEN 'no' ELSE 'yes' END FROM r UNION ALL SELECT place * 5 + 3, '- reasons: ' || CASE WHEN k = 4 THEN 'none' ELSE 'a; b' END FROM r UNION ALL SELECT place * 5 + 4, '' FROM r""")
def snk10_audit(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_regionkey")
    rows = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("place"), F.col("n_name").alias("id"), F.when(k < 2, "CODE").otherwise("DOMAIN").alias("mode"), F.lit(0.5).alias("score"), F.col("n_name").alias("before"),
        F.when(k == 3, F.col("n_name")).otherwise("other").alias("after"), F.when(k == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("reasons"),
    )
    return S.audit_lines(rows)


@query("SELECT ['draft_anchor_', 'mined_slab_', 'draft_bundle_'][s_suppkey % 4 + 1] || s_suppkey AS id, ['anchor', 'slab', 'bundle'][s_suppkey % 4 + 1] AS type FROM supplier WHERE s_suppkey % 4 < 3")
def str10_restored(spark: SparkSession, sf: str) -> DataFrame:
    """A registry of which nothing was saved, rebuilt from the prefixes of ids."""
    start = F.array(*[F.lit(x) for x in ("draft_anchor_", "mined_slab_", "draft_bundle_", "other_")])[(F.col("s_suppkey") % 4).cast("int")]
    ids = table(spark, sf, "supplier").select(F.concat(start, F.col("s_suppkey").cast("string")).alias("id"))
    return S.restored(spark.createDataFrame([("b", "x", "slab")], "session string, id string, type string"), ids, "a")


@query("SELECT s_suppkey AS path, CASE WHEN s_suppkey % 4 < 2 THEN s_name || CASE WHEN s_suppkey % 4 = 1 THEN 'é' ELSE '' END END AS text, CASE s_suppkey % 4 WHEN 2 THEN 'no_reader' WHEN 3 THEN 'too_large' END AS error FROM supplier")
def src12_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads in UTF-8, with its mark, in Latin-1, as a PDF, and too large."""
    k = F.col("s_suppkey") % 4
    name = F.concat(F.col("s_suppkey").cast("string"), F.when(k == 2, ".PDF").otherwise(".txt"))
    body = F.when(k == 0, F.encode(F.concat(F.lit("﻿"), "s_name"), "UTF-8")).when(k == 1, F.encode(F.concat("s_name", F.lit("é")), "ISO-8859-1")).when(k == 3, F.encode(F.repeat("s_name", F.lit(100)), "UTF-8")).otherwise(F.encode("s_name", "UTF-8"))
    out = S.uploaded_text(table(spark, sf, "supplier").select(name.alias("path"), body.alias("content")), cap=1000)
    return out.select(F.regexp_extract("path", "^([0-9]+)", 1).cast("int").alias("path"), "text", "error")
