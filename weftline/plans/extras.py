"""Queries of sources, sinks and transitions that have an operator of their own or are a short plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import models as M
from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.operators import match as J
from weftline.operators import windows as S
from weftline.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes
from weftline.plans.registry import Registry
from weftline.session import scratch_root, ship
from weftline.sources import conversations as C
from weftline.operators import tallies as T2
from weftline.sources import stores
from weftline.sources.tables import table

registry = Registry()
query = registry.query
GRAPH = f"{NODES_SQL}, {EDGES_SQL}"


@query("SELECT conv_id, turn, (['transcript_jsonl', 'messages_export', 'mapping_export', 'markdown', 'plaintext', 'mapping_export'])[conv_id % 6 + 1] AS format FROM conversations")
def src14_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Formats of raw uploads, written from messages in each of the formats."""
    ship(spark)
    body = F.to_json(F.struct("text"))
    row = F.concat(F.lit('{"type": "user", "message": '), body, F.lit("}"))
    raws = [
        F.concat(row, F.lit("\n"), row), F.concat(F.lit('[{"chat_messages": ['), body, F.lit("]}]")), F.concat(F.lit('{"mapping": {"a": '), body, F.lit("}}")),
        F.concat(F.lit("## Human\n"), "text", F.lit("\n\n## Assistant\nyes")), F.concat(F.lit("plain: "), "text"), F.concat(F.lit('[{"role": "user", "content": '), body, F.lit("}]")),
    ]
    raw = table(spark, sf, "conversations").select("conv_id", "turn", F.array(*raws)[(F.col("conv_id") % 6).cast("int")].alias("raw"))
    return M.mapped(raw, C.export_format, "raw", "format").select("conv_id", "turn", "format")


_MESSAGES = "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS index, {role} AS role, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS content FROM conversations WHERE {where}"


@query(_MESSAGES.format(role="CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END", where="role <> 'system' AND trim(text) <> ''"))
def src16_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Mapping exports, written from conversations, read back."""
    ship(spark)
    m = table(spark, sf, "conversations")
    node = F.struct(F.struct(F.struct(F.col("role")).alias("author"), F.col("turn").alias("create_time"), F.struct(F.split("text", " ", -1).alias("parts")).alias("content")).alias("message"))
    raws = m.groupBy("conv_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), node))).alias("mapping"))).alias("raw"))
    return C.normalised(raws).select("conv_id", "index", "role", "content")


@query(_MESSAGES.format(role="CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END", where="trim(text) <> ''"))
def src17_markdown(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    head = F.when(F.col("role") == "assistant", "## Assistant\n").otherwise("## User\n")
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(head, "text").alias("x"))))
    raws = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["x"]), "\n\n").alias("raw"))
    return C.normalised(raws).select("conv_id", "index", "role", "content")


@query("SELECT conv_id, '[turn ' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '] [' || role || ']' AS head FROM conversations")
def src20_rendered(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    rows = table(spark, sf, "conversations").withColumn("index", n).select("conv_id", "role", F.lit("").alias("content"), "index")
    text = C.rendered(rows, "conv_id")
    return text.select("conv_id", F.explode(F.split("text", "\n\n")).alias("x")).select("conv_id", F.trim("x").alias("head"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, length(array_to_string(list(x), chr(10))) > 20 AS kept FROM l GROUP BY doc_id HAVING kept")
def src21_code_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without definitions are one chunk, unless too short."""
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    return stores.code_chunks(files).groupBy(F.col("path").alias("doc_id")).agg((F.count("*") > 0).alias("kept"))


@query("SELECT p_partkey, p_name || ' in ' || p_type AS plain FROM part")
def src27_latex(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("% note\n\\emph{"), "p_name", F.lit("} in \\textbf{"), "p_type", F.lit("}\\cite{a}"))
    return table(spark, sf, "part").select("p_partkey", stores.latex_to_plain(raw).alias("plain"))


@query("SELECT 0.25 AS alpha, 8 AS cap, true AS strict")
def src30_policy(spark: SparkSession, sf: str) -> DataFrame:
    p = stores.policy({"alpha": 0.3, "cap": 10, "flags": {"strict": True}}, {"alpha": "0.25", "cap": 8.0, "unknown": 1})
    return spark.range(1).select(F.lit(p["alpha"]).alias("alpha"), F.lit(p["cap"]).alias("cap"), F.lit(p["flags"]["strict"]).alias("strict"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'ACCEPTED' WHEN p_size > 40 THEN 'REJECTED' ELSE 'PROPOSED' END AS status FROM part")
def snk06_status(spark: SparkSession, sf: str) -> DataFrame:
    """A table rewritten with the changes of another."""
    p = table(spark, sf, "part")
    changes = p.where("p_size < 10").select("p_partkey", F.lit("ACCEPTED").alias("new")).unionByName(p.where("p_size > 40").select("p_partkey", F.lit("REJECTED").alias("new")))
    return p.select("p_partkey").join(changes, "p_partkey", "left").select("p_partkey", F.coalesce("new", F.lit("PROPOSED")).alias("status"))


@query("SELECT * FROM (VALUES ('building', 2), ('default', 1)) t(collection, version)")
def snk11_activation(spark: SparkSession, sf: str) -> DataFrame:
    """The control table after activations: the last row of a collection holds, the default one stays active."""
    root = f"{scratch_root(spark)}/control-{uuid.uuid4().hex}"
    for name, version, active in (("geo", 1, True), ("geo", 1, False), ("building", 1, True), ("building", 2, True), ("default", 1, False)):
        stores.publish(spark, root, name, version, active)
    return stores.active_collections(spark, root)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def flt25_pending(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select("o_orderkey")


@query("""WITH a AS (SELECT conv_id, list_distinct(string_split(lower(text), ' ')) AS w FROM (SELECT conv_id, string_agg(text, ' ') AS text FROM conversations GROUP BY conv_id)), b AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark),
s AS (SELECT conv_id, item_id, len(list_intersect(a.w, b.w)) AS n FROM a, b), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, item_id) AS k FROM s WHERE n > 0) SELECT conv_id, item_id, n FROM r WHERE k <= 5""")
def joi16_context(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda df, key: df.select(key, F.explode(F.array_distinct(F.split(F.lower("text"), " ", -1))).alias("w"))
    both = words(table(spark, sf, "conversations"), "conv_id").distinct().join(words(table(spark, sf, "benchmark"), "item_id"), "w")
    n = both.groupBy("conv_id", "item_id").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("n"), "item_id"))).where("k <= 5").drop("k")


@query(f"WITH {GRAPH} SELECT id, lower(label) AS key FROM nodes WHERE lower(label) IN (SELECT lower(n_name) FROM nation WHERE n_nationkey < 7)")
def joi28_label_ids(spark: SparkSession, sf: str) -> DataFrame:
    index = J.label_index(nodes(spark, sf).select("label", "id", F.lit(0).alias("priority")))
    asked = table(spark, sf, "nation").where("n_nationkey < 7").select(F.lower("n_name").alias("key"))
    return index.join(asked, "key", "left_semi").select("id", "key")


@query("WITH l AS (SELECT c_nationkey AS pillar, c_custkey AS src, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS dst FROM customer WHERE c_acctbal > 0) SELECT pillar, src, dst, 'ACCEPTED' AS status FROM l WHERE dst IS NOT NULL")
def win11_accepted_spine(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("pillar"), F.col("c_custkey").alias("id"))
    return S.sequence_edges(own, ["pillar"], ["id"]).withColumn("status", F.lit("ACCEPTED"))


@query("SELECT count(*) AS n FROM documents WHERE source IN ('src1', 'src2')")
def set09_rebound(spark: SparkSession, sf: str) -> DataFrame:
    """A merged view bound to a name, bound anew, and read by it."""
    name = f"merged_{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents")
    T2.bound_view(rows, name)
    return T2.bound_view(rows.where(F.col("source").isin("src1", "src2")), name).agg(F.count("*").alias("n"))


@query("SELECT a.item_id AS a, a.item_id + 1 AS b, true AS bounded FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def vec03_text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of texts by the default embedder, within its bounds."""
    ship(spark)
    v = M.embedded(table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("text")), "text")
    a, b = v.select(F.col("item_id").alias("a"), F.col("vector").alias("u")), v.select(F.col("item_id").alias("b"), F.col("vector").alias("w"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", (F.abs(V.cosine(F.col("u"), F.col("w"))) <= 1.000001).alias("bounded"))


@query("SELECT event_id, greatest(0, least(1, value / 100)) AS clamped, CAST(round_even(value, 0) AS DOUBLE) AS even FROM events")
def sca19_rounding(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.clamp01(F.col("value") / 100).alias("clamped"), F.bround("value", 0).alias("even"))


@query("WITH r AS (SELECT user_id, event_type, list(event_id ORDER BY event_id) AS l FROM events GROUP BY ALL) SELECT user_id, event_type, len(l) AS n, l[1] AS first, l[len(l)] AS last FROM r")
def str07_reference_history(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    return h.select("user_id", "event_type", "n", "first", "last")


@query(f"WITH {GRAPH} SELECT type, src, dst, CASE WHEN src IN (SELECT id FROM nodes WHERE ord < 60) AND dst IN (SELECT id FROM nodes WHERE ord < 60) THEN 'COMMITTED' ELSE 'ACCEPTED' END AS status FROM edges WHERE type IN ('LINKS', 'CONFLICTS')")
def lif03_commit_ready(spark: SparkSession, sf: str) -> DataFrame:
    """Edges committed once both ends exist."""
    there = nodes(spark, sf).where("ord < 60").select("id").distinct()
    e = edges(spark, sf).where("type IN ('LINKS', 'CONFLICTS')")
    e = e.join(there.select(F.col("id").alias("src"), F.lit(True).alias("s")), "src", "left").join(there.select(F.col("id").alias("dst"), F.lit(True).alias("d")), "dst", "left")
    return e.select("type", "src", "dst", F.when(F.col("s") & F.col("d"), "COMMITTED").otherwise("ACCEPTED").alias("status"))
