"""Validation and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import lifecycle as L
from weftline.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query
GRAPH = f"{NODES_SQL}, {EDGES_SQL}"


@query("""SELECT 'part' AS "check", CAST(l_orderkey AS VARCHAR) AS id, CAST(l_partkey AS VARCHAR) AS target FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)
UNION ALL SELECT 'supplier', CAST(l_orderkey AS VARCHAR), CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 50 <> 1)
UNION ALL SELECT 'duplicate_id', CAST(id AS VARCHAR), NULL FROM (SELECT s_suppkey AS id FROM supplier INTERSECT SELECT n_nationkey FROM nation)
UNION ALL SELECT 'version_suffix', p_name, '_v1' FROM (SELECT DISTINCT p_name FROM part) WHERE NOT ends_with(p_name, '_v1')""")
def val01_checks(spark: SparkSession, sf: str) -> DataFrame:
    """References into tables with rows left out, ids of two types, and names without a version."""
    li, p, s = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "supplier")
    text = lambda c: F.col(c).cast("string")
    parts = L.missing_references(li.select(text("l_orderkey").alias("id"), text("l_partkey").alias("ref")), p.where("p_size <> 7").select(text("p_partkey").alias("id")), "part")
    sups = L.missing_references(li.select(text("l_orderkey").alias("id"), text("l_suppkey").alias("ref")), s.where("s_suppkey % 50 <> 1").select(text("s_suppkey").alias("id")), "supplier")
    both = s.select(text("s_suppkey").alias("id"), F.lit("supplier").alias("type")).unionByName(table(spark, sf, "nation").select(text("n_nationkey").alias("id"), F.lit("nation").alias("type")))
    names = p.select(F.col("p_name").alias("id"), F.lit("v1").alias("version")).distinct()
    return parts.unionByName(sups).unionByName(L.duplicate_ids(both)).unionByName(L.bad_suffixes(names))


@query("SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT (c_acctbal >= 0) THEN 'balance' END, CASE WHEN NOT (length(c_mktsegment) BETWEEN 1 AND 8) THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS broken FROM customer WHERE NOT (c_acctbal >= 0 AND length(c_mktsegment) BETWEEN 1 AND 8)")
def val03_constraints(spark: SparkSession, sf: str) -> DataFrame:
    checked = L.constrained(table(spark, sf, "customer"), {"balance": F.col("c_acctbal") >= 0, "segment": F.length("c_mktsegment").between(1, 8)})
    return checked.where(F.size("broken") > 0).select("c_custkey", F.array_join("broken", ",").alias("broken"))


@query("SELECT p_partkey AS id, count(l_orderkey) AS dependents, count(l_orderkey) = 0 AS safe FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 40 GROUP BY p_partkey")
def val04_deletable(spark: SparkSession, sf: str) -> DataFrame:
    return L.deletable(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("ref")))


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus AS before, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS after FROM orders) SELECT CASE WHEN after = 'X' THEN 'breach' WHEN before = 'P' THEN 'skipped' ELSE 'preserved' END AS verdict, count(*) AS n FROM a GROUP BY 1""")
def val06_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether rewrites kept the identity of what they rewrote."""
    before = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("before"))
    after = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("after"))
    verdict = F.when(F.col("after") == "X", "breach").when(F.col("before") == "P", "skipped").otherwise("preserved")
    return before.join(after, "o_orderkey").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


_DRAFTS = """d AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'TENTATIVE' WHEN 'O' THEN 'DRAFT_UNAUTHORIZED' ELSE 'COMMITTED' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'discard' WHEN 1 THEN 'promote_tentative' ELSE 'promote_corpus' END AS action,
CASE WHEN o_totalprice > 400000 THEN 'high' ELSE 'low' END AS severity, o_orderpriority <> '5-LOW' AS facts_ok FROM orders)"""


def _drafts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "TENTATIVE").when(F.col("o_orderstatus") == "O", "DRAFT_UNAUTHORIZED").otherwise("COMMITTED").alias("status"),
        F.when(k == 0, "discard").when(k == 1, "promote_tentative").otherwise("promote_corpus").alias("action"), F.when(F.col("o_totalprice") > 400000, "high").otherwise("low").alias("severity"),
        (F.col("o_orderpriority") != "5-LOW").alias("facts_ok"),
    )


_REVIEWED = """r AS (SELECT *, CASE WHEN status NOT IN ('DRAFT_UNAUTHORIZED', 'TENTATIVE') THEN 'closed' WHEN action = 'promote_corpus' AND severity = 'high' THEN 'drift' WHEN action = 'promote_corpus' AND NOT facts_ok THEN 'facts' END AS reason FROM d)"""


@query(f"WITH {_DRAFTS}, {_REVIEWED} SELECT id, reason, CASE WHEN reason IS NOT NULL THEN status WHEN action = 'discard' THEN 'DISCARDED' WHEN action = 'promote_tentative' THEN 'TENTATIVE' ELSE 'COMMITTED' END AS new_status FROM r")
def lif01_review(spark: SparkSession, sf: str) -> DataFrame:
    return L.reviewed(_drafts(spark, sf)).select("id", "reason", "new_status")


@query(f"WITH {_DRAFTS}, {_REVIEWED} SELECT severity, coalesce(reason, action) AS outcome, count(*) AS n FROM r GROUP BY ALL")
def lif11_batch(spark: SparkSession, sf: str) -> DataFrame:
    return L.reviewed(_drafts(spark, sf)).groupBy("severity", F.coalesce("reason", "action").alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH} SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges WHERE type = 'CONFLICTS')")
def lif02_evict(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).select("id").join(edges(spark, sf).where("type = 'CONFLICTS'").select(F.col("dst").alias("id")), "id", "left_anti")


@query("""WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'ACCEPTED' WHEN 'N' THEN 'PROPOSED' ELSE 'COMMITTED' END AS status FROM lineitem WHERE l_quantity > 45)
SELECT src, dst, status, CASE WHEN status NOT IN ('PROPOSED', 'ACCEPTED') THEN status WHEN s.k IS NOT NULL AND p.k IS NOT NULL THEN CASE status WHEN 'ACCEPTED' THEN 'COMMITTED' ELSE 'PROPOSED' END ELSE 'REJECTED' END AS new_status
FROM e LEFT JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0) s ON s.k = src LEFT JOIN (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 <> 0) p ON p.k = dst""")
def lif04_sweep(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "ACCEPTED").when(F.col("l_returnflag") == "N", "PROPOSED").otherwise("COMMITTED")
    e = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), status.alias("status"))
    n = table(spark, sf, "orders").where("o_orderkey % 5 <> 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    n = n.unionByName(table(spark, sf, "part").where("p_partkey % 7 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")))
    out = L.swept_edges(e, n)
    return out.select(F.substring("src", 2, 20).cast("long").alias("src"), F.substring("dst", 2, 20).cast("long").alias("dst"), "status", "new_status")


@query("SELECT user_id AS id, round(least(1, 0.2 + sum(CASE event_type WHEN 'error' THEN 0.05 ELSE 0 END)), 6) AS pressure FROM events GROUP BY user_id")
def lif10_pressure(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    base = e.select(F.col("user_id").alias("id")).distinct().withColumn("pressure", F.lit(0.2))
    deltas = e.where("event_type = 'error'").select(F.col("user_id").alias("id"), F.lit(0.05).alias("delta"))
    return L.pressured(base, deltas).select("id", F.round("pressure", 6).alias("pressure"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN 'DRAFT_UNAUTHORIZED' ELSE 'COMMITTED' END AS status FROM part""")
def lif12_amend(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("COMMITTED").alias("status"))
    new = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("title"))
    return L.amended(old, new, ["title"])
