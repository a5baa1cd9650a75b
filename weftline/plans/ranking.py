"""Ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import vectors as V
from weftline.operators import rank as R
from weftline.operators.neighbours import nearest_in_blocks
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query
WORDS = ["license", "version", "3", "rend", "threlyes", "salt", "the"]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _probes(spark: SparkSession, sf: str, n: int = 5) -> DataFrame:
    return _vectors(spark, sf).where(F.col("id") < n).select(F.col("id").alias("query_id"), F.col("v").alias("q"))


@query("WITH " + R.bm25_sql(WORDS, "SELECT doc_id AS id, text FROM documents", 20) + " SELECT id AS doc_id, round(score, 6) AS score FROM lexical")
def top03_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(_docs(spark, sf), WORDS, 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_COS = "coalesce(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 0)"


@query(f"""
SELECT query_id, id AS vec_id, round(s, 6) AS similarity, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, s, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS INTEGER) AS rank
  FROM embeddings e, embeddings q, LATERAL (SELECT {_COS.format(a="e.embedding", b="q.embedding")} AS s) WHERE q.vec_id < 5 AND e.vec_id <> q.vec_id AND s >= 0.2)
WHERE rank <= 15""")
def top01_cosine(spark: SparkSession, sf: str) -> DataFrame:
    out = R.nearest(_vectors(spark, sf), _probes(spark, sf), 0.2, 15)
    return out.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""
SELECT e.label, round(max({_COS.format(a="e.embedding", b="q.embedding")}), 6) AS similarity FROM embeddings e, embeddings q
WHERE q.vec_id = 3 AND e.vec_id <> 3 GROUP BY e.label HAVING similarity >= 0.4 ORDER BY similarity DESC LIMIT 20""")
def top02_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Best similarity of each label's vectors to a probe: a handle's best phrase."""
    probe = _vectors(spark, sf).where("id = 3").select(F.col("v").alias("q"))
    own = table(spark, sf, "embeddings").where("vec_id <> 3").join(F.broadcast(probe))
    best = own.groupBy("label").agg(F.round(F.max(V.cosine(F.col("embedding"), F.col("q"))), 6).alias("similarity"))
    return best.where("similarity >= 0.4").orderBy(F.desc("similarity")).limit(20)


_DENSE_SQL = f"dense AS (SELECT e.vec_id AS id, {_COS.format(a='e.embedding', b='q.embedding')} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 3 AND score >= 0.05 ORDER BY score DESC, id LIMIT 50)"


@query(
    "WITH "
    + R.bm25_sql(WORDS, "SELECT doc_id AS id, text FROM documents", 50)
    + ", "
    + _DENSE_SQL
    + """, d AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM dense), l AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM lexical)
SELECT id, round(coalesce(1 / (60.0::DOUBLE + d.r), 0) + coalesce(1 / (60.0::DOUBLE + l.r), 0), 9) AS score, round(coalesce(d.score, 0), 4) AS dense, round(coalesce(l.score, 0), 4) AS lexical
FROM d FULL JOIN l USING (id) ORDER BY 2 DESC, id LIMIT 15"""
)
def top04_rrf(spark: SparkSession, sf: str) -> DataFrame:
    probe = _vectors(spark, sf).where("id = 3").select(F.col("v").alias("q"))
    dense = _vectors(spark, sf).join(F.broadcast(probe)).select("id", V.cosine(F.col("v"), F.col("q")).alias("score")).where("score >= 0.05").orderBy(F.desc("score"), "id").limit(50)
    out = R.reciprocal_rank_fusion(dense, R.bm25(_docs(spark, sf), WORDS, 50), 15)
    return out.select("id", F.round("score", 9).alias("score"), F.round("dense", 4).alias("dense"), F.round("lexical", 4).alias("lexical"))


@query("""
WITH cost AS (SELECT conv_id, turn, CAST(floor((length(text) + 20) / 4) AS BIGINT) AS tokens FROM conversations),
run AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS used FROM cost)
SELECT conv_id, turn, tokens, used FROM run WHERE used <= 400""")
def top10_message_pack(spark: SparkSession, sf: str) -> DataFrame:
    msgs = table(spark, sf, "conversations").select(F.col("conv_id").alias("chat"), "turn", "text")
    return R.newest_within(msgs, 400).select(F.col("chat").alias("conv_id"), "turn", "tokens", "used")


@query("""
WITH RECURSIVE items AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, CAST(greatest(1, ceil(length(text) / 4)) AS DOUBLE) AS cost FROM conversations),
fold AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS used, CAST('' AS VARCHAR) AS taken FROM (SELECT DISTINCT conv_id FROM items)
  UNION ALL SELECT f.conv_id, i.n, CASE WHEN f.used + i.cost <= 120 THEN f.used + i.cost ELSE f.used END,
    CASE WHEN f.used + i.cost <= 120 THEN f.taken || CASE WHEN f.taken = '' THEN '' ELSE ',' END || i.turn ELSE f.taken END
  FROM fold f JOIN items i ON i.conv_id = f.conv_id AND i.n = f.n + 1)
SELECT conv_id, arg_max(used, n) AS used, arg_max(taken, n) AS taken FROM fold GROUP BY conv_id""")
def top09_greedy_pack(spark: SparkSession, sf: str) -> DataFrame:
    cost = F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("double")
    items = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cost.alias("cost")))).alias("m"))
    struct = F.transform("m", lambda x: F.struct(x["turn"].cast("string").alias("id"), x["cost"].alias("cost")))
    out = items.select("conv_id", R.greedy_pack(struct, 120.0).alias("p"))
    return out.select("conv_id", F.col("p.used").alias("used"), F.array_join("p.taken", ",").alias("taken"))


@query(f"""
WITH sims AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS.format(a="a.embedding", b="b.embedding")} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM sims WHERE s >= 0.3)
SELECT least(a, b) AS node_a, greatest(a, b) AS node_b, max(round(s, 6)) AS similarity FROM best WHERE r <= 3 GROUP BY 1, 2""")
def top08_affinity(spark: SparkSession, sf: str) -> DataFrame:
    """Three nearest of each vector within its label, as unordered pairs."""
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.col("embedding").alias("v"))
    best = nearest_in_blocks(own, own, 3, 0.3, others=True).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("similarity").alias("s"))
    return best.groupBy(F.least("a", "b").alias("node_a"), F.greatest("a", "b").alias("node_b")).agg(F.max(F.round("s", 6)).alias("similarity"))


@query("""
WITH n AS (SELECT user_id, event_type, count(*) AS hits, round(sum(value), 2) AS salience FROM events GROUP BY user_id, event_type),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY salience DESC, event_type) AS INTEGER) AS rank FROM n)
SELECT user_id, event_type, hits, salience, rank FROM r WHERE rank <= 3""")
def top11_evict(spark: SparkSession, sf: str) -> DataFrame:
    """The most salient nodes of each session stay, the others are evicted."""
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("hits"), F.round(F.sum("value"), 2).alias("salience"))
    return R.top_per_group(n, ["user_id"], [F.desc("salience"), F.col("event_type")], 3)


@query("""
WITH u AS (SELECT 0 AS source, doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 10
  UNION ALL SELECT 1, doc_id, row_number() OVER (ORDER BY doc_id) FROM labels QUALIFY row_number() OVER (ORDER BY doc_id) <= 20),
f AS (SELECT id, min(source * 1000 + rank) AS place FROM u GROUP BY id)
SELECT id AS doc_id, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS rank FROM f ORDER BY rank LIMIT 25""")
def top12_references(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked lists joined in order of their source, each id at its first place, the first 25."""
    a = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(10)
    a = a.select(F.lit(0).alias("source"), F.col("doc_id").alias("id"), F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id")).alias("r"))
    b = table(spark, sf, "labels").orderBy("doc_id").limit(20).select(F.lit(1).alias("source"), F.col("doc_id").alias("id"), F.row_number().over(W.orderBy("doc_id")).alias("r"))
    first = a.unionByName(b).groupBy("id").agg(F.min(F.col("source") * 1000 + F.col("r")).alias("place"))
    return first.select(F.col("id").alias("doc_id"), F.row_number().over(W.orderBy("place")).alias("rank")).orderBy("rank").limit(25)


@query("""
SELECT user_id, round(p, 4) AS pressure FROM (SELECT user_id, least(1.0, sum(CASE WHEN event_type = 'error' THEN 0.05 ELSE 0 END)) AS p FROM events GROUP BY user_id) WHERE p >= 0.5""")
def top13_pressure(spark: SparkSession, sf: str) -> DataFrame:
    p = F.least(F.lit(1.0), F.count_if(F.col("event_type") == "error") * 0.05)
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(p, 4).alias("pressure")).where("pressure >= 0.5")


@query("""
WITH r AS (SELECT user_id, event_type, avg(value) AS s, row_number() OVER (PARTITION BY user_id ORDER BY avg(value) DESC, event_type) AS k FROM events GROUP BY user_id, event_type HAVING avg(value) >= 0.15)
SELECT user_id, substr(string_agg(upper(event_type[1]) || event_type[2:], ' / ' ORDER BY k), 1, 50) AS title FROM r WHERE k <= 3 GROUP BY user_id""")
def top14_title(spark: SparkSession, sf: str) -> DataFrame:
    """A title from the three most salient labels."""
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("s")).where("s >= 0.15")
    top = R.top_per_group(n, ["user_id"], [F.desc("s"), F.col("event_type")], 3)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.initcap("event_type").alias("t")))), lambda x: x["t"])
    return top.groupBy("user_id").agg(F.substring(F.array_join(names, " / "), 1, 50).alias("title"))


@query("""
WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k,
  row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS kk FROM documents WHERE lang IN ('en', 'fr'))
SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY kk) AS all_k FROM r WHERE k <= CASE lang WHEN 'en' THEN 3 ELSE 5 END) WHERE all_k <= 6""")
def top16_caps(spark: SparkSession, sf: str) -> DataFrame:
    """A cap for each type within a session, then one for the session."""
    own = table(spark, sf, "documents").where(F.col("lang").isin("en", "fr")).select("source", "lang", "doc_id", "n_chars")
    order = [F.desc("n_chars"), F.col("doc_id")]
    typed = own.withColumn("k", F.row_number().over(W.partitionBy("source", "lang").orderBy(*order))).where(F.col("k") <= F.when(F.col("lang") == "en", 3).otherwise(5))
    return R.top_per_group(typed, ["source"], order, 6).select("source", "lang", "doc_id")


@query("SELECT doc_id, length(substr(text, 1, CASE WHEN source IN ('src0', 'src1') THEN 8000 ELSE 1500 END)) AS shown FROM documents")
def top17_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """Text shown of each type: long for base types, short for others."""
    cap = F.when(F.col("source").isin("src0", "src1"), 8000).otherwise(1500)
    return table(spark, sf, "documents").select("doc_id", F.length(F.substr("text", F.lit(1), cap)).cast("long").alias("shown"))
