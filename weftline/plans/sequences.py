"""Window and conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import windows as S
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query


def signals(events: DataFrame) -> DataFrame:
    """Drift signals of the event stream: a user is a session, event_id the turn."""
    hit = lambda t: F.when(F.col("event_type") == t, 1.0).otherwise(0.0)
    mode = F.when(F.col("user_id") % 2 == 0, "internal").otherwise("external")
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("turn"), hit("error").alias("affect"), hit("purchase").alias("volatility"), F.least(F.lit(1.0), F.col("value") / 100).alias("rigor"), mode.alias("mode"))


_SIGNALS = """s AS (SELECT user_id AS session, event_id AS turn, CASE event_type WHEN 'error' THEN CAST(1 AS DOUBLE) ELSE 0 END AS affect, CASE event_type WHEN 'purchase' THEN CAST(1 AS DOUBLE) ELSE 0 END AS volatility,
  least(1, value / 100) AS rigor, CASE WHEN user_id % 2 = 0 THEN 'internal' ELSE 'external' END AS mode, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS start FROM events)"""
_DRIFT = f"""WITH {_SIGNALS},
p AS (SELECT a.session, a.turn, a.start, a.mode, count(*) AS n, sum(b.affect * (b.i - greatest(a.i - 50, 0))) AS wa, sum(b.volatility * (b.i - greatest(a.i - 50, 0))) AS wv, sum(b.rigor * (b.i - greatest(a.i - 50, 0))) AS wr
  FROM s a JOIN s b ON a.session = b.session AND b.i BETWEEN a.i - 49 AND a.i GROUP BY ALL),
q AS (SELECT *, wa / (n * (n + 1) / 2) AS affect, wv / (n * (n + 1) / 2) AS volatility, wr / (n * (n + 1) / 2) AS rigor, least(CAST(1 AS DOUBLE), (turn - start) / greatest(CAST(1 AS DOUBLE), CAST(7 AS DOUBLE))) AS duration FROM p),
c AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 0.30::DOUBLE * affect + 0.25::DOUBLE * volatility + 0.25::DOUBLE * rigor + 0.20::DOUBLE * duration)) AS composite FROM q)"""


def _drift(spark: SparkSession, sf: str) -> DataFrame:
    return S.drift(signals(table(spark, sf, "events")))


@query(_DRIFT + """ SELECT session, turn, round(affect + 1e-12::DOUBLE, 6) AS affect, round(volatility + 1e-12::DOUBLE, 6) AS volatility, round(rigor + 1e-12::DOUBLE, 6) AS rigor, round(duration + 1e-12::DOUBLE, 6) AS duration, round(composite + 1e-12::DOUBLE, 6) AS composite,
CASE WHEN composite <= CASE mode WHEN 'internal' THEN 0.54 ELSE 0.39 END THEN 'low' WHEN composite <= CASE mode WHEN 'internal' THEN 0.79 ELSE 0.69 END THEN 'medium' ELSE 'high' END AS severity, CAST(n AS INTEGER) AS "window" FROM c""")
def win01_drift(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(F.col(c) + 1e-12, 6).alias(c)  # noqa: E731 - halves go up in any engine
    return _drift(spark, sf).select("session", "turn", r("affect"), r("volatility"), r("rigor"), r("duration"), r("composite"), "severity", "window")


@query("SELECT user_id AS session, event_id AS turn, round(least(1, (event_id - min(event_id) OVER (PARTITION BY user_id)) / CAST(7 AS DOUBLE)) + 1e-12::DOUBLE, 6) AS duration FROM events")
def win02_duration(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).select("session", "turn", F.round(F.col("duration") + 1e-12, 6).alias("duration"))


@query(_DRIFT + """, v AS (SELECT session, CASE WHEN composite <= CASE mode WHEN 'internal' THEN 0.54 ELSE 0.39 END THEN 'none' WHEN composite <= CASE mode WHEN 'internal' THEN 0.79 ELSE 0.69 END THEN 'medium' ELSE 'high' END AS dampening FROM c)
SELECT session, dampening, count(*) AS n FROM v GROUP BY ALL""")
def win03_dampening(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).groupBy("session", "dampening").agg(F.count("*").alias("n"))


@query(_DRIFT + """, x AS (SELECT session, turn, list_sort([{'v': round(-affect, 9), 'name': 'affect'}, {'v': round(-volatility, 9), 'name': 'volatility'}, {'v': round(-rigor, 9), 'name': 'rigor'}, {'v': round(-duration, 9), 'name': 'duration'}]) AS l FROM c)
SELECT session, turn, l[1].name || ',' || l[2].name AS reason FROM x""")
def win04_reason(spark: SparkSession, sf: str) -> DataFrame:
    rounded = _drift(spark, sf).select("session", "turn", *[F.round(c, 9).alias(c) for c in ("affect", "volatility", "rigor", "duration")])
    return S.drift_reason(rounded).select("session", "turn", "reason")


@query("""WITH RECURSIVE v AS (SELECT user_id AS session, event_id AS turn, least(1, value / 100) AS now, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT session, turn, now, now AS smoothed, i FROM v WHERE i = 1 UNION ALL SELECT v.session, v.turn, v.now, 0.3::DOUBLE * v.now + 0.7::DOUBLE * f.smoothed, v.i FROM f JOIN v ON v.session = f.session AND v.i = f.i + 1)
SELECT session, turn, round(smoothed, 6) AS smoothed FROM f""")
def win05_salience(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("turn"), F.least(F.lit(1.0), F.col("value") / 100).alias("now"))
    return S.smoothed(own).select("session", "turn", F.round("smoothed", 6).alias("smoothed"))


@query("""WITH v AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS now, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM events)
SELECT user_id, event_id, round(coalesce(now, prior * 0.9::DOUBLE, 0), 6) AS salience FROM v""")
def win06_inherit(spark: SparkSession, sf: str) -> DataFrame:
    prior = F.lag("value").over(W.partitionBy("user_id").orderBy("event_id"))
    now = F.when(F.col("event_type") == "view", None).otherwise(F.col("value"))
    return table(spark, sf, "events").select("user_id", "event_id", F.round(F.coalesce(now, prior * S.INHERIT, F.lit(0.0)), 6).alias("salience"))


@query("""SELECT user_id, event_id, round(greatest(0.1::DOUBLE, least(1, value / 100) * pow(0.85::DOUBLE, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1)) + 1e-12::DOUBLE, 6) AS weight FROM events""")
def win07_decay(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id"))) - 1
    return table(spark, sf, "events").select("user_id", "event_id", F.round(S.decayed(F.least(F.lit(1.0), F.col("value") / 100), turns) + 1e-12, 6).alias("weight"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) SELECT o_custkey, src, dst FROM o WHERE dst IS NOT NULL""")
def win08_sequence(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), "o_orderdate")
    return S.sequence_edges(own, ["o_custkey"], ["o_orderdate", "id"])


_CAPS = "[A-ZÀ-Ö][a-zà-ö]+"


@query(f"""WITH t AS (SELECT source, doc_id, list_distinct(regexp_extract_all(text, '{_CAPS}')) AS e FROM documents), l AS (SELECT source, doc_id AS src, e, lead(doc_id) OVER w AS dst, lead(e) OVER w AS f FROM t WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT src, dst, round(least(0.95, 0.55 + 0.1 * len(list_intersect(e, f))), 6) AS weight FROM l WHERE dst IS NOT NULL""")
def win09_shared_entities(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("source", "doc_id", F.array_distinct(F.regexp_extract_all("text", F.lit(_CAPS), F.lit(0))).alias("e"))
    w = W.partitionBy("source").orderBy("doc_id")
    out = own.withColumn("dst", F.lead("doc_id").over(w)).withColumn("f", F.lead("e").over(w)).where("dst IS NOT NULL")
    return out.select(F.col("doc_id").alias("src"), "dst", F.round(F.least(F.lit(0.95), 0.55 + 0.1 * F.size(F.array_intersect("e", "f"))), 6).alias("weight"))


@query("""WITH m AS (SELECT l_suppkey AS scope, 'p' || l_partkey AS id, min(l_orderkey) AS ord FROM lineitem GROUP BY ALL), l AS (SELECT scope, id AS src, lead(id) OVER (PARTITION BY scope ORDER BY ord, id) AS dst FROM m)
SELECT scope, src, dst, substr(md5(src || '|' || dst), 1, 12) AS id FROM l WHERE dst IS NOT NULL""")
def win10_spine(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("scope"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id")).agg(F.min("l_orderkey").alias("ord"))
    return S.sequence_edges(own, ["scope"], ["ord", "id"]).withColumn("id", F.substring(F.md5(F.concat("src", F.lit("|"), "dst")), 1, 12))


@query("""WITH h AS (SELECT user_id, event_id, event_type = 'error' OR value > 60 AS hit FROM events), g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM h)
SELECT user_id, event_id, CAST(sum(CAST(hit AS INTEGER)) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS streak FROM g""")
def win12_streak(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select("user_id", "event_id", ((F.col("event_type") == "error") | (F.col("value") > 60)).alias("hit"))
    return S.streaks(own, "user_id", "event_id", "hit").select("user_id", "event_id", "streak")


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t, event_type = 'error' AS want FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS last, 0 AS n FROM e
 UNION ALL SELECT f.user_id, e.t, CASE WHEN want AND (last IS NULL OR e.t - last >= 5) THEN e.t ELSE last END, CASE WHEN want AND (last IS NULL OR e.t - last >= 5) THEN n + 1 ELSE n END FROM f JOIN e ON e.user_id = f.user_id AND e.t = f.t + 1)
SELECT user_id, CAST(max(n) AS INTEGER) AS fires, max(last) AS last_fire FROM f GROUP BY user_id""")
def win13_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    t = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    own = table(spark, sf, "events").select("user_id", t.cast("long").alias("t"), (F.col("event_type") == "error").alias("want"))
    rows = own.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "want"))).alias("r"))
    fired = S.with_cooldown(F.transform("r", lambda x: x["t"]), F.transform("r", lambda x: x["want"]), 5)
    return rows.select("user_id", fired.alias("f")).select("user_id", F.size("f").alias("fires"), F.when(F.size("f") > 0, F.element_at("f", -1)).alias("last_fire"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, substr(text, 1, 80) AS clip FROM r WHERE k <= 3""")
def win14_last_messages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf, "conversations").withColumn("k", k).where("k <= 3").select("conv_id", "turn", F.substring("text", 1, 80).alias("clip"))


@query("""WITH d AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations WHERE role = 'system' GROUP BY conv_id), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT k.conv_id, k.turn FROM k JOIN d USING (conv_id) WHERE (k.turn >= lo - 3 AND k.turn < hi + 4) OR back <= 2""")
def win15_expanded(spark: SparkSession, sf: str) -> DataFrame:
    """Turns around those that a draft came from, and the last ones."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    d = c.where("role = 'system'").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    k = c.withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return k.join(d, "conv_id").where("(turn >= lo - 3 AND turn < hi + 4) OR back <= 2").select("conv_id", "turn")


_DRAFTS = """d AS (SELECT user_id, event_type, min(event_id) AS raised, count(*) - 1 AS refs, round(max(least(1, value / 100)), 6) AS peak FROM events GROUP BY ALL), f AS (SELECT user_id, max(event_id) AS final FROM events GROUP BY user_id)"""


@query(f"""WITH {_DRAFTS} SELECT d.user_id, event_type, CASE WHEN refs >= 2 THEN 'CONFIRMED' WHEN refs = 0 AND final - raised < 3 THEN 'FRESH' WHEN refs = 0 THEN 'UNTOUCHED' WHEN peak >= 0.4 THEN 'AMBIGUOUS_KEEP' ELSE 'AMBIGUOUS_DROP' END AS verdict FROM d JOIN f USING (user_id)""")
def win17_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    d = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("raised"), (F.count("*") - 1).alias("references"), F.max(F.least(F.lit(1.0), F.col("value") / 100)).alias("peak"))
    final = e.groupBy("user_id").agg(F.max("event_id").alias("final"))
    return S.trajectory(d.join(final, "user_id"), F.col("final")).select("user_id", "event_type", "verdict")


@query(f"""WITH {_DRAFTS} SELECT d.user_id, max(final) AS final, count(*) AS drafts, count(*) FILTER (refs >= 2) AS confirmed FROM d JOIN f USING (user_id) GROUP BY d.user_id""")
def win18_plan(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    d = e.groupBy("user_id", "event_type").agg((F.count("*") - 1).alias("refs"))
    final = e.groupBy("user_id").agg(F.max("event_id").alias("final"))
    return d.join(final, "user_id").groupBy("user_id").agg(F.max("final").alias("final"), F.count("*").alias("drafts"), F.count_if(F.col("refs") >= 2).alias("confirmed"))


@query("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS ids FROM events GROUP BY ALL")
def win19_hit_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("ids"))


@query("""WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY source) // 20) AS stride FROM documents) SELECT source, doc_id FROM n WHERE i % stride = 0 AND i // stride < 20""")
def win20_strided(spark: SparkSession, sf: str) -> DataFrame:
    """Every so many rows of a group, twenty at most."""
    w = W.partitionBy("source").orderBy("doc_id")
    n = table(spark, sf, "documents").select("source", "doc_id", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(W.partitionBy("source")).alias("c"))
    n = n.withColumn("stride", F.greatest(F.lit(1), F.expr("c div 20")))
    return n.where("i % stride = 0 AND i div stride < 20").select("source", "doc_id")


_PAIRS = """m AS (SELECT conv_id, turn, role, lead(role) OVER w AS nr, lead(turn) OVER w AS nt, lag(role) OVER w AS br FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT conv_id, turn AS user_turn, CASE WHEN nr = 'assistant' THEN nt END AS assistant_turn FROM m WHERE role = 'user' UNION ALL SELECT conv_id, NULL, turn FROM m WHERE role = 'assistant' AND coalesce(br, '') <> 'user'),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(user_turn, assistant_turn)) - 1 AS pair FROM u)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.pair_exchanges(table(spark, sf, "conversations").select(F.col("conv_id").alias("chat"), "turn", "role"))


@query(f"WITH {_PAIRS} SELECT conv_id, pair, user_turn, assistant_turn FROM p")
def prj08_pair_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select(F.col("chat").alias("conv_id"), "pair", "user_turn", "assistant_turn")


@query(f"""WITH {_PAIRS}, s AS (SELECT DISTINCT conv_id, pair AS start FROM p WHERE pair % 2 = 0) SELECT s.conv_id, s.start, count(*) AS n_pairs, max(p.pair) AS last_pair FROM s JOIN p ON p.conv_id = s.conv_id AND p.pair BETWEEN s.start AND s.start + 3 GROUP BY ALL""")
def prj09_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.chunk_pairs(_pairs(spark, sf)).groupBy(F.col("chat").alias("conv_id"), "start").agg(F.count("*").alias("n_pairs"), F.max("pair").alias("last_pair"))
