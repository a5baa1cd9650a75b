"""Aggregation, set and dedup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import aggregate as A
from weftline.operators import dedup as D
from weftline.operators import tallies as Y
from weftline.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query
GRAPH = f"WITH {NODES_SQL}, {EDGES_SQL}"
# Keywords of the twelve topics that chunks are scored by, in the order that breaks ties.
BANKS = {
    "identity": ["identity", "self", "who i am", "personality", "values", "character", "core belief", "principle", "fundamental"],
    "regulation": ["regulate", "regulation", "boundary", "limit", "constraint", "rule", "policy", "governance", "control", "moderation", "should not", "must not", "never", "always"],
    "epistemics": ["know", "believe", "evidence", "proof", "claim", "hypothesis", "fact", "inference", "uncertain", "confidence", "epistemic", "truth", "verify", "source", "citation"],
    "affect": ["feel", "emotion", "frustrat", "happy", "sad", "anger", "joy", "anxious", "stress", "overwhelm", "excite", "passion", "care about", "matters to me"],
    "methodology": ["method", "process", "workflow", "pipeline", "system", "framework", "approach", "technique", "strategy", "pattern", "architecture", "design", "implement"],
    "decisions": ["decide", "decision", "chose", "choice", "tradeoff", "trade-off", "priority", "prioritize", "commit", "settled on", "going with", "picked", "opted"],
    "preferences": ["prefer", "preference", "like", "dislike", "want", "style", "taste", "rather", "favorite", "habit"],
    "problems": ["problem", "issue", "bug", "error", "broken", "fix", "wrong", "fail", "struggle", "challenge", "difficult", "stuck", "blocker"],
    "worldbuilding": ["world", "universe", "lore", "canon", "fiction", "narrative", "story", "myth", "legend", "saga", "arc", "chapter", "civilization", "colony", "coloniz", "expansion", "empire", "alien", "species", "race", "faction", "culture"],
    "science_fiction": ["fusion", "plasma", "quantum", "energy", "reactor", "nozzle", "ion", "accelerat", "neutron", "photon", "particle", "warp", "drive", "propulsion", "thrust", "engine", "nano", "goo", "grey goo", "xenon", "xenonite", "void", "space", "orbit", "star", "solar"],
    "metaphor": ["analogy", "metaphor", "like", "represent", "symbol", "embod", "manifest", "allegory", "parallel", "mirror", "lifeblood", "circulat", "oasis", "scaffold", "bridge", "echo", "shadow", "ghost", "spirit", "soul"],
    "narrative_structure": ["scene", "act", "moment", "pause", "reveal", "twist", "climax", "finale", "opening", "closing", "sequence", "montage", "slideshow", "visual", "camera", "fade", "catchphrase", "line", "quote", "meme", "callback", "vin diesel", "family", "burnham", "divine"],
}
#: Keywords in the language of the tables, scored by the same rule.
INVENTED = {"er": ["there", "ering", "here", "erth"], "on": ["onth", "tion", "ation", "onhe"], "ou": ["ouon", "queou", "ouai"], "ei": ["keit", "heit", "schei", "ein"]}


@query(GRAPH + " SELECT type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT type, count(*) FROM edges GROUP BY type")
def agg01_status(spark: SparkSession, sf: str) -> DataFrame:
    n, e = nodes(spark, sf), edges(spark, sf)
    kinds = {k: n.where(F.col("type") == k) for k in ("anchor", "slab", "bundle")} | {k: e.where(F.col("type") == k) for k in ("PARENT_OF", "SUPPORTS", "LINKS", "SEQUENCE", "CONFLICTS", "INVOKES", "TENSIONS")}
    return Y.status_counts(kinds)


@query(GRAPH + " SELECT collection, count(*) FILTER (type = 'anchor') AS anchors, count(*) FILTER (type = 'slab') AS slabs, count(*) FILTER (type = 'bundle') AS bundles FROM nodes GROUP BY collection")
def agg02_collections(spark: SparkSession, sf: str) -> DataFrame:
    return Y.pivoted_counts(nodes(spark, sf), "collection", {"anchors": "anchor", "slabs": "slab", "bundles": "bundle"})


_SHAPE_SQL = f"""
{GRAPH},
n AS (SELECT collection, grouping(collection) AS g, count(*) AS nodes FROM nodes GROUP BY GROUPING SETS ((collection), ())),
e AS (SELECT collection, grouping(collection) AS g, count(*) AS edges, count(*) FILTER (type = 'SEQUENCE') AS seq FROM edges GROUP BY GROUPING SETS ((collection), ())),
m AS (SELECT n.collection AS scope, nodes, coalesce(edges, 0) AS edges, coalesce(edges, 0) / greatest(nodes, 1) AS per, coalesce(seq, 0) / greatest(coalesce(edges, 0), 1) AS ratio
  FROM n LEFT JOIN e ON n.collection IS NOT DISTINCT FROM e.collection AND n.g = e.g)
SELECT scope, nodes, edges, round(per, 3) AS edges_per_node, round(ratio, 3) AS seq_ratio,
  CASE WHEN nodes = 0 OR per < {A.SPARSE_EDGES_PER_NODE} THEN 'sparse' WHEN ratio >= {A.SPINE_SEQ_RATIO} AND per <= {A.SPINE_MAX_EDGES_PER_NODE} THEN 'spine'
    WHEN nodes <= {A.FLAT_MAX_NODES} AND ratio < {A.SPINE_SEQ_RATIO} THEN 'flat' WHEN per >= {A.HIGHWAY_MIN_EDGES_PER_NODE} OR ratio <= {A.HIGHWAY_MAX_SEQ_RATIO} THEN 'highway' ELSE 'flat' END AS shape FROM m"""


@query(_SHAPE_SQL + " WHERE scope IS NULL")
def agg03_shape(spark: SparkSession, sf: str) -> DataFrame:
    return A.shapes(nodes(spark, sf), edges(spark, sf)).where("scope IS NULL")


@query(_SHAPE_SQL)
def agg27_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return A.shapes(nodes(spark, sf), edges(spark, sf))


@query("SELECT user_id || '-' || event_type AS id, count(*) AS hits, max(event_id) AS last_turn, count(DISTINCT CAST(ts AS DATE)) AS sessions FROM events GROUP BY ALL")
def agg04_hits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    hits = e.groupBy(F.to_date("ts").alias("session"), F.concat_ws("-", "user_id", "event_type").alias("id")).agg(F.count("*").alias("hits"), F.max("event_id").alias("turn"))
    return Y.hit_totals(hits)


@query("""
WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n) AS i FROM c)
SELECT event_type, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY event_type""")
def agg05_gini(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return A.gini(counts, ["event_type"], "n").select("event_type", F.round("gini", 6).alias("gini"))


_HITS_SQL = "hits AS (SELECT 'c' || o_custkey AS id, count(*) AS hits FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return own.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")).agg(F.count("*").alias("hits"))


@query(f"""{GRAPH}, {_HITS_SQL}, a AS (SELECT n.*, coalesce(hits, 0) AS hits FROM nodes n LEFT JOIN hits USING (id))
SELECT collection, type, count(*) AS n, count(*) FILTER (hits > 0) AS fired, round(100 * count(*) FILTER (hits > 0) / count(*), 1) AS fired_pct, CAST(sum(hits) AS BIGINT) AS hits FROM a GROUP BY ROLLUP (collection, type)""")
def agg06_utilisation(spark: SparkSession, sf: str) -> DataFrame:
    return A.utilisation(nodes(spark, sf), _hits(spark, sf))[0]


@query(f"""{GRAPH}, {_HITS_SQL} SELECT id, collection, hits, round(100 * hits / (SELECT sum(hits) FROM hits), 2) AS share_pct FROM nodes JOIN hits USING (id) ORDER BY hits DESC, id LIMIT 8""")
def agg06_hot(spark: SparkSession, sf: str) -> DataFrame:
    return A.utilisation(nodes(spark, sf), _hits(spark, sf))[1]


@query("SELECT o_orderstatus AS status, o_orderpriority AS type, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg07_queue(spark: SparkSession, sf: str) -> DataFrame:
    return Y.review_queue(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("type")), ("P",))


@query(f"""{GRAPH}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), d AS (SELECT src, count(*) AS d FROM b WHERE src <> dst GROUP BY src)
SELECT type, count(*) AS nodes, round(avg(coalesce(d, 0)), 6) AS avg_degree FROM nodes LEFT JOIN d ON id = src GROUP BY type""")
def agg08_degree(spark: SparkSession, sf: str) -> DataFrame:
    out = A.average_degree(nodes(spark, sf), edges(spark, sf))
    return out.select("type", "nodes", F.round("avg_degree", 6).alias("avg_degree"))


def _topic_sql(banks: dict[str, list[str]]) -> str:
    rows = ", ".join(f"({i}, '{t}', {w!r})" for i, (t, w) in enumerate(banks.items()))
    return f"""
scored AS (SELECT doc_id, topic, place, len(list_filter(words, lambda w: contains(lower(text), w))) / len(words) AS score FROM documents, (VALUES {rows}) b(place, topic, words)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS k FROM scored)"""


@query(f"WITH {_topic_sql(BANKS | INVENTED)} SELECT doc_id, CASE WHEN score > 0 THEN topic ELSE '' END AS topic, round(score, 6) AS score FROM best WHERE k = 1")
def agg09_topics(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return A.topic_scores(docs, BANKS | INVENTED).select(F.col("id").alias("doc_id"), "topic", F.round("score", 6).alias("score"))


@query(f"WITH {_topic_sql(BANKS)} SELECT CASE WHEN score > 0 THEN topic ELSE '' END AS topic, count(*) AS n FROM best WHERE k = 1 GROUP BY 1")
def agg10_topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return A.topic_scores(docs, BANKS).groupBy("topic").agg(F.count("*").alias("n"))


@query(f"""{GRAPH}, m AS (SELECT id, collection AS cluster FROM nodes), p AS (SELECT a.cluster AS ca, b.cluster AS cb FROM edges JOIN m a ON src = a.id JOIN m b ON dst = b.id)
SELECT least(ca, cb) AS a, greatest(ca, cb) AS b, count(*) AS n FROM p WHERE ca <> cb GROUP BY 1, 2""")
def agg11_meta_edges(spark: SparkSession, sf: str) -> DataFrame:
    return A.cluster_edges(nodes(spark, sf).select("id", F.col("collection").alias("cluster")), edges(spark, sf))


@query(f"""{GRAPH}, m AS (SELECT id, collection AS cluster FROM nodes), p AS (SELECT a.cluster AS ca, b.cluster AS cb, weight FROM edges JOIN m a ON src = a.id JOIN m b ON dst = b.id)
SELECT least(ca, cb) AS a, greatest(ca, cb) AS b, round(sum(weight), 3) AS weight FROM p WHERE ca <> cb GROUP BY 1, 2""")
def agg12_meta_weights(spark: SparkSession, sf: str) -> DataFrame:
    return Y.pair_weights(nodes(spark, sf).select("id", F.col("collection").alias("top")), edges(spark, sf))


@query(f"{GRAPH}, t AS (SELECT src AS id FROM edges WHERE type <> 'INVOKES' UNION ALL SELECT dst FROM edges) SELECT n.id, count(t.id) AS structural_weight FROM nodes n LEFT JOIN t ON n.id = t.id WHERE n.type <> 'anchor' GROUP BY n.id")
def agg13_structural(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return Y.structural_weights(nodes(spark, sf).where("type <> 'anchor'"), e.where("type = 'INVOKES'").select(F.col("src").alias("id"), F.col("dst").alias("ref")), e.where("type <> 'INVOKES'"))


@query("""WITH w AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events) SELECT user_id, round(avg(d), 6) AS mismatch FROM w WHERE d IS NOT NULL GROUP BY user_id""")
def agg14_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("value").over(W.partitionBy("user_id").orderBy("event_id"))
    frame = table(spark, sf, "events").select("user_id", F.col("value").alias("now"), before.alias("smoothed")).where("smoothed IS NOT NULL")
    return Y.mismatch(frame, "user_id").select("user_id", F.round("mismatch", 6).alias("mismatch"))


@query("""SELECT c_custkey AS batch, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS confirmed, coalesce(bool_and(o_orderstatus = 'F'), true) AS all_confirmed, coalesce(bool_or(o_orderstatus = 'P'), false) AS has_contradictions,
count(*) FILTER (o_orderstatus = 'O') AS unresolvable FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def agg15_verification(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", "CONFIRMED").when(F.col("o_orderstatus") == "P", "CONTRADICTED").otherwise("UNRESOLVABLE")
    results = table(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), outcome.alias("outcome"))
    return Y.verification_summary(results, table(spark, sf, "customer").select(F.col("c_custkey").alias("batch")))


@query("SELECT coalesce(l.quality, -1) AS owner, count(*) AS n FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def agg16_awareness(spark: SparkSession, sf: str) -> DataFrame:
    owners = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("owner"))
    return Y.awareness(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), owners, -1)


@query("SELECT conv_id AS session, count(*) FILTER (turn % 4 = 2) AS drafts, count(*) FILTER (turn % 4 = 0) AS dreamed, greatest(count(*) FILTER (turn % 4 = 2) - count(*) FILTER (turn % 4 = 0), 0) AS pending, max(turn) AS modified FROM conversations GROUP BY conv_id")
def agg17_sessions(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.when(F.col("turn") % 4 == 0, ".enriched.json").when(F.col("turn") % 4 == 1, "_raw.json").when(F.col("turn") % 4 == 2, ".json").otherwise(".txt")
    files = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.concat(F.lit("d"), F.col("turn").cast("string"), ending).alias("name"), F.col("turn").alias("modified"))
    return Y.session_list(files)


@query("""WITH d AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id AS session, CAST(sum(n) AS BIGINT) AS hits, count(*) AS nodes, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS trajectory FROM d GROUP BY user_id""")
def agg18_review(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").groupBy(F.col("user_id").alias("session"), F.col("event_type").alias("id")).agg(F.count("*").alias("n"))
    return Y.session_review(d)


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS turns FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM d)
SELECT c_custkey AS "user", round(coalesce(avg(turns), 5), 6) AS baseline FROM customer LEFT JOIN r ON user_id = c_custkey AND k <= 5 GROUP BY c_custkey""")
def agg21_baseline(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").groupBy(F.col("user_id").alias("user"), F.to_date("ts").alias("at")).agg(F.count("*").alias("turns"))
    return Y.duration_baseline(d, table(spark, sf, "customer").select(F.col("c_custkey").alias("user"))).select("user", F.round("baseline", 6).alias("baseline"))


@query(f"""WITH t AS (SELECT doc_id, {T.search_tokens_sql("text")} AS tok FROM documents), u AS (SELECT doc_id, unnest(list_distinct(tok)) AS term FROM t)
SELECT term, count(*) AS df FROM u GROUP BY term HAVING count(*) >= 20""")
def agg22_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "documents").select(F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).where("df >= 20")


@query("WITH e AS (SELECT p_brand AS home, unnest([p_type, p_name]) AS target FROM part) SELECT home, target, count(*) AS n FROM e GROUP BY ALL")
def agg24_cross(spark: SparkSession, sf: str) -> DataFrame:
    return Y.crossings(table(spark, sf, "part").select(F.col("p_brand").alias("home"), F.array("p_type", "p_brand", "p_name").alias("cross")))


@query("""WITH p AS (SELECT conv_id, count(*) FILTER (role = 'system') AS s, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, round(100 * (0.1 * least(s, 1) + 0.4 * least(u / 4, 1) + 0.5 * least(a / 4, 1)), 2) AS pct FROM p""")
def agg25_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress over weighted phases, the current one in part; roles without a weight count nothing."""
    c = table(spark, sf, "conversations").groupBy("conv_id", F.col("role").alias("phase")).agg(F.count("*").alias("done"))
    return Y.progress(c.withColumn("total", F.when(F.col("phase") == "system", 1).otherwise(4)), {"system": 0.1, "user": 0.4, "assistant": 0.5}, "conv_id")


@query("SELECT conv_id, CAST(sum((length(text) + 20) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def agg26_context_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(Y.context_tokens(F.col("text")).alias("tokens"))


@query("""WITH r AS (SELECT o_orderpriority AS bucket, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT bucket, n, o_orderkey AS sample FROM r WHERE k <= 5""")
def agg28_preview(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("bucket"), "o_orderkey")
    return Y.previews(own, "bucket", "o_orderkey", 5)


# -- dedup ----------------------------------------------------------------------------------------
@query("""WITH k AS (SELECT doc_id, trim(text) AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN doc_id ELSE min(doc_id) OVER (PARTITION BY t) END AS survivor, CASE WHEN t = '' THEN 1 ELSE count(*) OVER (PARTITION BY t) END AS size FROM k""")
def ded01_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return D.survivors(docs, F.col("text")).select(F.col("id").alias("doc_id"), "survivor", "size")


@query(f"""{GRAPH}, m AS (SELECT id, 'n' || CAST(ord % 10 AS BIGINT) AS survivor FROM nodes WHERE id LIKE 'n%'),
r AS (SELECT e.type, coalesce(a.survivor, src) AS src, coalesce(b.survivor, dst) AS dst, weight FROM edges e LEFT JOIN m a ON src = a.id LEFT JOIN m b ON dst = b.id)
SELECT type, src, dst, max(weight) AS weight FROM r WHERE src <> dst GROUP BY type, src, dst""")
def ded02_remap(spark: SparkSession, sf: str) -> DataFrame:
    merged = nodes(spark, sf).where("id LIKE 'n%'").select("id", F.concat(F.lit("n"), (F.col("ord") % 10).cast("string")).alias("survivor"))
    return D.remapped(edges(spark, sf), merged, [F.desc("weight")]).select("type", "src", "dst", "weight")


@query("""WITH p AS (SELECT p_partkey, p_brand AS type, lower(trim(p_name)) AS k, p_retailprice AS c FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY type, k ORDER BY c DESC, p_partkey) AS n, min(p_partkey) OVER (PARTITION BY type, k) AS ord FROM p)
SELECT type, k AS label, p_partkey AS id, c AS confidence, ord FROM r WHERE n = 1""")
def ded03_proposals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("type"), F.col("p_name").alias("label"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("confidence"), F.col("p_partkey").alias("ord"))
    return D.best_proposals(rows).select("type", T.label_key(F.col("label")).alias("label"), "id", "confidence", "ord")


@query("""SELECT p_type AS kind, lower(p_name) AS label, min(p_partkey) AS id, max(p_retailprice) AS confidence, string_agg(p_partkey, ',' ORDER BY p_partkey) AS refs, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS aliases FROM part GROUP BY 1, 2""")
def ded04_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(
        F.col("p_type").alias("kind"), F.col("p_name").alias("label"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("confidence"), F.col("p_partkey").alias("ord"),
        F.array(F.col("p_partkey").cast("string")).alias("refs"), F.array("p_brand").alias("aliases"),
    )
    return D.merged_candidates(rows).select("kind", F.col("key").alias("label"), "id", "confidence", F.array_join("refs", ",").alias("refs"), F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


_BUNDLES_SQL = """b AS (SELECT o_orderkey AS id, list_distinct(list('p' || l_partkey)) AS c, count(DISTINCT l_suppkey) AS width FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_BUNDLES_SQL}, x AS (SELECT id, len(c) AS n, unnest(c) AS v FROM b),
h AS (SELECT p.id AS a, q.id AS b FROM x p JOIN x q ON p.v = q.v AND p.id < q.id GROUP BY p.id, q.id HAVING count(*) / (any_value(p.n) + any_value(q.n) - count(*)) >= 0.5),
e AS (SELECT a, b FROM h UNION SELECT b, a FROM h), reach AS (SELECT id, id AS r FROM b UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r),
root AS (SELECT id, min(r) AS root FROM reach GROUP BY id)
SELECT b.id, first_value(b.id) OVER (PARTITION BY root ORDER BY width DESC, b.id) AS canonical FROM b JOIN root USING (id)""")
def ded06_bundle_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    b = o.groupBy(F.col("o_orderkey").alias("id")).agg(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("constraints"), F.collect_set("l_suppkey").alias("depends_on"))
    return D.merged_bundles(b)


@query(f"""{GRAPH}, a AS (SELECT id FROM nodes WHERE type = 'anchor'),
l AS (SELECT 'c' || o_custkey AS anchor, 's' || o_orderkey % 7 AS slab FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000),
m AS (SELECT src AS bundle, dst AS anchor FROM edges WHERE type = 'PARENT_OF' AND weight > 0.7), w AS (SELECT 'n' || s_nationkey AS bundle, count(*) AS w FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
own AS (SELECT anchor, count(DISTINCT slab) AS n, min(slab) AS first FROM l WHERE slab IN (SELECT id FROM nodes WHERE type = 'slab') GROUP BY 1), via AS (SELECT anchor, max(w) AS n FROM m JOIN w USING (bundle) GROUP BY 1),
sem AS (SELECT src AS id FROM edges WHERE type = 'CONFLICTS' UNION SELECT dst FROM edges WHERE type = 'CONFLICTS'),
v AS (SELECT a.id, coalesce(own.n, 0) AS own_reach, coalesce(via.n, 0) AS bundle_reach, own.first, CASE WHEN a.id IN (SELECT id FROM sem) OR coalesce(own.n, 0) >= 2 OR coalesce(via.n, 0) >= 2 THEN 'KEEP' WHEN own.n = 1 THEN 'DEMOTE' ELSE 'ORPHAN' END AS verdict
FROM a LEFT JOIN own ON own.anchor = a.id LEFT JOIN via ON via.anchor = a.id)
SELECT id, own_reach, bundle_reach, verdict, CASE WHEN verdict = 'DEMOTE' THEN first END AS parent FROM v""")
def ded08_consolidation(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors linked to slabs by orders, in bundles by nation, kept by conflicts."""
    n, e = nodes(spark, sf), edges(spark, sf)
    o = table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_totalprice > 300000")
    links = o.select(F.lit("LINKS").alias("type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), (F.col("o_orderkey") % 7).cast("string")).alias("dst"))
    both = e.where("type = 'CONFLICTS'").select("type", "src", "dst").unionByName(links)
    members = e.where("type = 'PARENT_OF' AND weight > 0.7").select(F.col("src").alias("id"), F.col("dst").alias("anchor"))
    wide = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slab"))
    return D.consolidation(n.where("type = 'anchor'"), n.where("type = 'slab'"), both, members, wide)


@query("SELECT label AS id, round(max(CAST(embedding[1] AS DOUBLE)), 6) AS similarity FROM embeddings GROUP BY label")
def ded11_max_per_id(spark: SparkSession, sf: str) -> DataFrame:
    similar = table(spark, sf, "embeddings").select(F.col("label").alias("id"), F.col("embedding")[0].cast("double").alias("similarity"))
    return Y.best_per_id(similar).select("id", F.round("similarity", 6).alias("similarity"))


@query("""WITH s AS (SELECT p_partkey, replace(p_name, ' ', '_') AS slug FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '_' || n END AS new_id FROM r""")
def ded12_slug_ids(spark: SparkSession, sf: str) -> DataFrame:
    slugs = table(spark, sf, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))
    return D.numbered(slugs, [F.col("p_partkey")]).select("p_partkey", "new_id")


@query("""WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS o FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY o) AS k FROM f)
SELECT p_brand, string_agg(p_name, '|' ORDER BY o) AS titles FROM r WHERE k <= 10 GROUP BY p_brand""")
def ded13_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct titles of a cluster in their order, ten at most."""
    return Y.distinct_titles(table(spark, sf, "part"), "p_brand", "p_partkey", "p_name").select("p_brand", F.array_join("titles", "|").alias("titles"))


# -- sets -----------------------------------------------------------------------------------------
@query("""WITH u AS (SELECT p_size AS id, p_brand AS collection, p_partkey AS ord FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY collection, ord) AS n FROM u) SELECT id, collection, ord FROM r WHERE n = 1""")
def set01_merged_view(spark: SparkSession, sf: str) -> DataFrame:
    """The union of collections, the first in sorted order winning an id."""
    return Y.merged_view(table(spark, sf, "part").select(F.col("p_size").alias("id"), F.col("p_brand").alias("collection"), F.col("p_partkey").alias("ord")))


@query("""WITH u AS (SELECT p_size AS id, p_brand AS collection, p_partkey AS ord FROM part WHERE p_brand IN ('Brand#2', 'Brand#17')), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY collection, ord) AS n FROM u) SELECT id, collection, ord FROM r WHERE n = 1""")
def set02_subset(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_size").alias("id"), F.col("p_brand").alias("collection"), F.col("p_partkey").alias("ord"))
    return Y.merged_view(rows, ["Brand#2", "Brand#17"])


@query(f"{GRAPH} SELECT id FROM nodes UNION SELECT src FROM edges UNION SELECT dst FROM edges")
def set03_all_ids(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return Y.all_ids([nodes(spark, sf), e.select(F.col("src").alias("id")), e.select(F.col("dst").alias("id"))])


@query("SELECT DISTINCT source AS collection FROM documents INTERSECT SELECT 'src' || r_regionkey FROM region EXCEPT SELECT 'src0'")
def set04_active(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select(F.col("source").alias("collection"))
    active = table(spark, sf, "region").select(F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("collection"))
    return Y.active_set(active, found, active.where("collection = 'src0'"))


@query(f"{GRAPH} SELECT id FROM nodes WHERE type = 'slab' AND id NOT IN (SELECT dst FROM edges WHERE type = 'INVOKES')")
def set05_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    return Y.unreferenced(nodes(spark, sf).where("type = 'slab'"), edges(spark, sf).where("type = 'INVOKES'").select(F.col("dst").alias("ref")))


@query("WITH u AS (SELECT 'part' AS type, p_partkey AS id FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'nation', n_nationkey FROM nation) SELECT id, count(DISTINCT type) AS types FROM u GROUP BY id HAVING count(DISTINCT type) > 1")
def set06_duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return Y.duplicated_ids({t: table(spark, sf, t).select(F.col(c).cast("long").alias("id")) for t, c in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"))})


@query("SELECT d.doc_id AS id FROM documents d WHERE d.n_chars > 3000 AND d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def set07_scoped(spark: SparkSession, sf: str) -> DataFrame:
    scope = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return Y.within(table(spark, sf, "documents").where("n_chars > 3000").select(F.col("doc_id").alias("id")), scope)


@query("SELECT doc_id AS id FROM documents EXCEPT (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0)")
def set08_excluded(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return Y.without(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), [labels.where("toxic = 1"), labels.where("quality = 0")])
