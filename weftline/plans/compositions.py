"""Queries of composed operators: hybrid ranks, selections, frames, clusters, stores and models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import models as M
from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.operators import graph as G
from weftline.operators import synthesis as Y
from weftline.operators import tallies as Y2
from weftline.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes
from weftline.plans.graphs import _rank_sql
from weftline.plans.registry import Registry
from weftline.session import scratch_root, ship
from weftline.sources import stores
from weftline.sources.tables import table

registry = Registry()
query = registry.query
GRAPH = f"{NODES_SQL}, {EDGES_SQL}"


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' similarity to a probe, by their key as vec_id."""
    probe = table(spark, sf, "embeddings").where("vec_id = 3").select(F.col("embedding").alias("q"))
    e = table(spark, sf, "embeddings").crossJoin(F.broadcast(probe))  # one row
    return e.select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("id"), V.cosine(F.col("embedding"), F.col("q")).alias("similarity"))


_SIM = "sim AS (SELECT 's' || e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 3)"
_DEGREE = "deg AS (SELECT id, count(*) AS score FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id), wsum AS (SELECT src AS id, sum(weight) AS score FROM edges GROUP BY src)"


@query(f"""WITH {GRAPH}, {_SIM}, {_DEGREE} SELECT s.id, round(similarity + CAST(0.5 AS DOUBLE) * coalesce(w.score / (SELECT max(score) FROM wsum), 0) + CAST(0.3 AS DOUBLE) * coalesce(d.score / (SELECT max(score) FROM deg), 0), 6) AS score
FROM sim s LEFT JOIN wsum w ON w.id = s.id LEFT JOIN deg d ON d.id = s.id WHERE similarity >= 0.02 ORDER BY score DESC, s.id LIMIT 15""")
def top05_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity with two graph scores, here weighted out-degree and degree, so that SQL can check the fusion."""
    e = edges(spark, sf)
    personal = e.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("score"))
    general = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").cast("double").alias("score"))
    return Y.hybrid_rank(_similar(spark, sf), personal, general, 15, 0.02).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_SIM} SELECT id, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.55 AND CAST(substr(id, 2) AS INTEGER) % 3 <> 0 ORDER BY similarity DESC, id LIMIT 6")
def top07_divergent(spark: SparkSession, sf: str) -> DataFrame:
    s = _similar(spark, sf)
    key = F.substring("id", 2, 9).cast("int")
    out = Y.divergent(s, s.where(key % 3 == 0).select("id"), s.select("id", F.lit(0.9).alias("confidence")))
    return out.select("id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {GRAPH}, h0 AS (SELECT 'c1' AS id UNION ALL SELECT 's7'),
a AS (SELECT src, dst FROM edges WHERE type IN ('INVOKES', 'SUPPORTS') UNION SELECT dst, src FROM edges WHERE type IN ('INVOKES', 'SUPPORTS')), b AS (SELECT src, dst FROM edges WHERE type IN ('LINKS', 'PARENT_OF') UNION SELECT dst, src FROM edges WHERE type IN ('LINKS', 'PARENT_OF')),
t1 AS (SELECT DISTINCT dst AS id FROM a WHERE src IN (SELECT id FROM h0) AND dst NOT IN (SELECT id FROM h0)), b1 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN (SELECT id FROM h0) AND dst NOT IN (SELECT id FROM h0)),
b2 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN (SELECT id FROM b1) AND dst NOT IN (SELECT id FROM h0 UNION SELECT id FROM b1)),
near AS (SELECT id, 0 AS tier, 0 AS hop FROM h0 UNION ALL SELECT id, 1, 1 FROM t1 UNION ALL SELECT id, 2, 1 FROM b1 UNION ALL SELECT id, 2, 2 FROM b2),
cf AS (SELECT src AS id FROM edges WHERE type = 'CONFLICTS' AND dst IN (SELECT id FROM near) UNION SELECT dst FROM edges WHERE type = 'CONFLICTS' AND src IN (SELECT id FROM near))
SELECT id, CAST(min(tier * 10 + hop) // 10 AS INTEGER) AS tier, CAST(min(tier * 10 + hop) % 10 AS INTEGER) AS hop FROM (SELECT * FROM near UNION ALL SELECT id, 3, 1 FROM cf) GROUP BY id""")
def grf32_selection(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    return Y.selection(n, edges(spark, sf), n.where(F.col("id").isin("c1", "s7")).select("id"), ["INVOKES", "SUPPORTS"], ["LINKS", "PARENT_OF"])


@query(f"""WITH {GRAPH}, w AS (SELECT src AS id, round(avg(weight), 6) AS w FROM edges GROUP BY src) SELECT id, max(how) AS how FROM (SELECT id, 'frame' AS how FROM w WHERE w >= 0.9 UNION ALL SELECT id, 'anchor' FROM nodes WHERE type = 'anchor' AND ord < 5 UNION ALL SELECT id, 'hit' FROM nodes WHERE type = 'slab' AND ord IN (3, 4)) GROUP BY id""")
def grf30_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds from the frame, matched anchors and hits together."""
    n = nodes(spark, sf)
    w = edges(spark, sf).groupBy(F.col("src").alias("id")).agg(F.round(F.avg("weight"), 6).alias("w")).where("w >= 0.9")
    parts = w.select("id", F.lit("frame").alias("how")).unionByName(n.where("type = 'anchor' AND ord < 5").select("id", F.lit("anchor").alias("how"))).unionByName(n.where("type = 'slab' AND ord IN (3, 4)").select("id", F.lit("hit").alias("how")))
    return parts.groupBy("id").agg(F.max("how").alias("how"))


@query("""WITH c AS (SELECT vec_id AS id, label AS block, list_reverse(CAST(embedding AS DOUBLE[])) AS v, 'w' || vec_id % 97 AS lab FROM embeddings), d AS (SELECT vec_id AS id, label AS block, CAST(embedding AS DOUBLE[]) AS v, 'w' || vec_id AS lab FROM embeddings),
x AS (SELECT d.id, min(c.id) AS held_by FROM d JOIN c USING (lab) GROUP BY d.id), s AS (SELECT d.id, c.id AS c, list_cosine_similarity(d.v, c.v) AS s FROM d JOIN c USING (block) WHERE d.id NOT IN (SELECT id FROM x)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, c) AS k FROM s WHERE s > 0.3) SELECT id, held_by FROM x UNION ALL SELECT id, c FROM r WHERE k = 1""")
def ded05_already_held(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("block"))
    name = lambda c: F.concat(F.lit("w"), c.cast("string")).alias("label")
    held = e.select("id", name(F.col("id") % 97), F.reverse("v").alias("v"), "block")  # other vectors under other names
    return Y.already_held(e.select("id", name(F.col("id")), "v", "block"), held, 0.3)


@query(f"""WITH {GRAPH}, a AS (SELECT dst AS anchor, min(src) AS slab, count(DISTINCT src) AS n FROM edges WHERE type = 'PARENT_OF' GROUP BY dst), g AS (SELECT slab, anchor FROM a JOIN nodes ON id = anchor WHERE n = 1 AND ord % 2 = 0 AND type = 'anchor')
SELECT slab, count(*) AS inlined, min(anchor) AS first FROM g GROUP BY slab UNION ALL SELECT 'kept', (SELECT count(*) FROM nodes WHERE type = 'anchor' AND id NOT IN (SELECT anchor FROM g)), CAST((SELECT count(*) FROM edges WHERE src NOT IN (SELECT anchor FROM g) AND dst NOT IN (SELECT anchor FROM g)) AS VARCHAR)""")
def ded09_inline(spark: SparkSession, sf: str) -> DataFrame:
    """Demoted anchors, those of a single parent, written into it, and what is left of the edges."""
    n, e = nodes(spark, sf), edges(spark, sf)
    own = e.where("type = 'PARENT_OF'").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"), F.countDistinct("src").alias("n")).where("n = 1")
    verdicts = n.where("type = 'anchor'").join(own, "id", "left").select("id", "parent", F.when((F.col("ord") % 2 == 0) & F.col("parent").isNotNull(), "DEMOTE").otherwise("KEEP").alias("verdict"))
    kept, left, inline = Y2.inlined(n.where("type = 'anchor'").select("id", F.col("label").alias("phrase")), verdicts, e)
    first = inline.select("slab", F.size("inline").cast("long").alias("inlined"), F.col("inline")[0]["id"].alias("first"))
    rest = kept.agg(F.lit("kept").alias("slab"), F.count("*").alias("inlined")).crossJoin(left.agg(F.count("*").cast("string").alias("first")))  # one row each
    return first.unionByName(rest)


@query()
def vec05_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return Y.cosine_kmeans(own, 8, 4).select(F.col("id").alias("vec_id"), "cluster", F.round("similarity", 6).alias("similarity"))


@query("""WITH s AS (SELECT label AS cluster, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS s FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, id) AS k, count(*) OVER (PARTITION BY cluster) AS size FROM s) SELECT cluster, id, size FROM r WHERE k = 1""")
def vec06_medoids(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("similarity"))
    return Y.medoids(own)


@query("SELECT doc_id, 64 AS size, true AS unit FROM documents")
def vec09_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Default vectors of all documents: their length, and whether it is 1 or the text has no word."""
    ship(spark)
    out = M.embedded(table(spark, sf, "documents").select("doc_id", "text"), "text")
    n = V.norm(F.col("vector"))
    return out.select("doc_id", F.size("vector").alias("size"), ((F.abs(n - 1) < 1e-4) | (n == 0)).alias("unit"))


@query("SELECT p_partkey, p_name AS name FROM part WHERE p_size > 45")
def udf02_extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of an extractor that repeats its prompt, read by a schema."""
    ship(spark)
    own = table(spark, sf, "part").where("p_size > 45").select("p_partkey", "p_name")
    return M.extracted(own, F.col("p_name"), "struct<name:string>", lambda p: {"name": p, "more": 1}).select("p_partkey", "found.name")


@query("SELECT page_id, length(html) > 0 AS ok FROM pages")
def sca05_accent_fold(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    out = table(spark, sf, "pages").select("page_id", M.accent_folded(F.col("html")).alias("f"))
    return out.select("page_id", (F.col("f").rlike("^[a-z0-9 ]+$")).alias("ok"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def sca16_json(spark: SparkSession, sf: str) -> DataFrame:
    """Fenced JSON answers parsed."""
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", F.variant_get(M.json_answer(fenced), "$.k", "bigint").alias("k"))


@query(f"""WITH {GRAPH}, f AS (SELECT 'x' AS session, id, CAST(ord % 7 AS DOUBLE) / 7 AS weight, CAST(ord % 5 AS DOUBLE) / 5 AS smoothed FROM nodes WHERE type = 'slab' AND ord < 30 AND collection = 'supply'), h AS (SELECT 'x' AS session, id, CAST(0.8 AS DOUBLE) AS weight FROM nodes WHERE type = 'anchor' AND ord < 6),
p AS (SELECT h.session, e.dst AS id, h.weight * e.weight * e.confidence * 1.0 AS weight FROM h JOIN edges e ON e.src = h.id AND e.type = 'INVOKES'), l AS (SELECT session, id, max(weight) AS now FROM (SELECT * FROM h UNION ALL SELECT * FROM p) GROUP BY ALL),
b AS (SELECT coalesce(f.session, l.session) AS session, coalesce(f.id, l.id) AS id, greatest(0.1::DOUBLE, f.weight * 0.85::DOUBLE) AS old, f.smoothed AS before, coalesce(now, f.smoothed * 0.9::DOUBLE) AS now, now AS live, f.id AS fid FROM f FULL JOIN l ON f.session = l.session AND f.id = l.id),
s AS (SELECT session, id, CASE WHEN fid IS NULL THEN live WHEN live IS NULL THEN old ELSE greatest(old, live) END AS weight, CASE WHEN before IS NULL THEN now ELSE 0.3::DOUBLE * now + 0.7::DOUBLE * before END AS smoothed FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY smoothed DESC, id) AS k FROM s)
SELECT id, round(weight + 1e-12::DOUBLE, 6) AS weight, round(smoothed + 1e-12::DOUBLE, 6) AS smoothed FROM r WHERE k <= 24""")
def str02_frame_turn(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    frame = n.where("type = 'slab' AND ord < 30 AND collection = 'supply'").select(F.lit("x").alias("session"), "id", ((F.col("ord") % 7) / 7).alias("weight"), ((F.col("ord") % 5) / 5).alias("smoothed"))
    hits = n.where("type = 'anchor' AND ord < 6").select(F.lit("x").alias("session"), "id", F.lit(0.8).alias("weight"))
    out = Y.frame_turn(frame, hits, edges(spark, sf))
    return out.select("id", F.round(F.col("weight") + 1e-12, 6).alias("weight"), F.round(F.col("smoothed") + 1e-12, 6).alias("smoothed"))


@query("""WITH d AS (SELECT label AS session, vec_id AS id, vec_id AS raised, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.id, b.id AS "by", list_cosine_similarity(a.v, b.v) AS s FROM d a JOIN d b USING (session) WHERE b.raised >= a.raised + 20 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, "by") AS k FROM p WHERE s >= 0.4) SELECT id, "by" FROM r WHERE k = 1""")
def joi14_supersession(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "embeddings").select(F.col("label").alias("session"), F.col("vec_id").alias("id"), F.col("vec_id").alias("raised"), F.col("embedding").alias("v"))
    return Y.superseding(d.withColumn("reference_turn", F.col("raised") + 20), d)


def _store(spark: SparkSession, sf: str) -> str:
    root = f"{scratch_root(spark)}/store-{uuid.uuid4().hex}"
    n = nodes(spark, sf)
    for k, name in enumerate(("geo", "supply", "building")):
        part = n.where(F.col("collection") == name).select("id", "type", "label")
        stores.save_collection({"anchors": part, "pillars": part.limit(0)}, root, name, 1)
        stores.publish(spark, root, name, 1, active=k < 2)
    return root


@query(f"WITH {GRAPH} SELECT collection, count(*) AS n FROM nodes WHERE collection IN ('geo', 'supply') GROUP BY collection")
def snk02_collections(spark: SparkSession, sf: str) -> DataFrame:
    """Collections written, published and read again: only the active ones."""
    return stores.load(spark, _store(spark, sf), "anchors").groupBy("collection").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_brand AS brand, p_type AS type FROM part")
def snk05_append_new(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends of overlapping rows, each key once."""
    path = f"{scratch_root(spark)}/append-{uuid.uuid4().hex}"
    p = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), "p_size")
    stores.append_new(path, p.where("p_size < 30").drop("p_size"), ["brand", "type"])
    stores.append_new(path, p.where("p_size >= 20").drop("p_size"), ["brand", "type"])
    return spark.read.parquet(path)


@query("""WITH r AS (SELECT p_brand AS id, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS k FROM part) SELECT id, p_partkey, p_name FROM r WHERE k = 1""")
def src02_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "part").select(F.col("p_brand").alias("id"), "p_partkey", "p_name")
    return stores.last_wins(own, "id", [F.col("p_partkey")])


@query(_rank_sql("SELECT id, CASE WHEN type = 'bundle' THEN CAST(1 AS DOUBLE) / (SELECT count(*) FROM nodes WHERE type = 'bundle') ELSE 0 END AS t FROM nodes", 5))
def grf02_power_iteration(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    return G.power_iteration(n, edges(spark, sf), n.where("type = 'bundle'").select("id"), rounds=5, tolerance=0).select("id", F.round("score", 9).alias("score"))


@query(f"""WITH {GRAPH}, m AS (SELECT collection, string_agg(id, ',' ORDER BY id) AS members, count(*) AS n FROM nodes GROUP BY collection) SELECT collection, n, substr(md5(members), 1, 12) AS digest FROM m""")
def grf17_label_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A key of each cluster's member set: labels are kept while it stays the same."""
    m = nodes(spark, sf).groupBy("collection").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("m"), F.count("*").alias("n"))
    return m.select("collection", "n", F.substring(F.md5("m"), 1, 12).alias("digest"))


@query("SELECT l_suppkey AS slab, l_partkey % 40 AS bundle, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_quantity > 40 GROUP BY ALL")
def grf33_bundle_edges(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    own = table(spark, sf, "lineitem").where("l_quantity > 40").join(known, "l_suppkey", "left_semi")
    return own.groupBy(F.col("l_suppkey").alias("slab"), (F.col("l_partkey") % 40).alias("bundle")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT conv_id, turn, role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS ar FROM conversations) SELECT conv_id, turn, length(answer) AS answer_chars FROM w WHERE role = 'assistant' AND ar = 'user'""")
def str03_pushes(spark: SparkSession, sf: str) -> DataFrame:
    """Challenges with the user's next turn, which resolves them."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    m = table(spark, sf, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("ar", F.lead("role").over(w))
    return m.where("role = 'assistant' AND ar = 'user'").select("conv_id", "turn", F.length("answer").cast("long").alias("answer_chars"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '—', '-'), '…', '...'), '‘', chr(39)), '’', chr(39)), '“', chr(34)), '”', chr(34)), '–', '-'), '→', '->'), chr(160), ' ')) AS folded FROM documents")
def sca07_punctuation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.fold_punctuation(F.col("text"))).alias("folded"))


@query("SELECT doc_id, CAST(CASE WHEN strpos(text, 'License') > 0 THEN 1000000000 + strpos(text, 'License') - 1 ELSE doc_id END AS BIGINT) AS ord FROM documents")
def sca12_source_order(spark: SparkSession, sf: str) -> DataFrame:
    """Order by where a quote stands in its segment, else by the candidate's number."""
    at = F.locate("License", F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.when(at > 0, F.lit(1_000_000_000) + at - 1).otherwise(F.col("doc_id")).cast("long").alias("ord"))


@query("""WITH f AS (SELECT DISTINCT p_brand AS id, p_type AS slug FROM part), m AS (SELECT slug, max(id) AS parent FROM f GROUP BY slug) SELECT slug, parent FROM m""")
def joi30_nesting(spark: SparkSession, sf: str) -> DataFrame:
    """Children by slug with their parent, the last one winning."""
    f = table(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_type").alias("slug")).distinct()
    return f.groupBy("slug").agg(F.max("id").alias("parent"))


@query("""WITH o AS (SELECT p_brand AS id, list_sort(list_distinct(list(p_type))) AS a FROM part WHERE p_size < 20 GROUP BY p_brand), n AS (SELECT p_brand AS id, list_sort(list_distinct(list(p_type))) AS b FROM part WHERE p_size > 10 GROUP BY p_brand)
SELECT id, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed FROM o JOIN n USING (id)""")
def joi29_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What a rewrite added to and removed from each row's list."""
    p = table(spark, sf, "part")
    o = p.where("p_size < 20").groupBy(F.col("p_brand").alias("id")).agg(F.collect_set("p_type").alias("a"))
    n = p.where("p_size > 10").groupBy(F.col("p_brand").alias("id")).agg(F.collect_set("p_type").alias("b"))
    return o.join(n, "id").select("id", F.size(F.array_except("b", "a")).cast("long").alias("added"), F.size(F.array_except("a", "b")).cast("long").alias("removed"))

