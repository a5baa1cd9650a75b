"""Graph and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import vectors as V
from weftline.operators import graph as G
from weftline.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query
GRAPH = f"{NODES_SQL}, {EDGES_SQL}"
STEPS = """w AS (SELECT src, dst, CASE WHEN coalesce(weight, 0) = 0 THEN 1 ELSE weight END AS w FROM edges), b AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w) GROUP BY ALL),
p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM b)"""


def _rank_sql(teleport: str, rounds: int) -> str:
    parts = [f"WITH {GRAPH}, {STEPS}, t AS ({teleport}), r0 AS (SELECT id, t AS r FROM t)"]
    for i in range(1, rounds + 1):
        parts.append(
            f"l{i} AS MATERIALIZED (SELECT coalesce(sum(r), 0) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT src FROM p)), "
            f"f{i} AS MATERIALIZED (SELECT dst, sum(r * p) AS inflow FROM r{i - 1} JOIN p ON id = src GROUP BY dst), "
            f"r{i} AS MATERIALIZED (SELECT t.id, CAST(0.85 AS DOUBLE) * (coalesce(inflow, 0) + lost / (SELECT count(*) FROM nodes)) + CAST(0.15 AS DOUBLE) * t AS r FROM t LEFT JOIN f{i} ON t.id = dst, l{i})"
        )
    return ", ".join(parts) + f" SELECT id, round(r, 9) AS score FROM r{rounds}"


@query(f"WITH {GRAPH}, {STEPS} SELECT src, dst, round(p, 9) AS p FROM p")
def grf01_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return G.transitions(nodes(spark, sf), edges(spark, sf)).select("src", "dst", F.round("p", 9).alias("p"))


@query(_rank_sql("SELECT id, CAST(1 AS DOUBLE) / (SELECT count(*) FROM nodes) AS t FROM nodes", 10))
def grf03_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """Ten rounds, so that SQL can unroll them."""
    return G.power_iteration(nodes(spark, sf), edges(spark, sf), rounds=10, tolerance=0).select("id", F.round("score", 9).alias("score"))


@query(_rank_sql("SELECT id, CASE WHEN id IN ('c1', 'c2', 's3') THEN CAST(1 AS DOUBLE) / 3 ELSE 0 END AS t FROM nodes", 10))
def grf04_personalised(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    return G.power_iteration(n, edges(spark, sf), n.where(F.col("id").isin("c1", "c2", "s3")).select("id"), rounds=10, tolerance=0).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {GRAPH}, d AS (SELECT src AS id, sum(weight) AS score FROM edges GROUP BY src) SELECT id, round(score / max(score) OVER (), 9) AS score FROM d")
def grf05_normalised(spark: SparkSession, sf: str) -> DataFrame:
    d = edges(spark, sf).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("score"))
    return G.peak_normalised(d).select("id", F.round("score", 9).alias("score"))


_IDS = "ids AS (SELECT id FROM nodes WHERE collection IN ('geo', 'supply', 'building'))"


@query(f"WITH {GRAPH}, {_IDS} SELECT type, src, dst, weight FROM edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)")
def grf06_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    return G.subgraph(n, edges(spark, sf), n.where("collection IN ('geo', 'supply', 'building')"))[1].select("type", "src", "dst", "weight")


@query(f"""WITH {GRAPH}, s AS (SELECT src, dst, type FROM edges WHERE type IN ('INVOKES', 'LINKS', 'SUPPORTS') UNION ALL SELECT dst, src, type FROM edges WHERE type IN ('INVOKES', 'LINKS', 'SUPPORTS')),
h0 AS (SELECT unnest(['c1', 's7', 'r2']) AS id), h1 AS (SELECT dst AS id, min({{'type': type, 'src': src}}) AS via FROM s WHERE src IN (SELECT id FROM h0) AND dst NOT IN (SELECT id FROM h0) GROUP BY dst),
h2 AS (SELECT dst AS id, min({{'type': type, 'src': src}}) AS via FROM s WHERE src IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1) GROUP BY dst)
SELECT id, 0 AS hop, NULL AS via_type, NULL AS via_src FROM h0 UNION ALL SELECT id, 1, via.type, via.src FROM h1 UNION ALL SELECT id, 2, via.type, via.src FROM h2""")
def grf07_bfs(spark: SparkSession, sf: str) -> DataFrame:
    seeds = nodes(spark, sf).where(F.col("id").isin("c1", "s7", "r2")).select("id")
    return G.typed_walk(edges(spark, sf), seeds, ["INVOKES", "LINKS", "SUPPORTS"])


@query()
def grf08_subspace(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.budgeted_subspace(nodes(spark, sf), edges(spark, sf), ["c1", "n3"])
    return spark.createDataFrame(rows, "id string, hop int, type string")


@query(f"WITH {GRAPH}, ids AS (SELECT id FROM nodes WHERE id LIKE 's%') SELECT DISTINCT unnest([src, dst]) AS id FROM edges WHERE type = 'CONFLICTS' AND (src IN (SELECT id FROM ids) OR dst IN (SELECT id FROM ids))")
def grf09_conflict_ends(spark: SparkSession, sf: str) -> DataFrame:
    ids = nodes(spark, sf).where("id LIKE 's%'").select("id")
    c = edges(spark, sf).where("type = 'CONFLICTS'").select("src", "dst")
    hit = c.join(ids.select(F.col("id").alias("src")), "src", "left_semi").unionByName(c.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
    return hit.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@query(f"""WITH {GRAPH}, ids AS (SELECT id FROM nodes WHERE id LIKE 's%' OR id = 'c7'), c AS (SELECT src, dst, src IN (SELECT id FROM ids) AS si, dst IN (SELECT id FROM ids) AS di FROM edges WHERE type = 'CONFLICTS')
SELECT src AS id, dst AS partner FROM c WHERE di UNION SELECT dst, src FROM c WHERE si""")
def grf10_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return G.conflicts(edges(spark, sf), nodes(spark, sf).where("id LIKE 's%' OR id = 'c7'"))


@query(f"""WITH RECURSIVE {GRAPH}, e AS (SELECT src AS a, dst AS b FROM edges WHERE type = 'SEQUENCE' UNION SELECT dst, src FROM edges WHERE type = 'SEQUENCE'),
reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r), c AS (SELECT id, min(r) AS component FROM reach GROUP BY id)
SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM c""")
def grf11_components(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(nodes(spark, sf), edges(spark, sf).where("type = 'SEQUENCE'"))


@query(f"""WITH {GRAPH}, c AS (SELECT dst AS id, count(*) AS n FROM edges WHERE type = 'PARENT_OF' GROUP BY dst)
SELECT nodes.id, CASE WHEN nodes.id LIKE 'c%' THEN 2 WHEN nodes.id LIKE 'n%' THEN 1 ELSE 0 END AS depth FROM nodes""")
def grf12_topological(spark: SparkSession, sf: str) -> DataFrame:
    needs = edges(spark, sf).where("type IN ('PARENT_OF', 'SUPPORTS')").select(F.col("dst").alias("id"), F.col("src").alias("dep"))
    return G.depths(nodes(spark, sf), needs)


@query()
def grf13_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of the graph; those under three members are one."""
    return G.coalesced(G.label_communities(nodes(spark, sf), edges(spark, sf)))


@query(f"WITH {GRAPH}, s AS (SELECT collection, type, count(*) AS n FROM nodes GROUP BY ALL) SELECT id, CASE WHEN n < 30 THEN 'Misc' ELSE collection || '/' || nodes.type END AS community FROM nodes JOIN s USING (collection, type)")
def grf14_coalesced(spark: SparkSession, sf: str) -> DataFrame:
    return G.coalesced(nodes(spark, sf).select("id", F.concat_ws("/", "collection", "type").alias("community")), 30)


@query(f"WITH {GRAPH} SELECT id, dense_rank() OVER (ORDER BY collection) - 1 || ',' || (row_number() OVER (PARTITION BY collection ORDER BY id) - 1) % 4 AS path FROM nodes")
def grf15_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Node to cluster path, as a key; collections are few, so they are numbered in one window and joined back."""
    n = nodes(spark, sf)
    c = n.select("collection").distinct().withColumn("a", F.row_number().over(W.orderBy("collection")) - 1)
    b = (F.row_number().over(W.partitionBy("collection").orderBy("id")) - 1) % 4
    return n.withColumn("b", b).join(F.broadcast(c), "collection").select("id", F.concat_ws(",", F.col("a").cast("string"), F.col("b").cast("string")).alias("path"))


@query(f"WITH {GRAPH} SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, bit_xor(CAST('0x' || substr(md5(id), 1, 15) AS BIGINT)) AS digest FROM nodes")
def grf16_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return G.fingerprint(nodes(spark, sf), edges(spark, sf))


@query(f"""WITH {GRAPH}, m AS (SELECT id, id IN (SELECT dst FROM edges) AS i, id IN (SELECT src FROM edges) AS o FROM nodes) SELECT id, CASE WHEN NOT i AND NOT o THEN 'both' WHEN NOT i THEN 'in' ELSE 'out' END AS missing FROM m WHERE NOT i OR NOT o""")
def grf18_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return G.orphans(nodes(spark, sf), edges(spark, sf))


_KERNEL = "CASE e.type " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in G.KERNEL.items()) + " ELSE 0.5 END"
_ONE = "one AS (SELECT src, dst, arg_max({'type': type, 'weight': weight, 'confidence': confidence}, {'type': type, 'weight': weight}) AS e FROM edges GROUP BY src, dst)"


@query(f"WITH {GRAPH}, {_ONE} SELECT src, dst, round(e.weight * e.confidence * {_KERNEL.replace('e.type', 'e.type')}, 6) AS strength FROM one")
def grf19_strength(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return G.cascade_strength(e.select("src", "dst").distinct(), e, 0.5).select("src", "dst", F.round("strength", 6).alias("strength"))


@query(f"""WITH {GRAPH}, {_ONE}, st AS (SELECT id, CAST(1 AS DOUBLE) / (1 + ord) AS weight FROM nodes WHERE type = 'anchor' AND ord < 50),
ps AS (SELECT o.dst AS id, st.weight * o.e.weight * o.e.confidence * {_KERNEL} AS weight FROM one o JOIN st ON st.id = o.src WHERE EXISTS (SELECT 1 FROM edges x WHERE x.type = 'INVOKES' AND x.src = o.src AND x.dst = o.dst))
SELECT id, round(max(weight), 6) AS weight FROM (SELECT * FROM st UNION ALL SELECT * FROM ps) GROUP BY id""")
def grf20_cascade(spark: SparkSession, sf: str) -> DataFrame:
    start = nodes(spark, sf).where("type = 'anchor' AND ord < 50").select("id", (1.0 / (1 + F.col("ord"))).alias("weight"))
    return G.activated(start, edges(spark, sf)).select("id", F.round("weight", 6).alias("weight"))


@query(f"""WITH {GRAPH}, s AS (SELECT id, CAST(ord % 10 AS DOUBLE) / 10 AS salience FROM nodes), b AS (SELECT dst AS id, sum(s.salience * weight * confidence * CAST(0.05 AS DOUBLE)) AS b FROM edges JOIN s ON s.id = src WHERE edges.type = 'SUPPORTS' GROUP BY dst)
SELECT s.id, round(least(1, salience + coalesce(b, 0)), 6) AS salience FROM s LEFT JOIN b ON s.id = b.id""")
def grf21_reinforced(spark: SparkSession, sf: str) -> DataFrame:
    s = nodes(spark, sf).select("id", ((F.col("ord") % 10) / 10).alias("salience"))
    return G.reinforced(s, edges(spark, sf)).select("id", F.round("salience", 6).alias("salience"))


@query(f"""WITH {GRAPH}, s AS (SELECT id, CAST(ord % 10 AS DOUBLE) / 10 AS salience FROM nodes) SELECT e.src, e.dst, e.weight AS tension, round(abs(a.salience - b.salience), 6) AS gap FROM edges e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst WHERE e.type IN ('CONFLICTS', 'TENSIONS')""")
def grf22_tensions(spark: SparkSession, sf: str) -> DataFrame:
    s = nodes(spark, sf).select("id", ((F.col("ord") % 10) / 10).alias("salience"))
    e = edges(spark, sf).where("type IN ('CONFLICTS', 'TENSIONS')")
    e = e.join(s.select(F.col("id").alias("src"), F.col("salience").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("salience").alias("b")), "dst")
    return e.select("src", "dst", F.col("weight").alias("tension"), F.round(F.abs(F.col("a") - F.col("b")), 6).alias("gap"))


@query(f"WITH {GRAPH}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM edges WHERE type = 'SEQUENCE') SELECT src, dst FROM r WHERE k = 1")
def grf25_spine(spark: SparkSession, sf: str) -> DataFrame:
    return G.spine(edges(spark, sf))


@query(f"""WITH {GRAPH}, f AS (SELECT dst AS child, min(src) AS parent FROM edges WHERE type = 'PARENT_OF' GROUP BY dst), s AS (SELECT child, parent, row_number() OVER (PARTITION BY parent ORDER BY child) - 1 AS slot, count(*) OVER (PARTITION BY parent) AS slots FROM f)
SELECT child, parent, slot, round(cos(2 * pi() * slot / slots), 6) + 0.0 AS x, round(sin(2 * pi() * slot / slots), 6) + 0.0 AS y FROM s""")
def grf26_orbit(spark: SparkSession, sf: str) -> DataFrame:
    f = edges(spark, sf).where("type = 'PARENT_OF'").groupBy(F.col("dst").alias("child")).agg(F.min("src").alias("parent"))
    s = f.withColumn("slot", F.row_number().over(W.partitionBy("parent").orderBy("child")) - 1).withColumn("slots", F.count("*").over(W.partitionBy("parent")))
    return G.orbit(s, F.col("slot"), F.col("slots")).select("child", "parent", "slot", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query("""SELECT 'r' || n_regionkey AS pillar, count(DISTINCT n_nationkey) AS children, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey""")
def grf27_pillars(spark: SparkSession, sf: str) -> DataFrame:
    """Members of a pillar with those of its descendants."""
    e = edges(spark, sf)
    top = e.where("type = 'SUPPORTS'").select(F.col("src").alias("pillar"), F.col("dst").alias("child"))
    low = e.where("type = 'PARENT_OF'").groupBy(F.col("src").alias("child")).agg(F.count("*").alias("m"))
    return top.join(low, "child", "left").groupBy("pillar").agg(F.countDistinct("child").alias("children"), F.coalesce(F.sum("m"), F.lit(0)).alias("members"))


@query(f"""WITH {GRAPH}, pr AS (SELECT DISTINCT 'LINKS' AS type, 's' || l_suppkey AS src, 'n' || l_partkey % 25 AS dst FROM lineitem WHERE l_quantity > 48)
SELECT type, src, dst, lower(type) || '_' || src || '_' || dst AS id FROM pr WHERE (type, src, dst) NOT IN (SELECT type, src, dst FROM edges)""")
def grf29_commit_edges(spark: SparkSession, sf: str) -> DataFrame:
    proposed = table(spark, sf, "lineitem").where("l_quantity > 48").select(F.lit("LINKS").alias("type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("l_partkey") % 25).cast("string")).alias("dst"))
    return G.new_edges(proposed, edges(spark, sf)).select("type", "src", "dst", "id")


# -- vectors --------------------------------------------------------------------------------------
@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings")
def vec01_normalised(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.normalised(F.col("embedding"))[0], 6).alias("first"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec02_cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(V.cosine(F.col("u"), F.col("v")), 6).alias("similarity"))


@query("""WITH p AS (SELECT CAST(l.embedding AS DOUBLE[]) AS lo, CAST(h.embedding AS DOUBLE[]) AS hi FROM embeddings l, embeddings h WHERE l.vec_id = 0 AND h.vec_id = 1),
x AS (SELECT vec_id, list_transform(list_zip(CAST(embedding AS DOUBLE[]), lo), lambda z: z[1] - z[2]) AS v, list_transform(list_zip(hi, lo), lambda z: z[1] - z[2]) AS a FROM embeddings, p)
SELECT vec_id, round(greatest(0, least(1, list_dot_product(v, a) / list_dot_product(a, a))), 6) AS position FROM x""")
def vec04_axis(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    poles = e.where("vec_id = 0").select(F.col("embedding").alias("lo")).crossJoin(F.broadcast(e.where("vec_id = 1").select(F.col("embedding").alias("hi"))))  # one row each
    return e.crossJoin(F.broadcast(poles)).select("vec_id", F.round(V.axis_position(F.col("embedding"), F.col("lo"), F.col("hi")), 6).alias("position"))


_CENTRES = "c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, i) GROUP BY label)"


def centres(spark: SparkSession, sf: str) -> DataFrame:
    """(label, c): mean vector of each label, summed by position before it is gathered."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


@query(f"""WITH {_CENTRES}, s AS (SELECT e.vec_id, e.label AS home, c.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c) AS s FROM embeddings e, c), h AS (SELECT vec_id, s AS hs FROM s WHERE home = label),
r AS (SELECT s.home, s.label AS target, row_number() OVER (PARTITION BY s.vec_id ORDER BY s.s DESC, s.label) AS k FROM s JOIN h USING (vec_id) WHERE s.label <> s.home AND s.s >= hs - 0.06) SELECT home, target, count(*) AS n FROM r WHERE k <= 2 GROUP BY ALL""")
def vec07_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Members almost as near to another cluster as to their own, by pair; clusters are few, so their centres are broadcast."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("home"), "embedding")
    sims = e.crossJoin(F.broadcast(centres(spark, sf))).select("vec_id", "home", "label", V.cosine(F.col("embedding"), F.col("c")).alias("s"))
    own = F.max(F.when(F.col("home") == F.col("label"), F.col("s"))).over(W.partitionBy("vec_id"))
    near = sims.withColumn("hs", own).where("label <> home AND s >= hs - 0.06")
    k = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("s"), "label"))
    return near.withColumn("k", k).where("k <= 2").groupBy("home", F.col("label").alias("target")).agg(F.count("*").alias("n"))


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vec08_to_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a cached vector: only these are embedded."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query(f"""WITH {_CENTRES}, s AS (SELECT e.vec_id, c.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c) AS s FROM embeddings e, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM s)
SELECT vec_id, label AS nearest, round(s, 6) AS similarity, CASE WHEN s >= 0.85 THEN 'same' WHEN s >= 0.75 THEN 'child' WHEN s >= 0.70 THEN 'related' ELSE 'novel' END AS relation FROM b WHERE k = 1""")
def vec10_novelty(spark: SparkSession, sf: str) -> DataFrame:
    sims = table(spark, sf, "embeddings").select("vec_id", "embedding").crossJoin(F.broadcast(centres(spark, sf))).select("vec_id", "label", V.cosine(F.col("embedding"), F.col("c")).alias("s"))
    k = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("s"), "label"))
    relation = F.when(F.col("s") >= 0.85, "same").when(F.col("s") >= 0.75, "child").when(F.col("s") >= 0.70, "related").otherwise("novel")
    return sims.withColumn("k", k).where("k = 1").select("vec_id", F.col("label").alias("nearest"), F.round("s", 6).alias("similarity"), relation.alias("relation"))
