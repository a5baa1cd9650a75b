"""Queries of proposals, their corpora and consolidation, and of the verbs that decide on drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import activation as A
from weftline.operators import lifecycle as L
from weftline.operators import proposals as P
from weftline.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query
GRAPH = f"{NODES_SQL}, {EDGES_SQL}"
_SLABS = 1_000_000


def _proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as anchors (some without a phrase), suppliers as slabs (some without a text), nations as bundles of anchors."""
    none = F.lit(None).cast("string")
    p, s, n = (table(spark, sf, t) for t in ("part", "supplier", "nation"))
    text = lambda *c: F.concat(*c)
    number = lambda c: F.col(c).cast("string")
    anchors = p.select(
        F.col("p_partkey").cast("long").alias("ord"), F.lit("anchor").alias("type"), F.when(F.col("p_partkey") % 50 == 0, " ").otherwise(text("p_name", F.lit(" no "), number("p_partkey"))).alias("phrase"), none.alias("title"), none.alias("text"), none.alias("label"),
        F.array(F.md5(number("p_partkey"))).alias("aliases"), F.lit("").alias("description"), F.col("p_brand").alias("justification"), F.lit(0.7).alias("confidence"),
    )
    slabs = s.select(
        (F.col("s_suppkey") + _SLABS).cast("long").alias("ord"), F.lit("slab").alias("type"), none.alias("phrase"), F.md5("s_name").alias("title"), F.when(F.col("s_suppkey") % 9 == 0, "").otherwise(text(F.lit("text of "), "s_name")).alias("text"), none.alias("label"),
        F.array().cast("array<string>").alias("aliases"), F.lit("").alias("description"), F.lit("seen").alias("justification"), F.lit(0.8).alias("confidence"),
    )
    bundles = n.select(
        (F.col("n_nationkey") + 2 * _SLABS).cast("long").alias("ord"), F.lit("bundle").alias("type"), none.alias("phrase"), none.alias("title"), none.alias("text"), F.col("n_name").alias("label"),
        F.array(F.md5(number("n_nationkey")), F.upper(F.md5((F.col("n_nationkey") + 25).cast("string"))), F.lit("n/a")).alias("aliases"), F.lit("").alias("description"), F.lit("").alias("justification"), F.lit(0.9).alias("confidence"),
    )
    return anchors.unionByName(slabs).unionByName(bundles)


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as relations between a part and a supplier by label; some ends are labels of nothing."""
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_linenumber") == 1, "links").when((F.col("l_linenumber") == 2) & (F.col("l_partkey") % 3 == 0), "supports").otherwise("SEQUENCE")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ord"), kind.alias("type"), F.md5(F.col("l_partkey").cast("string")).alias("from_label"),
        F.when(F.col("l_quantity") == 7, "##").otherwise(F.concat(F.lit(" "), F.upper(F.md5(F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")))))).alias("to_label"), F.col("l_discount").cast("double").alias("confidence"),
    )


_PROPOSED = f"""an AS (SELECT CAST(p_partkey AS BIGINT) AS ord, 'draft_anchor_' || p_partkey AS id, p_name || ' no ' || p_partkey AS phrase, md5(CAST(p_partkey AS VARCHAR)) AS alias FROM part WHERE p_partkey % 50 <> 0),
sl AS (SELECT CAST(s_suppkey + {_SLABS} AS BIGINT) AS ord, 'draft_slab_' || (s_suppkey + {_SLABS}) AS id, s_name AS title FROM supplier WHERE s_suppkey % 9 <> 0),
rl AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord, CASE WHEN l_linenumber = 1 THEN 'LINKS' WHEN l_linenumber = 2 AND l_partkey % 3 = 0 THEN 'SUPPORTS' ELSE 'SEQUENCE' END AS type, l_partkey, l_suppkey, l_quantity = 7 AS odd, CAST(l_discount AS DOUBLE) AS confidence FROM lineitem),
ed AS (SELECT rl.ord, type, a.id AS src, s.id AS dst, confidence FROM rl JOIN an a ON a.alias = md5(CAST(l_partkey AS VARCHAR)) JOIN sl s ON NOT odd AND s.ord = l_suppkey + {_SLABS})"""


@query(f"WITH {_PROPOSED} SELECT ord, type, src, dst, confidence FROM ed")
def prj33_temporary(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of a draft's temporary corpus."""
    return P.temporary_corpus(_proposals(spark, sf), _relations(spark, sf))["edges"].select("ord", "type", "src", "dst", "confidence")


_VERDICTS = f"""{_PROPOSED}, own AS (SELECT src AS id, count(DISTINCT dst) AS n, min(dst) AS first FROM ed WHERE type = 'LINKS' GROUP BY 1), sem AS (SELECT DISTINCT src AS id FROM ed WHERE type = 'SUPPORTS'),
mem AS (SELECT n_nationkey AS b, a.id FROM nation JOIN an a ON a.alias IN (md5(CAST(n_nationkey AS VARCHAR)), md5(CAST(n_nationkey + 25 AS VARCHAR)))),
wid AS (SELECT b, count(DISTINCT dst) AS w FROM mem JOIN ed ON ed.src = mem.id AND ed.type = 'LINKS' GROUP BY b), via AS (SELECT id, max(w) AS w FROM mem JOIN wid USING (b) GROUP BY id),
vd AS (SELECT an.*, CASE WHEN sem.id IS NOT NULL OR coalesce(own.n, 0) >= 2 OR coalesce(via.w, 0) >= 2 THEN 'KEEP' WHEN own.n = 1 THEN 'DEMOTE' ELSE 'ORPHAN' END AS verdict, own.first FROM an LEFT JOIN own USING (id) LEFT JOIN sem USING (id) LEFT JOIN via USING (id))"""


@query(f"WITH {_VERDICTS} SELECT ord, verdict FROM vd")
def ded10_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    corpus = P.temporary_corpus(_proposals(spark, sf), _relations(spark, sf))
    return P.analysed(corpus).join(corpus["anchors"].select("id", "ord"), "id").select("ord", "verdict")


@query(f"""WITH {_VERDICTS} SELECT count(*) AS anchors, count(*) FILTER (verdict = 'KEEP') AS kept, count(*) FILTER (verdict = 'DEMOTE') AS demoted, count(*) FILTER (verdict = 'ORPHAN') AS orphans,
(SELECT count(*) FROM rl WHERE l_partkey IN (SELECT ord FROM vd WHERE verdict <> 'KEEP')) AS edges_dropped, (SELECT count(*) FROM vd WHERE verdict = 'DEMOTE') AS inlined FROM vd""")
def ded10_applied(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of a draft's consolidation, and the anchors written into slabs."""
    out = P.consolidated(_proposals(spark, sf), _relations(spark, sf))
    return out["summary"].crossJoin(out["inline"].agg(F.count("*").alias("inlined")))  # one row each


@query(f"WITH {_PROPOSED}, e AS (SELECT unnest([CASE WHEN a.id IS NULL THEN 'miss' ELSE 'exact' END, CASE WHEN s.id IS NULL THEN 'miss' ELSE 'exact' END]) AS strategy FROM rl LEFT JOIN an a ON a.alias = md5(CAST(l_partkey AS VARCHAR)) LEFT JOIN sl s ON NOT odd AND s.ord = l_suppkey + {_SLABS}) SELECT strategy, count(*) AS n FROM e GROUP BY 1")
def joi05_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """How the ends of all pushed relations were found, from labels that are whole or of nothing like any."""
    own = P._named(_proposals(spark, sf), F.concat(F.lit("draft_"), "type", F.lit("_"), F.col("ord").cast("string")))
    return P.strategy_counts(P.resolved_relations(_relations(spark, sf), P.labels_of(own)))


@query(f"WITH {_PROPOSED} SELECT (SELECT count(*) FROM an) AS anchors, (SELECT count(*) FROM sl) AS slabs, (SELECT count(*) FROM nation) AS bundles, (SELECT count(*) FROM ed) AS edges, (SELECT count(*) FROM rl) - (SELECT count(*) FROM ed) AS dropped")
def prj36_committed(spark: SparkSession, sf: str) -> DataFrame:
    c = P.committed_corpus(_proposals(spark, sf), _relations(spark, sf))
    out = c["anchors"].agg(F.count("*").alias("anchors"))
    for name in ("slabs", "bundles", "edges", "dropped"):
        out = out.crossJoin(c[name].agg(F.count("*").alias(name)))  # one row each
    return out


@query("""WITH a AS (SELECT 'mined_anchor_' || substr(sha1(lower(p_name)), 1, 10) || '_v1' AS id, p_name AS phrase, substr(p_brand, 1, 240) AS notes, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS k FROM part),
s AS (SELECT 'mined_slab_' || substr(sha1(lower(p_type || 'all of ' || p_type)), 1, 10) || '_v1' AS id, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part)
SELECT id, phrase AS name, notes, CAST(0 AS BIGINT) AS inlined FROM a WHERE k = 1 UNION ALL SELECT id, p_type, 'seen', (SELECT count(*) FROM nation WHERE n_regionkey = length(s.p_type) % 5) FROM s WHERE k = 1""")
def prj35_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as proposals of their name and of their type, under ids of their content, nations inlined."""
    p = table(spark, sf, "part")
    none = F.lit(None).cast("string")
    anchors = p.select(F.col("p_partkey").alias("ord"), F.lit("anchor").alias("type"), F.col("p_name").alias("phrase"), none.alias("title"), none.alias("text"), F.array().cast("array<string>").alias("aliases"), F.col("p_brand").alias("justification"))
    slabs = p.select("p_partkey", F.lit("slab"), none, "p_type", F.concat(F.lit("all of "), "p_type"), F.array().cast("array<string>"), F.lit("seen"))
    kinds = p.select(F.col("p_type").alias("title"), (F.length("p_type") % 5).alias("k")).distinct()
    inline = kinds.join(table(spark, sf, "nation"), F.col("k") == F.col("n_regionkey")).select("title", F.col("n_nationkey").alias("ord"), F.col("n_name").alias("phrase"), F.array().cast("array<string>").alias("aliases"))
    out = P.fresh_corpus(anchors.union(slabs), inline)
    a = out["anchors"].select("id", F.col("phrase").alias("name"), "notes", F.lit(0).cast("long").alias("inlined"))
    return a.unionByName(out["slabs"].select("id", F.col("title").alias("name"), "notes", F.coalesce(F.size("inline"), F.lit(0)).cast("long").alias("inlined")))


@query("""WITH p AS (SELECT p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN 'anchor' WHEN 1 THEN 'slab' ELSE 'edge' END AS type, p_name, p_type FROM part),
l AS (SELECT ord, 'p' || ord AS id, type, CASE type WHEN 'anchor' THEN p_name WHEN 'slab' THEN CASE WHEN ord % 2 = 0 THEN p_type ELSE substr(repeat(p_name || ' ', 20), 1, 60) END ELSE 'p' || ord END AS label FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ord DESC) AS k FROM l) SELECT label, id, CASE WHEN type <> 'edge' THEN type END AS promoted FROM r WHERE k = 1""")
def prj37_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Registry rows of packets, the last of a label."""
    k = F.col("p_partkey") % 3
    packets = table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.when(k == 0, "anchor").when(k == 1, "slab").otherwise("edge").alias("type"), F.col("p_name").alias("phrase"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("").alias("title"), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(20)).alias("text"), F.lit("why").alias("justification"),
    )
    return P.registered(packets).select("label", "id", "promoted")


_COMPAT = """c AS (SELECT 't' || s_suppkey AS temp_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS phrase, s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'x' END AS text, CASE WHEN s_suppkey % 4 < 2 THEN 'anchor' ELSE 'slab' END AS type FROM supplier),
k AS (SELECT temp_id, type, CASE type WHEN 'anchor' THEN phrase ELSE title END AS name FROM c WHERE NOT (type = 'anchor' AND phrase IS NULL) AND NOT (type = 'slab' AND text = ''))"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("t"), s.cast("string")).alias("temp_id"), F.when(s % 2 == 0, F.col("s_name")).alias("phrase"), F.col("s_name").alias("title"), F.when(s % 3 == 0, "").otherwise("x").alias("text"),
        F.when(s % 4 < 2, "Anchor").otherwise("SLAB").alias("type"), F.when(s % 5 == 0, F.array(F.lit("own"))).alias("source_path"),
    )


@query(f"""WITH {_COMPAT}, n AS (SELECT temp_id AS ref, name AS label FROM k UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation),
r AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CASE l_returnflag WHEN 'A' THEN 'LINKS' WHEN 'N' THEN 'SUPPORTS' ELSE 'ODD' END AS type, 't' || l_suppkey AS f, 'n' || l_partkey % 30 AS t, CAST(l_discount AS DOUBLE) AS confidence FROM lineitem),
e AS (SELECT type, a.label AS "from", b.label AS "to", confidence, row_number() OVER (PARTITION BY type, a.label, b.label ORDER BY ord) AS k FROM r JOIN n a ON a.ref = f JOIN n b ON b.ref = t WHERE type <> 'ODD' AND a.label <> b.label) SELECT type, "from", "to", confidence FROM e WHERE k = 1""")
def prj27_compatible(spark: SparkSession, sf: str) -> DataFrame:
    named = P.compatible(_candidates(spark, sf), "all")
    flag = F.when(F.col("l_returnflag") == "A", "links").when(F.col("l_returnflag") == "N", "Supports").otherwise("odd")
    relations = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), flag.alias("type"), F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("from_ref"), F.concat(F.lit("n"), (F.col("l_partkey") % 30).cast("string")).alias("to_ref"),
        F.col("l_discount").cast("double").alias("confidence"), F.lit(None).cast("string").alias("justification"),
    )
    catalogue = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"))
    return P.compatible_edges(relations, named, catalogue).select("type", "from", "to", "confidence")


@query("""WITH b AS (SELECT s_suppkey AS ord, s_nationkey AS slab, 's' || s_suppkey || CASE WHEN s_suppkey % 4 <> 0 THEN '_coherence_v1' ELSE '_v1' END AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS intent FROM supplier),
f AS (SELECT slab, arg_min(intent, ord) FILTER (intent IS NOT NULL) AS i FROM b WHERE ends_with(id, '_coherence_v1') GROUP BY slab)
SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'own' ELSE coalesce(i, '') END AS intent, (SELECT count(*) FROM b WHERE NOT ends_with(id, '_coherence_v1')) AS bundles, (SELECT count(*) FROM b WHERE NOT ends_with(id, '_coherence_v1')) + (SELECT count(*) FROM b) AS edges FROM nation LEFT JOIN f ON slab = n_nationkey""")
def prj28_coherence(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as bundles of their nation, most of them its own."""
    none = F.array().cast("array<string>")
    slabs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("own"))).otherwise(none).alias("intent"), none.alias("invariants"))
    s = F.col("s_suppkey")
    ident = F.concat(F.lit("s"), s.cast("string"), F.when(s % 4 != 0, "_coherence_v1").otherwise("_v1"))
    bundles = table(spark, sf, "supplier").select(s.alias("ord"), ident.alias("id"), F.when(s % 3 == 0, none).otherwise(F.array("s_name")).alias("intent"), none.alias("invariants"), F.array(F.lit(-1), "s_nationkey").alias("depends_on"))
    both = bundles.select(F.lit("SUPPORTS").alias("type"), F.col("id").alias("src"), F.col("depends_on")[1].alias("dst")).unionByName(bundles.select(F.lit("LINKS").alias("type"), F.col("id").alias("src"), F.col("depends_on")[1].alias("dst")))
    new, left, kept = P.migrated_coherence(slabs, bundles, both)
    counts = left.agg(F.count("*").alias("bundles")).crossJoin(kept.agg(F.count("*").alias("edges")))  # one row each
    return new.select("id", F.array_join("intent", "").alias("intent")).crossJoin(F.broadcast(counts))


@query(f"WITH {GRAPH}, r AS (SELECT row_number() OVER (ORDER BY ord DESC, id) - 1 AS place, id, type, label FROM nodes) SELECT place, id || ' (' || CASE type WHEN 'bundle' THEN label || '; x' ELSE label END || ')' AS line FROM r WHERE place < 24")
def prj32_described(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes with the greatest numbers, described."""
    top = nodes(spark, sf).orderBy(F.desc("ord"), "id").limit(24)
    placed = top.select(F.struct(-F.col("ord"), "id").alias("k"), "*").groupBy().agg(F.array_sort(F.collect_list("k")).alias("ks"))
    n = top.crossJoin(placed).withColumn("place", F.array_position("ks", F.struct(-F.col("ord"), "id")) - 1)  # one row of 24 keys
    return P.described(n.select("place", "id", "type", F.col("label").alias("phrase"), F.col("label").alias("text"), F.array("label", F.lit("x"), F.lit("y")).alias("intent")))


_VERB = "['discard', 'promote_tentative', 'promote_corpus', 'delete', 'accept', 'fly'][o_orderkey % 6 + 1]"


@query(f"""WITH r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'COMMITTED' WHEN 'O' THEN 'DRAFT_UNAUTHORIZED' ELSE 'PROPOSED' END AS s, CASE WHEN o_orderkey % 7 <> 0 THEN {_VERB} END AS v FROM orders)
SELECT id, CASE WHEN v = 'fly' THEN 'unknown_verb' WHEN v IS NOT NULL AND s = 'COMMITTED' THEN 'closed' END AS error, CASE WHEN v IS NULL OR v = 'fly' OR s = 'COMMITTED' THEN s ELSE CASE v WHEN 'discard' THEN 'REJECTED' WHEN 'promote_tentative' THEN 'PROVISIONAL' WHEN 'promote_corpus' THEN 'COMMITTED' WHEN 'delete' THEN 'DELETED' ELSE 'ACCEPTED' END END AS status FROM r""")
def lif06_verbs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "COMMITTED").when(F.col("o_orderstatus") == "O", "DRAFT_UNAUTHORIZED").otherwise("PROPOSED").alias("status"))
    verb = F.array(*[F.lit(v) for v in ("discard", "promote_tentative", "promote_corpus", "delete", "accept", "fly")])[(F.col("o_orderkey") % 6).cast("int")]
    return L.acted(rows, o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), verb.alias("verb"))).select("id", "error", "status")


_PLAN = """d AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'COMMITTED' ELSE 'DRAFT_UNAUTHORIZED' END AS s, CASE WHEN o_orderkey % 6 < 5 THEN ['CONFIRMED', 'UNTOUCHED_KEEP', 'UNTOUCHED_DROP', 'RETRACTED', 'DRIFTED'][o_orderkey % 6 + 1] END AS v FROM orders)"""


def _applied(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    drafts = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "COMMITTED").otherwise("DRAFT_UNAUTHORIZED").alias("status"), F.lit("RAISED").alias("epistemic"))
    verdict = F.array(*[F.lit(v) for v in L.VERDICT_VERBS])[(F.col("o_orderkey") % 6).cast("int")]
    plan = o.where("o_orderkey % 6 < 5").select(F.col("o_orderkey").alias("id"), verdict.alias("verdict"))
    return L.trajectory_applied(drafts, plan, o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") + 1).alias("by")))


@query(f"""WITH {_PLAN} SELECT id, CASE WHEN s = 'COMMITTED' OR v IS NULL THEN s ELSE CASE v WHEN 'CONFIRMED' THEN 'COMMITTED' WHEN 'UNTOUCHED_KEEP' THEN 'PROVISIONAL' ELSE 'REJECTED' END END AS status,
CASE WHEN s <> 'COMMITTED' AND v IN ('CONFIRMED', 'UNTOUCHED_KEEP', 'RETRACTED', 'DRIFTED') THEN 'CANONICALIZED' ELSE 'RAISED' END AS epistemic, CASE WHEN s <> 'COMMITTED' AND v IN ('RETRACTED', 'DRIFTED') AND id % 4 = 0 THEN id + 1 END AS superseded_by FROM d""")
def lif07_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf).select("id", "status", "epistemic", "superseded_by")


@query(f"""WITH {_PLAN} SELECT CASE WHEN s = 'COMMITTED' THEN 'errors' ELSE CASE v WHEN 'CONFIRMED' THEN 'confirmed_promoted' WHEN 'UNTOUCHED_KEEP' THEN 'untouched_preserved' WHEN 'UNTOUCHED_DROP' THEN 'untouched_discarded' WHEN 'RETRACTED' THEN 'retracted_demoted' ELSE 'drifted_demoted' END END AS outcome, count(*) AS n FROM d WHERE v IS NOT NULL GROUP BY 1""")
def lif07_counts(spark: SparkSession, sf: str) -> DataFrame:
    return L.trajectory_counts(_applied(spark, sf))


def _objects(df: DataFrame, key: str, kind: str, suffix: str = "_v1") -> DataFrame:
    return df.select(F.concat(F.lit(kind[0]), F.col(key).cast("string"), F.lit(suffix)).alias("id"), F.lit(kind).alias("type"), F.lit("v1").alias("version"))


@query("""SELECT 'whole' AS "case", count(*) AS n, 0 AS errors FROM (SELECT n_nationkey FROM nation UNION ALL SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'broken', (SELECT count(*) FROM nation), (SELECT count(*) FROM supplier) + (SELECT count(*) FROM supplier WHERE s_nationkey % 5 = 0)""")
def val02_rollback(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers committed beside nations: as they should be, and without a version and with references to nothing."""
    s, n = table(spark, sf, "supplier"), _objects(table(spark, sf, "nation"), "n_nationkey", "slab")
    out = []
    for case, suffix in (("whole", "_v1"), ("broken", "_v2")):
        own = _objects(s, "s_suppkey", "anchor", suffix)
        target = F.when((F.col("s_nationkey") % 5 == 0) & F.lit(case == "broken"), "s999_v1").otherwise(F.concat(F.lit("s"), F.col("s_nationkey").cast("string"), F.lit("_v1")))
        refs = s.select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string"), F.lit(suffix)).alias("id"), target.alias("ref"))
        new, errors = L.committed(n, own, refs)
        out.append(new.agg(F.lit(case).alias("case"), F.count("*").alias("n")).crossJoin(errors.agg(F.count("*").cast("int").alias("errors"))))  # one row each
    return out[0].unionByName(out[1])


@query("SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 0) AS corpus, (SELECT count(*) FROM supplier WHERE s_suppkey % 4 <> 0) AS library, 0 AS errors")
def lif14_library(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of a library promoted: into the corpus, and out of the library."""
    s = table(spark, sf, "supplier")
    refs = s.select(F.lit("none").alias("id"), F.lit("none").alias("ref"))
    corpus, library, errors = L.library_promoted(_objects(table(spark, sf, "nation"), "n_nationkey", "slab"), _objects(s, "s_suppkey", "anchor"), _objects(s.where("s_suppkey % 4 = 0"), "s_suppkey", "anchor"), refs)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(corpus, "corpus").crossJoin(count(library, "library")).crossJoin(errors.agg(F.count("*").cast("int").alias("errors")))  # one row each


@query(f"WITH {_VERDICTS}, r AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY id) AS k FROM vd) SELECT verdict, count(*) AS n, string_agg(id, ',' ORDER BY id) FILTER (k <= 3) AS examples, CASE verdict WHEN 'KEEP' THEN 0 ELSE count(*) END AS gone FROM r GROUP BY verdict")
def lif15_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Consolidation by verdict with three examples each, and what goes when it is confirmed."""
    verdicts = P.analysed(P.temporary_corpus(_proposals(spark, sf), _relations(spark, sf)))
    shown, gone = L.consolidation_preview(verdicts, 3, True)
    n = gone.join(verdicts.select("id", "verdict"), "id").groupBy("verdict").agg(F.count("*").alias("gone"))
    return shown.join(n, "verdict", "left").select("verdict", "n", F.array_join("examples", ",").alias("examples"), F.coalesce("gone", F.lit(0)).cast("long").alias("gone"))


@query("""SELECT (SELECT count(*) FROM conversations WHERE conv_id = 3) AS messages, (SELECT count(*) FROM conversations WHERE conv_id = 3 AND role = 'user') AS turns, (SELECT count(DISTINCT conv_id) FROM conversations) - 1 AS open""")
def lif13_end_of_chat(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("chat"), "turn", "role", "text")
    own, turns, chats = L.chat_closed(c, c.select(F.col("chat").alias("id"), F.lit("ACTIVE").alias("status")).distinct(), "3")
    return own.agg(F.count("*").alias("messages")).crossJoin(turns.select("turns")).crossJoin(chats.agg(F.count_if(F.col("status") == "ACTIVE").alias("open")))  # one row each


@query(f"""WITH {GRAPH}, iv AS (SELECT id FROM nodes WHERE type = 'slab' AND ord % 2 = 0), fr AS (SELECT DISTINCT 'c' || o_custkey AS id, CASE WHEN o_custkey % 3 = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS weight FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'n4', CAST(1 AS DOUBLE)),
iy AS (SELECT id FROM iv WHERE id NOT IN (SELECT id FROM fr)), ca AS (SELECT dst AS id, arg_min(src, ord) AS ref FROM edges JOIN nodes ON id = src WHERE edges.type = 'INVOKES' AND nodes.ord < 20 GROUP BY dst),
li AS (SELECT src AS id, arg_min(dst, CAST(substr(dst, 2) AS INTEGER)) AS ref FROM edges WHERE type = 'PARENT_OF' AND dst IN (SELECT id FROM fr WHERE weight >= 0.8) GROUP BY src)
SELECT id, CASE WHEN ca.ref IS NOT NULL THEN 'anchor_invokes' ELSE 'linked_anchor_active' END AS rule, coalesce(ca.ref, li.ref) AS ref FROM iy LEFT JOIN ca USING (id) LEFT JOIN li USING (id) WHERE coalesce(ca.ref, li.ref) IS NOT NULL""")
def grf24_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Even slabs as invariants: invoked by a handle that fired, or linked to one that weighs much."""
    n, e = nodes(spark, sf), edges(spark, sf)
    slabs = n.where("type = 'slab' AND ord % 2 = 0").select("id")
    frame = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.when(F.col("o_custkey") % 3 == 0, 0.9).otherwise(0.5).alias("weight")).distinct()
    frame = frame.unionByName(spark.createDataFrame([("n4", 1.0)], "id string, weight double"))
    fired = n.where("type = 'anchor' AND ord < 20").select("id", F.col("ord").alias("place"))
    invokes = e.where("type = 'INVOKES'").select(F.col("src").alias("anchor"), F.col("dst").alias("target"))
    links = e.where("type = 'PARENT_OF'").select(F.col("src").alias("slab"), F.substring("dst", 2, 9).cast("int").alias("n"), F.col("dst").alias("target"))
    return A.invariants(slabs, frame, fired, invokes, links, 0.7)
