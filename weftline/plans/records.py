"""Queries of the operators on records: projections, predicates and small joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import models as M
from weftline.operators import miners as N
from weftline.operators import outline as O
from weftline.operators import records as R
from weftline.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes
from weftline.plans.registry import Registry
from weftline.session import ship
from weftline.sources.tables import table

registry = Registry()
query = registry.query
GRAPH = f"{NODES_SQL}, {EDGES_SQL}"


def _one(*values: str):
    return F.array(*[F.lit(v) for v in values])


def _pick(key: str, *values: str):
    """One of some values by a number."""
    return _one(*values)[(F.col(key) % len(values)).cast("int")]


def _chosen(key: str, *values: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"


# -- projections ----------------------------------------------------------------------------------
@query("SELECT doc_id, source, length(text) AS text_length FROM documents")
def prj01_listing(spark: SparkSession, sf: str) -> DataFrame:
    return R.listing(table(spark, sf, "documents").select("doc_id", "source", "text"))


@query(f"WITH {GRAPH}, a AS (SELECT 'c' || s_suppkey * 97 AS asked FROM supplier) SELECT asked, id IS NOT NULL AS found, type, collection, label FROM a LEFT JOIN nodes ON id = asked")
def prj02_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "supplier").select(F.concat(F.lit("c"), (F.col("s_suppkey") * 97).cast("string")).alias("id"))
    return R.looked_up(nodes(spark, sf).select("id", "type", "collection", "label"), ids)


@query(f"WITH {GRAPH} SELECT id, type, collection, label FROM nodes")
def prj03_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    return R.uniform_nodes({kind: n.where(F.col("type") == kind).drop("type") for kind in ("anchor", "slab", "bundle")})


@query("SELECT 'INVOKES' AS type, 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'LINKS', 'o' || l_orderkey, 's' || l_suppkey FROM lineitem")
def prj06_reference_edges(spark: SparkSession, sf: str) -> DataFrame:
    return R.reference_edges(_orders(spark, sf), {"invokes": "INVOKES", "depends_on": "LINKS"})


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as objects that invoke parts and depend on suppliers."""
    at = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return table(spark, sf, "lineitem").groupBy(at("o", "l_orderkey").alias("id")).agg(F.collect_list(at("p", "l_partkey")).alias("invokes"), F.collect_list(at("s", "l_suppkey")).alias("depends_on"))


@query(f"WITH {GRAPH} SELECT type, src, dst, weight FROM edges UNION ALL SELECT 'INVOKES', 'o' || l_orderkey, 'p' || l_partkey, CAST(0.9 AS DOUBLE) FROM lineitem UNION ALL SELECT 'LINKS', 'o' || l_orderkey, 's' || l_suppkey, CAST(0.8 AS DOUBLE) FROM lineitem")
def prj07_render_edges(spark: SparkSession, sf: str) -> DataFrame:
    return R.rendered_edges(edges(spark, sf), _orders(spark, sf))


_SECTIONS = """s AS (SELECT n_regionkey AS doc, n_nationkey AS idx, CAST(NULL AS INTEGER) AS parent, CASE WHEN n_nationkey % 3 = 0 THEN 1 WHEN n_regionkey = 4 THEN 1 ELSE 2 + n_nationkey % 2 END AS level, n_name AS label, n_nationkey AS start FROM nation)"""


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as sections of their region, of levels 1 to 3 by their number."""
    k = F.col("n_nationkey")
    level = F.when(k % 3 == 0, 1).when(F.col("n_regionkey") == 4, 1).otherwise(2 + k % 2)
    return table(spark, sf, "nation").select(F.col("n_regionkey").alias("doc"), k.alias("idx"), F.lit(None).cast("int").alias("parent"), level.cast("int").alias("level"), F.col("n_name").alias("label"), k.alias("start"))


_TIERS = "t AS (SELECT doc, list_sort(list_distinct(list(level))) AS l FROM s GROUP BY doc), u AS (SELECT doc, l[1] AS top_level, l[least(2, len(l))] AS chapter_level FROM t)"


@query(f"WITH {_SECTIONS}, {_TIERS} SELECT doc, top_level, chapter_level FROM u")
def prj12_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return R.tiers(_sections(spark, sf))


@query(f"""WITH {_SECTIONS}, {_TIERS}, p AS (SELECT s.*, top_level, chapter_level, max(CASE WHEN level = top_level THEN idx END) OVER (PARTITION BY s.doc ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under FROM s JOIN u USING (doc))
SELECT p.doc, p.label, coalesce(a.label || ' / ', '') || p.label AS path FROM p LEFT JOIN s a ON a.idx = p.under WHERE p.level = chapter_level AND p.level <> top_level
UNION ALL SELECT doc, label, label FROM p WHERE level = top_level AND idx NOT IN (SELECT under FROM p WHERE level = chapter_level AND level <> top_level AND under IS NOT NULL)""")
def prj13_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return R.chapters(_sections(spark, sf)).select("doc", "label", "path")


@query("SELECT c_custkey AS idx, r_name || ' / ' || n_name || ' / ' || c_mktsegment AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def prj14_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Customers under their nation and region, as one section tree."""
    row = lambda df, base, key, up, label: df.select(F.lit(0).alias("doc"), (F.col(key).cast("long") + base).alias("idx"), up.cast("long").alias("parent"), F.col(label).alias("label"))
    r = row(table(spark, sf, "region"), -200, "r_regionkey", F.lit(None), "r_name")
    n = row(table(spark, sf, "nation"), -100, "n_nationkey", F.col("n_regionkey") - 200, "n_name")
    c = row(table(spark, sf, "customer"), 0, "c_custkey", F.col("c_nationkey") - 100, "c_mktsegment")
    return O.paths(r.unionByName(n).unionByName(c)).where("idx >= 0").select("idx", "path")


@query("""SELECT doc_id, md5(CASE WHEN length(text) <= 2000 THEN text ELSE array_to_string(list_transform(list_filter(string_split_regex(text, '\\n+'), lambda p: trim(p) <> ''), lambda p: string_split(p, '. ')[1]), chr(10)) END) AS digest FROM documents""")
def prj15_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(R.digest(F.col("text"), 2000)).alias("digest"))


@query("""WITH m AS (SELECT doc_id, k, CASE k WHEN 2 THEN n // 3 WHEN 3 THEN CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 * (n // 3) END WHEN 4 THEN CASE WHEN doc_id % 3 = 0 THEN n - 1 END ELSE 5 END AS pos, n FROM (SELECT doc_id, length(text) AS n, unnest([1, 2, 3, 4]) AS k FROM documents WHERE length(text) > 300)),
f AS (SELECT *, max(pos) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m WHERE pos IS NOT NULL), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM f WHERE before IS NULL OR pos > before)
SELECT doc_id AS doc, k AS n, CASE WHEN i = 1 THEN 0 ELSE pos END AS start, coalesce(lead(CASE WHEN i = 1 THEN 0 ELSE pos END) OVER (PARTITION BY doc_id ORDER BY k), n) AS "end" FROM g""")
def prj16_sub_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Four marks a document, some of them not found and some out of order."""
    d = table(spark, sf, "documents").where("length(text) > 300").select("doc_id", F.length("text").cast("long").alias("size"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("n"))
    third = F.expr("size div 3")
    at = F.when(F.col("n") == 2, third).when(F.col("n") == 3, F.when(F.col("doc_id") % 5 == 0, 1).otherwise(2 * third)).when(F.col("n") == 4, F.when(F.col("doc_id") % 3 == 0, F.col("size") - 1)).otherwise(5)
    return R.sub_sections(d.select(F.col("doc_id").alias("doc"), "n", F.lit("x").alias("label"), at.alias("at"), "size")).drop("label")


@query("""WITH p AS (SELECT p_partkey AS ord, [p_brand, p_type, p_name] AS path FROM part), e AS (SELECT ord, array_to_string(list_slice(path, 1, d), ' / ') AS prefix, d AS depth FROM p, (VALUES (1), (2)) v(d)) SELECT prefix, depth, min(ord) AS ord, count(*) AS members FROM e GROUP BY ALL""")
def prj17_prefix_tree(spark: SparkSession, sf: str) -> DataFrame:
    return R.prefix_tree(table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.array("p_brand", "p_type", "p_name").alias("path")), 2)


@query(f"""WITH a AS (SELECT p_partkey, p_name, list_filter(list_transform(CASE WHEN p_size % 5 = 0 THEN ['part IV', '4.4', ' segment 3 '] ELSE [p_brand, 'segment ' || p_size, p_type, '', p_name] END, lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> lower(p_type) AND NOT regexp_matches(lower(x), '{R.MECHANICAL}')) AS p FROM part) SELECT p_partkey, CASE WHEN len(p) > 0 THEN array_to_string(p, ' / ') ELSE p_name END AS path FROM a""")
def prj19_semantic_path(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 5 == 0, _one("part IV", "4.4", " segment 3 ")).otherwise(F.array(F.col("p_brand"), F.concat(F.lit("segment "), F.col("p_size").cast("string")), F.col("p_type"), F.lit(""), F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(R.semantic_path(raw, F.col("p_name"), F.col("p_type")), " / ").alias("path"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type || ' / ' || p_name || ' + x' ELSE '' END AS topic FROM part")
def prj20_topic(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_size") % 3
    value = F.when(k == 0, F.concat(F.lit(" "), "p_name", F.lit(" ")))
    parts = F.when(k == 1, F.array(F.col("p_type"), F.lit(None), F.lit(" "), F.concat("p_name", F.lit(" / x"))))
    return table(spark, sf, "part").select("p_partkey", R.topic(value, parts).alias("topic"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 2 THEN p_name END, NULLIF(CASE WHEN p_type = 'ECONOMY' THEN '' ELSE p_type END, ''), CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END) AS title FROM part")
def prj21_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A field from the inline payload, else from the packet, else from the raw sidecar."""
    inline = F.when(F.col("p_size") % 3 == 0, None).when(F.col("p_size") % 3 == 1, "").otherwise(F.col("p_name"))
    packet, raw = F.when(F.col("p_type") == "ECONOMY", "").otherwise(F.col("p_type")), F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", R.first_field(inline, packet, raw).alias("title"))


@query("""SELECT doc_id, CASE WHEN length(text) >= 50 AND doc_id % 2 = 0 THEN 'why' ELSE '' END AS intent, CASE WHEN length(text) >= 50 THEN array_to_string(list_slice(list_filter(list_transform(string_split(text, '.'), lambda s: trim(s)), lambda s: length(s) > 15), 1, 5), '|') ELSE '' END AS invariants FROM documents""")
def prj22_invariants(spark: SparkSession, sf: str) -> DataFrame:
    m = R.slab_metadata(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "why"))
    return table(spark, sf, "documents").select("doc_id", m.alias("m")).select("doc_id", F.array_join("m.intent", "|").alias("intent"), F.array_join("m.invariants", "|").alias("invariants"))


@query("""SELECT p_partkey AS ord, 'draft_' || substr(sha1(t || p_partkey), 1, 10) AS id, t AS type, CASE t WHEN 'anchor' THEN '{"canonical_phrase":"' || p_name || '"}' WHEN 'slab' THEN '{"title":"' || p_brand || '","canonical_text":"' || p_name || '"}' ELSE '{"label":"' || p_type || '"}' END AS payload FROM (SELECT *, CASE WHEN p_size < 10 THEN 'anchor' WHEN p_size < 30 THEN 'slab' ELSE 'bundle' END AS t FROM part WHERE p_size <> 20)""")
def prj23_packets(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("p_size") == 20, "odd").when(F.col("p_size") < 10, "anchor").when(F.col("p_size") < 30, "slab").otherwise("bundle")
    return R.packets(table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), kind.alias("type"), F.col("p_name").alias("phrase"), F.col("p_brand").alias("title"), F.col("p_name").alias("text"), F.col("p_type").alias("label")))


@query("SELECT event_id AS ord, CASE event_id % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN 'OTHER' ELSE 'LINKS' END AS type, 'u' || user_id AS src, 'v' || user_id AS dst FROM events WHERE event_type <> 'error'")
def prj25_edge_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    name = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"))
    raw = table(spark, sf, "events").select(
        k.alias("ord"), F.when(k % 3 == 0, F.col("event_type")).when(k % 3 == 2, "").alias("type"), F.when(k % 3 == 1, "other").alias("edge_type"), F.when(k % 2 == 0, name("u")).alias("from"),
        F.when(k % 2 == 1, name("u")).otherwise(name("z")).alias("from_label"), F.lit(" ").alias("to"), F.when(F.col("event_type") != "error", name("v")).alias("to_label"),
    )
    return R.edge_rows(raw)


@query("SELECT c_mktsegment AS collection, string_agg(c_name, '; ' ORDER BY c_custkey) AS text FROM customer GROUP BY 1")
def prj26_slabify(spark: SparkSession, sf: str) -> DataFrame:
    return R.joined_labels(table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "collection"), "collection", "c_custkey", "c_name")


@query("WITH s AS (SELECT user_id AS session, event_type AS id, round(avg(value) + 1e-9::DOUBLE, 4) AS v FROM events GROUP BY ALL) SELECT session, string_agg(id || '=' || printf('%.4f', v), ' ' ORDER BY id) AS frame, count(*) AS nodes FROM s GROUP BY session")
def prj29_frame(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("session"), F.col("event_type").alias("id")).agg((F.avg("value") + 1e-9).alias("salience"))
    entry = F.transform(F.array_sort(F.map_entries("saliences")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))
    return R.frame_rows(s).select("session", F.array_join(entry, " ").alias("frame"), "nodes")


@query("WITH u AS (SELECT doc_id, 0 AS tier FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 1 FROM labels WHERE quality = 1) SELECT u.doc_id AS id, min(tier) AS tier, any_value(source) AS source FROM u JOIN documents USING (doc_id) GROUP BY u.doc_id")
def prj30_hits(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return R.hits_with_attributes(lab.where("toxic = 1"), lab.where("quality = 1"), table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"))


@query("""SELECT 'p' || p_partkey AS target, p_name AS text FROM part UNION ALL SELECT 'd' || doc_id, substr(text, 1, 600) FROM documents WHERE text <> '' UNION ALL SELECT 'd' || doc_id, 'inline ' || doc_id FROM documents WHERE doc_id % 4 = 0""")
def prj31_targets(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    slabs = table(spark, sf, "documents").select(at("d", "doc_id").alias("id"), "text", F.when(F.col("doc_id") % 4 == 0, F.array(at("inline ", "doc_id"))).alias("inline"))
    return R.search_targets(table(spark, sf, "part").select(at("p", "p_partkey").alias("id"), F.col("p_name").alias("phrase")), slabs)


@query("SELECT o_custkey AS leaf, 'o' || o_orderkey AS title, o_custkey * 1000 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders")
def prj34_positions(spark: SparkSession, sf: str) -> DataFrame:
    return R.drilled(_leaves(spark, sf))[0].select("leaf", "title", "position")


@query("SELECT DISTINCT 'o' || o_orderkey AS src, o_orderpriority AS dst, CAST(0.8 AS DOUBLE) AS weight FROM orders")
def prj34_links(spark: SparkSession, sf: str) -> DataFrame:
    return R.drilled(_leaves(spark, sf))[1]


def _leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as leaves whose slabs are their orders."""
    slab = F.struct("o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("title"), F.array("o_orderpriority").alias("references"))
    own = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("leaf")).agg(F.array_sort(F.collect_list(slab)).alias("s"))
    return own.select("leaf", (F.col("leaf") * 1000).alias("base"), F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["references"].alias("references"))).alias("slabs"))


@query("WITH r AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) SELECT p_brand, string_agg(p_name, '; ' ORDER BY k) AS text FROM r WHERE k <= 8 GROUP BY p_brand")
def prj38_context(spark: SparkSession, sf: str) -> DataFrame:
    return R.joined_labels(table(spark, sf, "part"), "p_brand", "p_partkey", "p_name", 8)


# -- predicates -----------------------------------------------------------------------------------
_KINDS = ("CONSTITUTIONAL", "CANONICAL", "REFERENCE", "INVARIANT")
_SLABS = f"sl AS (SELECT p_partkey AS id, {_chosen('p_partkey', *_KINDS)} AS type, CASE WHEN p_size % 5 = 0 THEN 'RETIRED' ELSE 'ACTIVE' END AS status, CASE p_size % 3 WHEN 0 THEN 'ON' WHEN 1 THEN 'OFF' END AS mode FROM part)"


def _slabs(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), _pick("p_partkey", *_KINDS).alias("type"), F.when(size % 5 == 0, "RETIRED").otherwise("ACTIVE").alias("status"), F.when(size % 3 == 0, "ON").when(size % 3 == 1, "OFF").alias("requires_mode"))


@query(f"WITH {_SLABS} SELECT id, type, false AS wide FROM sl WHERE status = 'ACTIVE' AND type IN ('CONSTITUTIONAL', 'CANONICAL') AND coalesce(mode, 'ON') = 'ON' UNION ALL SELECT id, type, true FROM sl WHERE status = 'ACTIVE' AND type <> 'INVARIANT' AND coalesce(mode, 'OFF') = 'OFF'")
def flt01_base_set(spark: SparkSession, sf: str) -> DataFrame:
    s = _slabs(spark, sf)
    return R.base_set(s, "ON").select("id", "type", F.lit(False).alias("wide")).unionByName(R.base_set(s, "OFF", True).select("id", "type", F.lit(True).alias("wide")))


@query(f"WITH {_SLABS} SELECT id FROM sl WHERE status = 'ACTIVE' AND type = 'INVARIANT'")
def flt02_invariants(spark: SparkSession, sf: str) -> DataFrame:
    return R.invariant_slabs(_slabs(spark, sf)).select("id")


_GATES = ("CONFIDENCE", "OTHER", "FUNCTION", "EXPLICITNESS")


@query(f"SELECT o_orderkey, [2, 3, 0, 1][o_orderkey % 4 + 1] AS stage, o_orderstatus = 'F' AS open, (o_orderstatus = 'F') <> (o_orderpriority = '1-URGENT') AS differs, o_orderpriority = '1-URGENT' AS declared FROM orders")
def flt07_stages(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    g = R.effective_gate(a, b)
    return table(spark, sf, "orders").select("o_orderkey", R.stage_order(_pick("o_orderkey", *_GATES)).alias("stage"), g["open"].alias("open"), g["differs"].alias("differs"), R.effective_gate(a, b, True)["open"].alias("declared"))


_ASKED = ("the width of it ", "why this width ", "Config please ", "")


@query(f"SELECT doc_id, CASE WHEN regexp_matches(t, '{R.VALUE_NOUNS}') AND NOT regexp_matches(t, '{R.INFERENCE}') THEN 8 ELSE 25 END AS k FROM (SELECT doc_id, {_chosen('doc_id', *_ASKED)} || text AS t FROM documents)")
def flt10_direct_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", R.reference_limit(F.concat(_pick("doc_id", *_ASKED), "text")).alias("k"))


_NAMED = ("about podv9 ", "see version 3 ", "v 12 is it ", "pod v9x ", "")


@query(f"""WITH t AS (SELECT conv_id, turn, lower({_chosen('turn', *_NAMED)} || text) AS t FROM conversations), c AS (SELECT unnest(['podv9', 'other3', 'x3', 'two12', 'Étion', 'v']) AS id),
v AS (SELECT *, regexp_extract_all(t, '\\bv(?:ersion)?[_\\s]*(\\d+)\\b', 1) AS n FROM t) SELECT conv_id, turn, id FROM v, c WHERE (length(id) >= 3 AND contains(t, lower(id))) OR (regexp_extract(id, '(\\d+)$', 1) <> '' AND list_contains(n, regexp_extract(id, '(\\d+)$', 1)))""")
def flt11_mentions(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("text_id"), F.concat(_pick("turn", *_NAMED), "text").alias("text"))
    collections = spark.createDataFrame([(x,) for x in ("podv9", "other3", "x3", "two12", "Étion", "v")], "id string")
    return R.mentioned(texts, collections).select("text_id.conv_id", "text_id.turn", "id")


_OPENED = ("", "User: hi\n", "x\nAbstract\n", "# One\n1. Two\n", "# One\n")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'paper' WHEN regexp_matches(t, '{R.CHAT_LINE}') OR doc_id % 13 = 0 THEN 'chat' WHEN regexp_matches(t, '{R.PAPER_LINE}') THEN 'paper' WHEN len(regexp_extract_all(t, '{R.HEADING_LINE}')) >= 2 THEN 'document' ELSE 'narrative' END AS kind
FROM (SELECT doc_id, {_chosen('doc_id', *_OPENED).replace(chr(10), "' || chr(10) || '")} || text AS t FROM documents)""")
def flt12_source_kind(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.when(F.col("doc_id") % 11 == 0, "Paper").otherwise("auto")
    return table(spark, sf, "documents").select("doc_id", R.source_kind(F.concat(_pick("doc_id", *_OPENED), "text"), asked, F.col("doc_id") % 13 == 0).alias("kind"))


_TITLES = (
    "Intent and Scope", "Time, Space, and Matter", "The Life of Things", "Neural Gravity Field Theory", "neural gravity", "A Very Long Title That Goes On For Ever More Words", "a very long line that is no title of any kind at all", "",
    "Salt or Sand", "salt and sand", "One, two, or three", "2 Many Big Things",
)
_HEADINGS = (True, True, False, True, False, True, False, True, True, False, True, True)


@query(f"SELECT p_partkey, [{', '.join(str(h).lower() for h in _HEADINGS)}][p_partkey % {len(_HEADINGS)} + 1] AS heading FROM part")
def flt13_headings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", R.is_heading(_pick("p_partkey", *_TITLES)).alias("heading"))


@query("""WITH s AS (SELECT event_id AS e, user_id, value / 100 AS v FROM events) SELECT e AS event_id, CASE WHEN e % 4 = 0 AND e % 11 < 5 THEN 'cooldown' WHEN v > 0.6 THEN 'mismatch' WHEN e % 10 / 10.0 > 0.5 AND e % 7 / 7.0 > 0.4 AND e % 3 / 3.0 > 0.3 THEN 'signals' WHEN e % 9 / 9.0 > 0.6 THEN 'pressure' WHEN e % 2 = 0 THEN 'pushback' ELSE 'quiet' END AS trigger FROM s""")
def flt15_trigger(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    part = lambda n: e % n / n
    last = F.when(e % 4 == 0, e - e % 11)
    return table(spark, sf, "events").select("event_id", R.challenge(e, last, F.col("value") / 100, part(10), part(7), part(3), part(9), e % 2 == 0).alias("trigger"))


@query("""WITH d AS (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'tentative_slab_1' ELSE 'd' END AS id, ['anchor', 'slab', 'bundle'][p_partkey % 3 + 1] AS t, CASE WHEN p_size % 2 = 0 THEN p_name END AS a, CASE WHEN p_size % 5 < 3 THEN CASE WHEN p_size % 4 = 0 THEN repeat('x', 80) ELSE 'short' END END AS s, CASE WHEN p_size % 3 = 0 THEN 'b' END AS b, repeat(p_name, p_size % 9 + 1) AS l FROM part)
SELECT k AS p_partkey, CASE WHEN id = 'tentative_slab_1' AND t <> 'slab' THEN 'id' WHEN t = 'anchor' AND s IS NOT NULL AND a IS NULL THEN 'inline slab' WHEN t = 'slab' AND a IS NOT NULL AND s IS NULL THEN 'inline anchor' WHEN (t = 'anchor' AND a IS NULL) OR (t = 'slab' AND s IS NULL) OR (t = 'bundle' AND b IS NULL) THEN 'no payload' WHEN t = 'anchor' AND length(l) > 60 THEN 'long phrase' WHEN t = 'slab' AND s = 'short' THEN 'short slab' ELSE '' END AS flag FROM d""")
def flt20_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    slab = F.when(size % 5 < 3, F.when(size % 4 == 0, F.repeat(F.lit("x"), F.lit(80))).otherwise("short"))
    flag = R.ambiguity(F.when(F.col("p_partkey") % 7 == 0, "tentative_slab_1").otherwise("d"), _pick("p_partkey", "anchor", "slab", "bundle"), F.expr("repeat(p_name, p_size % 9 + 1)"), F.when(size % 2 == 0, F.col("p_name")), slab, F.when(size % 3 == 0, "b"))
    return table(spark, sf, "part").select("p_partkey", flag.alias("flag"))


@query("SELECT doc_id FROM documents WHERE starts_with(source, 'src1') OR starts_with(source, 'web')")
def flt21_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(R.starts_with_any(F.col("source"), ("src1", "web"))).select("doc_id")


@query("""WITH g AS (SELECT user_id, list_distinct(list(CASE WHEN event_type IN ('view', 'click') THEN 'base_set' ELSE event_type END)) AS s, count(*) FILTER (value > 95) AS h, max(CASE WHEN value > 97 THEN value ELSE 0 END) AS p FROM events WHERE event_id % 17 = 0 OR user_id % 5 = 0 GROUP BY user_id) SELECT user_id AS id FROM g WHERE NOT list_bool_and(list_transform(s, lambda x: x = 'base_set')) OR h > 0 OR p > 0""")
def flt22_visible(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_id % 17 = 0 OR user_id % 5 = 0")  # sessions of a few turns beside long ones
    source = F.when(F.col("event_type").isin("view", "click"), "base_set").otherwise(F.col("event_type"))
    n = e.groupBy(F.col("user_id").alias("id")).agg(F.collect_set(source).alias("sources"), F.count_if(F.col("value") > 95).alias("hits"), F.max(F.when(F.col("value") > 97, F.col("value")).otherwise(0.0)).alias("pressure"))
    return R.visible(n).select("id")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice / 500000 >= 0.5 AND o_orderkey % 5 <> 0 AND o_orderkey % 5 <> 1")
def flt23_evidence(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    refs = F.when(k == 0, None).when(k == 1, _one("assistant_unadopted", "assistant_unadopted")).when(k == 2, _one("user", "assistant_unadopted")).otherwise(_one("user"))
    return table(spark, sf, "orders").where(R.has_evidence(F.col("o_totalprice") / 500000, refs, 0.5)).select("o_orderkey")


@query(f"WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, t = '' OR ((t = 'New Chat' OR starts_with(t, 'Chat ')) AND n BETWEEN 3 AND 16) AS title_now FROM (SELECT *, {_chosen('conv_id', 'New Chat', 'Chat 12', 'My own', '')} AS t FROM c)")
def flt26_auto_title(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.select("conv_id", R.title_now(_pick("conv_id", "New Chat", "Chat 12", "My own", ""), F.col("n")).alias("title_now"))


@query("""WITH n AS (SELECT source, count(*) AS old, count(*) FILTER (doc_id % 40 <> 0) AS new, max(doc_id) AS h FROM documents GROUP BY source), m AS (SELECT *, CASE WHEN h % 7 = 0 THEN NULL ELSE 'a' END AS oh, CASE WHEN h % 3 = 0 THEN 'a' ELSE 'b' END AS nh FROM n)
SELECT source, coalesce(oh IS NULL OR (oh <> nh AND (abs(new - old) / greatest(old, 1) >= 0.1 OR abs(new - old) >= 5)), false) AS changed FROM m""")
def flt28_material(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("old"), F.count_if(F.col("doc_id") % 40 != 0).alias("new"), F.max("doc_id").alias("h"))
    old, new = F.when(F.col("h") % 7 == 0, None).otherwise("a"), F.when(F.col("h") % 3 == 0, "a").otherwise("b")
    return n.select("source", F.coalesce(R.materially_changed(old, new, F.col("old"), F.col("new")), F.lit(False)).alias("changed"))


@query("""WITH n AS (SELECT c_nationkey AS k, list(c_name ORDER BY c_custkey) AS l, count(*) FILTER (c_acctbal > 5000) AS t, avg(c_acctbal) / 9000 AS c FROM customer GROUP BY 1) SELECT k, CASE WHEN c < 0.5 THEN 'low' WHEN c < 0.7 THEN 'ambiguous' ELSE 'normal' END AS flag, len(l[1:24]) AS active, t AS tense FROM n""")
def flt29_header(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_list("c_name").alias("l"), F.collect_list(F.struct((F.col("c_acctbal") / 10000).alias("tension"))).alias("t"), (F.avg("c_acctbal") / 9000).alias("c"))
    h = n.select("k", R.runtime_header(F.col("c"), F.col("l"), F.col("t")).alias("h"))
    return h.select("k", "h.flag", F.size("h.active").cast("long").alias("active"), F.size("h.tense").cast("long").alias("tense"))


@query("""WITH b AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_suppkey) FILTER (l_suppkey % 3 = 0))) AS d FROM lineitem GROUP BY 1) SELECT id, array_to_string(d, ',') AS depends_on, CASE WHEN id % 2 = 0 THEN 8 ELSE 0 END AS warnings FROM b WHERE len(d) >= 2 AND id % 5 <> 0 AND id % 7 <> 0 AND id % 3 <> 0""")
def flt30_bundle_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as bundles on their suppliers, some without a label, an intent or any list."""
    none = F.array().cast("array<string>")
    k = F.col("id")
    own = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_suppkey").alias("depends_on"))
    nine = F.array_repeat(F.lit("w"), 9)
    b = own.select(
        "id", F.when(k % 5 == 0, " ").otherwise("label").alias("label"), F.when(k % 7 == 0, none).otherwise(_one("i")).alias("intent"), "depends_on", F.when((k % 3 != 0) & (k % 2 == 0), nine).otherwise(none).alias("warnings"),
        F.when((k % 3 != 0) & (k % 2 == 1), nine).otherwise(none).alias("non_assumptions"), none.alias("rules"), none.alias("heuristics"),
    )
    out = R.gated_bundles(b, table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id")))
    return out.select("id", F.array_join("depends_on", ",").alias("depends_on"), F.size("warnings").alias("warnings"))


@query("SELECT 'd' || o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'rule' ELSE 'intent' END AS category, greatest(0, least(1, o_totalprice / 400000)) AS confidence FROM orders WHERE o_orderkey % 3 < 2 AND o_orderstatus <> 'P'")
def flt31_directives(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose text is the answer of the model, with categories outside the known ones and empty quotes."""
    ship(spark)
    o = table(spark, sf, "orders")
    answer = F.to_json(F.struct(_pick("o_orderkey", " Rule", "INTENT", "odd").alias("category"), F.when(F.col("o_orderstatus") == "P", " ").otherwise("q").alias("quote"), (F.col("o_totalprice") / 400000).alias("confidence")))
    slabs = o.select(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("").alias("title"), answer.alias("text"))

    def repeat(prompt: str) -> dict:
        import json

        return {"extractions": [json.loads(prompt.rsplit("TEXT:\n", 1)[1])]}

    return N.directives(slabs, repeat).select("id", "category", "confidence")


@query("SELECT 'g' || l_suppkey AS \"group\", count(DISTINCT l_partkey) AS members FROM (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1) GROUP BY 1")
def flt32_members(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as groups of parts by repaired ids; a part that several name stays in the first by name, unknown ones go, empty groups too."""
    li = table(spark, sf, "lineitem")
    name = lambda c: F.lpad(c.cast("string"), 9, "0")
    groups = li.groupBy(name(F.col("l_suppkey")).alias("group")).agg(F.collect_set(F.concat(F.lit("[id="), F.col("l_partkey").cast("string"), F.lit("]"))).alias("members"))
    known = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").cast("string").alias("id"))
    members, _ = N.grouped(groups, known, known.limit(0).select("id", F.lit("").alias("group")))
    return members.groupBy(F.concat(F.lit("g"), F.col("group").cast("int").cast("string")).alias("group")).agg(F.count("*").alias("members"))


# -- joins ----------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT lower(p_name) AS key, 'a' || p_partkey AS id, 0 AS tier, p_partkey AS n FROM part WHERE p_size < 10 UNION ALL SELECT lower(p_name), 'b' || p_partkey, 1, p_partkey FROM part UNION ALL SELECT lower(p_type), 'c' || p_partkey, 2, p_partkey FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, n) AS k FROM e) SELECT key, id, tier FROM r WHERE k = 1""")
def joi03_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Label index over tiers, new drafts before the corpus."""
    p = table(spark, sf, "part")
    row = lambda df, label, c: df.select(F.col(label).alias("label"), F.concat(F.lit(c), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("n"))
    return R.tiered_index([row(p.where("p_size < 10"), "p_name", "a"), row(p, "p_name", "b"), row(p, "p_type", "c")])


@query("""WITH d AS (SELECT conv_id, turn AS raised, split_part(text, ' ', 1) AS w FROM conversations WHERE role = 'assistant' AND split_part(text, ' ', 1) <> '') SELECT d.conv_id AS chat, d.raised AS id, count(*) AS refs, min(r.turn) AS first_ref FROM d JOIN conversations r ON r.conv_id = d.conv_id AND r.turn > d.raised AND r.role = 'user' AND contains(lower(r.text), lower(d.w)) GROUP BY ALL""")
def joi13_references(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "chat")
    drafts = c.where("role = 'assistant'").select("chat", F.col("turn").alias("id"), F.col("turn").alias("raised"), F.split("text", " ")[0].alias("phrase"))
    return R.references(drafts, c.where("role = 'user'"))


@query("SELECT p_name AS id, min(p_brand) AS owner FROM part GROUP BY 1")
def joi22_owner(spark: SparkSession, sf: str) -> DataFrame:
    return R.owners(table(spark, sf, "part").select(F.col("p_name").alias("id"), F.col("p_brand").alias("collection")))


@query(f"WITH {GRAPH} SELECT e.src, e.dst, e.type, CASE WHEN a.collection = b.collection THEN a.collection WHEN a.collection = 'geo' THEN b.collection WHEN b.collection = 'geo' THEN a.collection ELSE 'geo' END AS target FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst")
def joi23_edge_collection(spark: SparkSession, sf: str) -> DataFrame:
    return R.edge_collections(edges(spark, sf).select("src", "dst", "type"), nodes(spark, sf), "geo")


_MARKED = "SELECT doc_id, text, (doc_id % 2) * 30 AS cursor, CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN substr(text, 40, 12) WHEN 2 THEN substr(text, 3, 9) ELSE 'zz qq' END AS m FROM documents"


@query(f"SELECT doc_id, CASE WHEN trim(m, ' ' || chr(10)) = '' THEN -1 WHEN strpos(substr(text, cursor + 1), m) > 0 THEN cursor + strpos(substr(text, cursor + 1), m) - 1 ELSE -1 END AS place FROM ({_MARKED}) WHERE len(list_distinct(regexp_extract_all(lower(m), '\\w+'))) < 3 OR contains(substr(text, cursor + 1), m)")
def joi24_marker(spark: SparkSession, sf: str) -> DataFrame:
    """Markers that stand in the text behind the cursor, before it, or not at all; those sought by their words are left to the tests."""
    k = F.col("doc_id")
    m = F.when(k % 4 == 0, " ").when(k % 4 == 1, F.substring("text", 40, 12)).when(k % 4 == 2, F.substring("text", 3, 9)).otherwise("zz qq")
    d = table(spark, sf, "documents").select("doc_id", "text", ((k % 2) * 30).alias("cursor"), m.alias("m"))
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower("m"), F.lit(r"[0-9A-Za-z_]+"), F.lit(0))))
    some = d.where((words < 3) | F.contains(F.expr("substring(text, cursor + 1)"), F.col("m")))
    return some.select("doc_id", R.marker_place(F.col("text"), F.col("m"), F.col("cursor")).cast("long").alias("place"))


@query("WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem WHERE l_returnflag = 'R') SELECT o_orderkey AS id, l_partkey AS resolution FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND k = 1")
def joi26_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("push_id"), F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("resolution"))
    return R.resolved_pushes(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), r)


@query(f"WITH {GRAPH} SELECT id, CASE type WHEN 'anchor' THEN label WHEN 'slab' THEN substr(label || repeat('x', 30), 1, 30) ELSE 'i-' || label END AS short FROM nodes")
def joi31_short_labels(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("label")
    return nodes(spark, sf).select("id", R.short_label(F.col("type"), label, F.concat(label, F.repeat(F.lit("x"), F.lit(30))), F.array(F.concat(F.lit("i-"), label), label)).alias("short"))


@query("SELECT c_custkey AS id, coalesce(max(o_orderstatus) FILTER (o_totalprice > 450000), 'default') AS target FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def joi32_target(spark: SparkSession, sf: str) -> DataFrame:
    sidecars = table(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("target"))
    return R.draft_targets(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), sidecars)


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_brand || ' ' || p_type WHEN 1 THEN p_name || ' ' || substr(repeat(p_type, 40), 1, 200) ELSE p_name || '; ' || p_type END AS t FROM part")
def sca18_matching_text(spark: SparkSession, sf: str) -> DataFrame:
    t = R.matching_text(_pick("p_partkey", "anchor", "slab", "bundle"), F.col("p_name"), F.array("p_brand", "p_type"), F.col("p_name"), F.repeat("p_type", F.lit(40)), F.array("p_name", "p_type"))
    return table(spark, sf, "part").select("p_partkey", t.alias("t"))


@query(f"WITH {GRAPH} SELECT e.src, e.dst, CASE WHEN b.ord % 2 = 0 THEN substr(repeat(b.label, 20), 1, 180) ELSE e.dst END AS partner FROM edges e JOIN nodes b ON b.id = e.dst WHERE e.type = 'CONFLICTS'")
def sca22_partner(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf).select("id", F.when(F.col("ord") % 2 == 0, F.repeat("label", F.lit(20))).otherwise("").alias("text"))
    return R.partner_texts(edges(spark, sf).where("type = 'CONFLICTS'").select("src", "dst"), n)


@query("SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE p_type END AS body FROM part")
def val05_identity_lock(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    rewrites = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit("renamed").alias("title"), F.upper("p_type").alias("body"))
    return R.identity_locked(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("body")), rewrites, ["title"], ["body"])


@query("SELECT user_id AS id, round(greatest(0, least(1, 0.5 + coalesce(sum(CASE event_type WHEN 'click' THEN 0.05 WHEN 'error' THEN -0.05 END), 0))), 6) AS value FROM events GROUP BY user_id")
def lif08_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumnRenamed("user_id", "id")
    steps = e.where("event_type IN ('click', 'error')").select("id", F.when(F.col("event_type") == "click", 0.05).otherwise(-0.05).alias("delta"))
    return R.adjusted_salience(e.select("id", F.lit(0.5).alias("value")).distinct(), steps).select("id", F.round("value", 6).alias("value"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'RETIRED' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 14 = 0 THEN 'note' ELSE o_orderpriority END AS notes FROM orders")
def lif09_edit(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    edits = o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"), F.lit("RETIRED").alias("status"), F.when(F.col("o_orderkey") % 14 == 0, "note").alias("notes"))
    return R.edited(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("notes")), edits, ["status", "notes"])


@query(f"""WITH {GRAPH}, b AS (SELECT id, CAST(1 AS DOUBLE) AS w FROM nodes WHERE type = 'slab' AND ord < 5), l AS (SELECT e.dst AS id, max(e.weight) AS w FROM edges e JOIN b ON e.src = b.id WHERE e.type = 'LINKS' GROUP BY 1) SELECT id, max(w) AS weight FROM (SELECT * FROM b UNION ALL SELECT * FROM l) GROUP BY id""")
def grf23_seeding(spark: SparkSession, sf: str) -> DataFrame:
    return R.seeded(nodes(spark, sf).where("type = 'slab' AND ord < 5").select("id"), edges(spark, sf))


@query("WITH n AS (SELECT label, count(*) FILTER (embedding[1] > 0.3) AS r, label % 4 AS s FROM embeddings GROUP BY label) SELECT label, CASE WHEN s = 0 OR r < 3 THEN 'flat' ELSE 'ranked' END AS mode, CAST(CASE WHEN s = 0 THEN 0.55 WHEN r < 3 THEN 0.7 END AS DOUBLE) AS threshold FROM n")
def grf31_fallback(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "embeddings").groupBy("label").agg(F.count_if(F.col("embedding")[0] > F.lit(0.3).cast("float")).alias("r"))
    p = n.select("label", R.retrieval_policy(F.col("r"), F.col("label") % 4).alias("p"))
    return p.select("label", "p.mode", "p.threshold")


@query("SELECT o_orderpriority, count(*) AS n, round(100 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS kept_pct FROM orders GROUP BY 1")
def agg19_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.kept_share(table(spark, sf, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "KEEP").otherwise("DEMOTE").alias("verdict")), "o_orderpriority")


@query("""SELECT p_brand, CASE k % 4 WHEN 0 THEN 'one two three' WHEN 1 THEN 'one two' WHEN 2 THEN 'one' ELSE 'x a' END AS label FROM (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY 1)""")
def agg23_fallback_label(spark: SparkSession, sf: str) -> DataFrame:
    """Titles that share three, two, one or no leading words; only the first five count."""
    k = F.col("k") % 4
    titles = F.when(k == 0, _one("one two three four", "one two three")).when(k == 1, _one("one two x", "one two y")).when(k == 2, _one("one x", "one y", "one", "one z", "one q", "other")).otherwise(_one("x a", "y a"))
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k")).select("p_brand", R.common_lead(titles).alias("label"))
