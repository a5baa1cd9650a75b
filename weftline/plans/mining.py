"""Queries of renderers, outlines and miners, with extractors whose answers SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import render as R
from weftline.operators import miners as M
from weftline.operators import outline as O
from weftline.plans.registry import Registry
from weftline.session import ship
from weftline.sources.tables import table

registry = Registry()
query = registry.query


@query("SELECT p_partkey, p_name || ': ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE substr(repeat(p_type, 40), 1, 160) END AS item, '- id=' || p_partkey || ' | title: ' || p_name || ' | text: ' || substr(repeat(p_type || ' ', 40), 1, 80) AS line FROM part")
def sca21_items(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    description = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(" ")
    item = R.summary_item(F.col("p_name"), description, F.repeat("p_type", F.lit(40)))
    return p.select("p_partkey", item.alias("item"), R.grouping_line(F.col("p_partkey").cast("string"), F.col("p_name"), F.repeat(F.concat("p_type", F.lit("\n")), F.lit(40))).alias("line"))


_SECTION = "['seed', 'conflict', 'tension', 'supported', 'support2', 'divergent', 'odd'][s_suppkey % 7 + 1]"


@query(f"""WITH n AS (SELECT s_nationkey AS query, {_SECTION} AS section, s_suppkey AS place, s_name, CASE WHEN s_suppkey % 14 = 1 THEN 's0' ELSE 'none' END AS other FROM supplier),
l AS (SELECT query, section, place, '  [slab] ' || s_name || CASE WHEN section = 'conflict' THEN chr(10) || '      [in opposition to: ' || CASE other WHEN 's0' THEN (SELECT s_name FROM supplier WHERE s_suppkey = 0) ELSE other END || ']' ELSE '' END || CASE WHEN section IN ('conflict', 'tension') THEN chr(10) || '      [why: because]' ELSE '' END AS line FROM n),
b AS (SELECT query, section, string_agg(line, chr(10) ORDER BY place) AS body FROM l GROUP BY ALL), h AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(R.SECTIONS))}) v(k, section, heading))
SELECT query, string_agg(heading || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY k) AS text FROM b JOIN h USING (section) GROUP BY query""")
def sca20_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers by nation as nodes of a synthesis."""
    s = table(spark, sf, "supplier")
    section = F.array(*[F.lit(x) for x in ("seed", "conflict", "tension", "supported", "support2", "divergent", "odd")])[(F.col("s_suppkey") % 7).cast("int")]
    nodes = s.select(
        F.col("s_nationkey").alias("query"), section.alias("section"), F.col("s_suppkey").alias("place"), F.col("s_name").alias("id"), F.lit("slab").alias("type"), F.col("s_name").alias("text"),
        F.when(F.col("s_suppkey") % 14 == 1, "s0").otherwise("none").alias("conflicts_with"), F.lit(" because ").alias("why"),
    )
    return R.synthesis_prompt(nodes, s.where("s_suppkey = 0").select(F.lit("s0").alias("id"), F.col("s_name").alias("text")))


@query("""WITH n AS (SELECT c_nationkey AS k, list({'id': c_name, 's': c_acctbal} ORDER BY c_custkey) AS l FROM customer GROUP BY 1)
SELECT k, '[ACTIVE FRAME]' || chr(10) || array_to_string(list_transform(l[1:24], lambda x: '  ' || x.id || ': salience=' || printf('%.2f', x.s)), chr(10)) || chr(10) || CASE WHEN k % 2 = 0 THEN 'conflicts:' || chr(10) || '  a <-> b: tension=0.50' || chr(10) ELSE '' END || 'mismatch_score: 0.25' || chr(10) || '[/ACTIVE FRAME]' AS block,
CASE WHEN k % 3 = 0 THEN '' ELSE '[GAUNTLET]' || chr(10) || 'Claim: c' || chr(10) || 'Alternatives:' || chr(10) || '  - x' || chr(10) || '  - y' || chr(10) || '  - z' || chr(10) || 'Verdict: failed' || chr(10) || '[/GAUNTLET]' END AS friction FROM n""")
def sca23_blocks(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.col("c_name").alias("id"), F.col("c_acctbal").alias("salience")))).alias("l"))
    pair = F.struct(F.lit("a").alias("a"), F.lit("b").alias("b"), F.lit(0.5).alias("tension"))
    conflicts = F.when(F.col("k") % 2 == 0, F.array(pair)).otherwise(F.slice(F.array(pair), 1, 0))
    none = F.lit(None).cast("array<string>")
    friction = R.friction_block(F.col("k") % 3 != 0, F.lit("failed"), F.lit("c"), F.array(*[F.lit(x) for x in ("x", "", "y", "z", "w")]), none, none, F.lit(None).cast("string"))
    return own.select("k", R.frame_block(F.col("l"), conflicts, F.lit(0.25)).alias("block"), friction.alias("friction"))


@query("""SELECT doc_id, CASE WHEN strpos(lower(text), 'licensed under the') > 0 THEN strpos(lower(text), 'licensed under the') - 1 WHEN strpos(lower(text), 'rights reserved') > 0 THEN strpos(lower(text), 'rights reserved') - 1 ELSE 1000000000000 END * 1000 + doc_id % 1000 AS ord FROM documents""")
def sca24_evidence_order(spark: SparkSession, sf: str) -> DataFrame:
    quotes = F.array(F.lit("short...Licensed under the... nothing else"))
    temp = F.concat(F.lit("t"), (F.col("doc_id") % 1000).cast("string"))
    return table(spark, sf, "documents").select("doc_id", O.evidence_order(quotes, F.array(F.lit("Top"), F.lit("Rights Reserved")), F.col("text"), temp).alias("ord"))


_SECTIONS_SQL = """s AS (SELECT 0 AS doc, CAST(r_regionkey AS INTEGER) AS idx, CAST(NULL AS INTEGER) AS parent, r_name AS label, CAST(r_regionkey AS INTEGER) AS start FROM region UNION ALL SELECT 0, 100 + n_nationkey, n_regionkey, n_name, 100 + n_nationkey FROM nation),
p AS (SELECT *, label AS path, 0 AS tier FROM s WHERE parent IS NULL UNION ALL SELECT c.*, r.label || ' / ' || c.label, 1 FROM s c JOIN s r ON r.idx = c.parent)"""


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as top sections, nations below them."""
    r = table(spark, sf, "region").select(F.lit(0).alias("doc"), F.col("r_regionkey").cast("int").alias("idx"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("label"), F.lit(1).alias("level"), F.col("r_regionkey").cast("int").alias("start"))
    k = F.col("n_nationkey").cast("int") + 100
    return r.unionByName(table(spark, sf, "nation").select(F.lit(0).alias("doc"), k.alias("idx"), F.col("n_regionkey").cast("int").alias("parent"), F.col("n_name").alias("label"), F.lit(2).alias("level"), k.alias("start")))


@query(f"""WITH {_SECTIONS_SQL}, t AS (SELECT 100 + s_nationkey AS idx, string_agg(s_name, ',' ORDER BY s_suppkey) AS titles FROM supplier GROUP BY 1), x AS (SELECT p.*, p.idx NOT IN (SELECT parent FROM s WHERE parent IS NOT NULL) AS leaf FROM p)
SELECT path, CAST(tier AS INTEGER) AS tier, CASE WHEN tier = 1 THEN regexp_extract(path, '^(.*) / ', 1) END AS parent_path, leaf, CASE WHEN leaf THEN coalesce(titles, '') END AS titles, CASE WHEN leaf THEN CASE WHEN x.idx = 103 THEN 'NATION_5 (4),NATION_4 (2)' ELSE '' END END AS crossings FROM x LEFT JOIN t USING (idx)""")
def prj18_outline(spark: SparkSession, sf: str) -> DataFrame:
    """The outline of regions and nations with suppliers as slabs and two crossings of one nation."""
    s = _sections(spark, sf)
    p = O.paths(s).select("doc", "idx", "path")
    slabs = table(spark, sf, "supplier").select((F.col("s_nationkey").cast("int") + 100).alias("idx"), F.col("s_suppkey").alias("n"), F.col("s_name").alias("title")).join(p, "idx").select("doc", "path", "n", "title")
    home = p.where("idx = 103").select("doc", F.col("path").alias("home"))
    crossings = home.crossJoin(p.where("idx IN (104, 105)").select(F.col("path").alias("target"), ((F.col("idx") - 103) * 2).alias("weight")))  # two rows
    out = O.outline_rows(s, slabs, crossings, p.limit(0).select("doc", "path", F.lit("").alias("summary")))
    return out.select("path", "tier", "parent_path", "leaf", F.array_join("slab_titles", ",").alias("titles"), F.array_join("cross_edges", ",").alias("crossings"))


@query("SELECT c_custkey AS request, CASE WHEN c_custkey % 5 = 0 THEN 'clustering' WHEN c_custkey % 7 = 0 THEN 'session' WHEN c_custkey % 3 = 0 THEN 'outline' WHEN c_custkey % 3 = 1 THEN 'outline_deep' ELSE 'collection' END AS builder FROM customer")
def grf34_builders(spark: SparkSession, sf: str) -> DataFrame:
    """Requests by their builder: an outline of two tiers, one of three, and none."""
    two = _sections(spark, sf)
    deep = two.withColumn("doc", F.lit(1)).unionByName(spark.createDataFrame([(1, 999, 100, "deep", 3, 999)], "doc int, idx int, parent int, label string, level int, start int"))
    k = F.col("c_custkey")
    requests = table(spark, sf, "customer").select(k.alias("request"), (k % 5 == 0).alias("cluster"), F.when(k % 7 == 0, "s").alias("session"), (k % 3).cast("int").alias("doc"))
    return O.pillar_builder(requests, two.unionByName(deep))


@query("""WITH c AS (SELECT conv_id, turn, text, CASE conv_id % 4 WHEN 0 THEN 'work' WHEN 1 THEN 'play' ELSE 'other' END AS f FROM conversations) SELECT conv_id, turn, f AS "function", CAST(CASE f WHEN 'work' THEN 1 WHEN 'play' THEN 0.25 ELSE 0 END AS DOUBLE) AS affect FROM c""")
def udf03_classified(spark: SparkSession, sf: str) -> DataFrame:
    """Messages classified by a model that reads a mark before them, answers out of range, or fails to know."""
    ship(spark)
    mark = F.array(F.lit("W"), F.lit("P"), F.lit("U"), F.lit("-"))[(F.col("conv_id") % 4).cast("int")]
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(mark, "text").alias("text"))
    answers = {"W": {"function": "work", "affect": 7.0}, "P": {"function": "play", "affect": 0.25}, "U": {"function": "unheard of"}}
    return M.classified(m, lambda prompt: answers.get(prompt[9], {}), ["work", "play"], "other").select("conv_id", "turn", "function", "affect")


@query("""WITH u AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS pr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations WHERE role IN ('user', 'assistant')),
p AS (SELECT conv_id, CASE role WHEN 'user' THEN text END AS u, CASE WHEN role = 'assistant' THEN text WHEN nr = 'assistant' THEN nt END AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pair FROM u WHERE role = 'user' OR coalesce(pr, '') <> 'user'),
k AS (SELECT conv_id, unnest(list_filter([pair, pair - 1, pair - 2, pair - 3], lambda s: s >= 0 AND s % 2 = 0)) AS start, pair, 'User: ' || coalesce(substr(u, 1, 500), '') || CASE WHEN a IS NOT NULL THEN chr(10) || chr(10) || 'Assistant: ' || substr(a, 1, 500) ELSE '' END AS line FROM p),
t AS (SELECT conv_id, start, string_agg(line, chr(10) || chr(10) ORDER BY pair) AS text FROM k GROUP BY ALL) SELECT conv_id, start, length(substr(text, 1, 4000)) AS chars FROM t WHERE length(text) >= 100""")
def udf17_chunk_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The prompts of all chunks of all conversations."""
    from weftline.operators import windows as S

    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("chat"), F.col("turn").cast("long").alias("turn"), "role", "text")
    chunks = S.chunk_pairs(S.pair_exchanges(m))
    said = lambda name: m.select("chat", F.col("turn").alias(f"{name}_turn"), F.col("text").alias(name))
    full = chunks.join(said("user"), ["chat", "user_turn"], "left").join(said("assistant"), ["chat", "assistant_turn"], "left")
    out = M.chunk_prompts(full.select(F.struct("chat", "start").alias("key"), F.lit("").alias("topic"), "pair", "user", "assistant"))
    return out.select(F.col("key.chat").alias("conv_id"), F.col("key.start").cast("long").alias("start"), (F.length("prompt") - len("TOPIC: \n")).cast("long").alias("chars"))


@query("""SELECT 'anchor' AS type, 'word' AS label, CAST(0.9 AS DOUBLE) AS confidence UNION ALL SELECT 'slab', 'title', CAST(0.5 AS DOUBLE)""")
def udf05_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals of all conversations by a model that always answers the same: one of each that holds."""
    ship(spark)
    answer = {"proposals": [{"type": "anchor", "canonical_phrase": " word ", "confidence": 0.9}, {"type": "anchor", "canonical_phrase": "Word", "confidence": 0.4}, {"type": "slab", "title": "title", "canonical_text": "x"}, {"type": "slab", "title": "t"}, {"type": "odd", "label": "l"}, {"type": "bundle", "label": "b", "confidence": 0.1}]}
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("chat"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return M.conversation(m, {"on": ["tion", "on"], "er": ["er"]}, lambda _: answer, least=0.2).select("type", "label", "confidence")


@query("""WITH d AS (SELECT doc_id, 0 AS segment, text AS whole, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS text FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM d WHERE length(text) BETWEEN 100 AND 2000 AND NOT regexp_matches(whole, '\\n\\s*\\n'))
SELECT doc_id, segment, length(text) AS chars FROM o WHERE k = 1""")
def udf09_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals of documents that are one segment, by a model that answers each prompt by a label of its own; copies are one."""
    ship(spark)
    d = table(spark, sf, "documents")
    bare = F.regexp_replace("text", r"^[ \n\t\r]+|[ \n\t\r]+$", "")
    one = d.where(F.length(bare).between(100, 2000) & ~F.col("text").rlike(r"\n\s*\n")).select("doc_id", "text")
    out = M.document(one, lambda p: {"proposals": [{"type": "bundle", "label": prompt_name(p)}]}, least=0.1)
    lengths = out.select(F.col("key.doc_id").alias("doc_id"), F.col("key.segment").cast("int").alias("segment"))
    parts = one.select("doc_id", F.length(bare).cast("long").alias("chars"))
    return lengths.join(parts, "doc_id").select("doc_id", "segment", "chars")


def prompt_name(prompt: str) -> str:
    """A label that differs for different prompts."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(prompt.encode("utf-8", "surrogatepass"))


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'rule' ELSE 'warning' END AS category, CAST(CASE p_size % 4 WHEN 0 THEN 1 ELSE 0.5 END AS DOUBLE) AS confidence FROM part WHERE p_size % 4 < 2""")
def udf10_directives(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    p = table(spark, sf, "part")
    mark = F.array(*[F.lit(x) for x in ("rule", "warn", "oddly", "empty")])[(F.col("p_size") % 4).cast("int")]
    slabs = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.concat(mark, F.lit(" and text of some length")).alias("text"))
    answers = {"rule": {"category": " RULE ", "quote": "q", "confidence": 3}, "warn": {"category": "warning", "quote": "q"}, "oddl": {"category": "odd", "quote": "q"}, "empt": {"category": "rule", "quote": " "}}
    out = M.directives(slabs, lambda prompt: {"extractions": [answers[prompt.rsplit("TEXT:\n", 1)[1][:4]]]})
    return out.select(F.col("id").cast("int").alias("id"), "category", "confidence")


@query("""WITH b AS (SELECT 'b' || s_suppkey AS id, s_nationkey AS n, s_suppkey AS k FROM supplier) SELECT CASE WHEN n % 2 = 0 THEN 'bundle_' || CASE WHEN n < 10 THEN 'low' ELSE 'high' END || CASE WHEN r = 1 THEN '' ELSE '_' || r END || '_v1' END AS id, count(*) AS sources FROM
(SELECT *, dense_rank() OVER (PARTITION BY n % 2, n < 10 ORDER BY n) AS r FROM b) WHERE n % 2 = 0 GROUP BY ALL UNION ALL SELECT id, 1 FROM b WHERE n % 2 = 1""")
def ded07_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as bundles that an answer merges for every other nation; the rest is carried through."""
    s = table(spark, sf, "supplier")
    ident = F.concat(F.lit("b"), F.col("s_suppkey").cast("string"))
    bundles = s.select(ident.alias("id"), F.col("s_name").alias("label"), F.array("s_name").alias("intent"), F.array(F.col("s_suppkey").cast("string")).alias("depends_on"), F.array().cast("array<string>").alias("supports"))
    answers = s.where("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("n")).agg(F.when(F.first("s_nationkey") < 10, " Low ").otherwise("High").alias("label"), F.array(F.lit("intent")).alias("intent"), F.concat(F.collect_list(ident), F.array(F.lit("unknown"))).alias("sources"))
    empty = s.limit(1).select(F.lit(-1).alias("n"), F.lit(" ").alias("label"), F.array(F.lit("x")).alias("intent"), F.array(F.lit("b0")).alias("sources"))
    return M.merged_by_model(bundles, answers.unionByName(empty)).select("id", F.size("sources").cast("long").alias("sources"))


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'g' || s_nationkey % 4 WHEN s_suppkey % 3 = 1 THEN 'g0' END AS \"group\", 's' || s_suppkey AS id FROM supplier WHERE s_suppkey % 3 < 2 UNION ALL SELECT 'orphan', 's' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 2")
def udf11_grouped(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers grouped by an answer with marks around its ids, some assigned later, the others orphans."""
    s = table(spark, sf, "supplier")
    ident = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    slabs = s.select(ident.alias("id"))
    name = F.concat(F.lit("g"), (F.col("s_nationkey") % 4).cast("string"))
    groups = s.where("s_suppkey % 3 = 0").groupBy(name.alias("group")).agg(F.concat(F.collect_list(F.concat(F.lit("[id="), ident, F.lit("]"))), F.array(F.lit("s-none"))).alias("members"))
    groups = groups.unionByName(s.limit(1).select(F.lit("g0").alias("group"), F.array(F.lit("x")).alias("members")))
    late = s.where("s_suppkey % 3 = 1").select(F.concat(F.lit("id="), ident).alias("id"), F.lit("g0").alias("group")).unionByName(s.where("s_suppkey % 3 = 2").select(ident.alias("id"), F.lit("no group").alias("group")))
    members, orphans = M.grouped(groups, slabs, late)
    return members.unionByName(orphans.select(F.lit("orphan").alias("group"), "id"))


@query("""WITH t AS (SELECT n_regionkey AS cluster, list(n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY 1) SELECT cluster, CASE WHEN cluster % 2 = 0 THEN 'told' ELSE 'common words' END AS label FROM t""")
def udf13_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters labelled by a model that answers for some, and by their common words for the others."""
    ship(spark)
    title = F.concat(F.lit("common words "), F.col("n_name"))
    own = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("cluster")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", title.alias("t")))).alias("l"))
    marked = own.select("cluster", F.when(F.col("cluster") % 2 == 0, F.transform("l", lambda x: F.concat(F.lit("even "), x["t"]))).otherwise(F.transform("l", lambda x: x["t"])).alias("titles"))
    return M.labelled_clusters(marked, lambda p: {"label": "told"} if "even" in p else {}).select("cluster", "label")


@query("""SELECT o_orderkey AS id, ['rewritten', 'breach', 'kept'][o_orderkey % 3 + 1] AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderpriority END AS after FROM orders WHERE o_orderstatus <> 'F'""")
def udf12_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    o = table(spark, sf, "orders")
    mark = F.array(F.lit("a"), F.lit("b"), F.lit("c"))[(F.col("o_orderkey") % 3).cast("int")]
    pending = o.select(F.col("o_orderkey").alias("id"), mark.alias("title"), F.col("o_orderpriority").alias("text"), F.lit("x").alias("context"))
    answers = {"a": {"title": " A", "text": "new"}, "b": {"title": "other", "text": "new"}, "c": {"text": ""}}
    return M.rewritten(pending, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), lambda p: answers[p.split("TITLE: ")[1][0]]).select("id", "verdict", "after")


@query("""WITH d AS (SELECT conv_id AS id, CASE conv_id % 4 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'RETRACTED' ELSE 'UNTOUCHED' END AS s FROM (SELECT DISTINCT conv_id FROM conversations)),
t AS (SELECT conv_id FROM conversations WHERE turn = 0 AND trim(text) <> '' INTERSECT SELECT conv_id FROM conversations WHERE turn = 1 AND trim(text) <> '') SELECT id, CASE WHEN id % 5 = 0 OR id NOT IN (SELECT conv_id FROM t) THEN 'UNTOUCHED' ELSE s END AS status FROM d""")
def udf16_disambiguated(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    c = table(spark, sf, "conversations")
    refs = F.when(F.col("conv_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    drafts = c.select("conv_id").distinct().select(F.col("conv_id").alias("id"), F.lit("UNTOUCHED").alias("status"), F.col("conv_id").alias("chat"), F.lit(0).alias("source_turn"), refs.alias("references"))
    mark = F.array(F.lit("C"), F.lit("R"), F.lit("?"), F.lit("-"))[(F.col("conv_id") % 4).cast("int")]
    turns = c.select(F.col("conv_id").alias("chat"), F.col("turn").cast("int").alias("turn"), F.when(F.trim("text") != "", F.concat(mark, "text")).alias("text"))
    answers = {"C": {"status": "confirmed"}, "R": {"status": "RETRACTED"}, "?": {"status": "odd"}}
    return M.disambiguated(drafts, turns, lambda p: answers.get(p[8], {})).select("id", "status")
