"""Filter, join, projection and scalar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import rules as R
from weftline.functions import text as T
from weftline.operators import match as M
from weftline.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
query = registry.query
GRAPH = f"{NODES_SQL}, {EDGES_SQL}"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# -- filters --------------------------------------------------------------------------------------
@query(f"WITH {GRAPH} SELECT id, type FROM nodes WHERE contains(lower(id || ' ' || label), 'r#00000001') UNION ALL SELECT 'd' || doc_id, 'document' FROM documents WHERE contains(lower(source || ' ' || substr(text, 1, 200)), 'onth')")
def flt03_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf).where(F.contains(F.lower(F.concat_ws(" ", "id", "label")), F.lit("r#00000001"))).select("id", "type")
    d = _docs(spark, sf).where(F.contains(F.lower(F.concat_ws(" ", "source", F.substring("text", 1, 200))), F.lit("onth")))
    return n.unionByName(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("document").alias("type")))


@query("""SELECT event_id, NOT (event_type IN ('error', 'purchase')) OR value > 50 OR event_type IN ('purchase', 'signup') OR event_type IN ('object_of_work') AS open FROM events""")
def flt04_gate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", R.imperative_gate(F.col("event_type").isin("error", "purchase"), F.col("value") > 50, F.col("event_type"), F.array(F.lit("purchase"), F.lit("signup"))).alias("open"))


GATE_RULES = [
    {"priority": 2, "condition": "event_type == 'error' and value > 20", "outcome": "DENY"},
    {"priority": 1, "condition": "user_id in [1, 2, 3]", "outcome": "ALLOW"},
    {"priority": 0, "condition": "missing.field == 1", "outcome": "ESCALATE"},
    {"priority": 3, "condition": "not (value < 100)", "outcome": "ESCALATE"},
    {"priority": 4, "condition": "print('no')", "outcome": "DENY"},
]
_GATE = "CASE WHEN user_id IN (1, 2, 3) THEN 'ALLOW' WHEN event_type = 'error' AND value > 20 THEN 'DENY' WHEN NOT (value < 100) THEN 'ESCALATE' ELSE 'DEFER' END"


@query(f"SELECT event_id, {_GATE} AS outcome FROM events")
def flt05_rules(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", R.gate(GATE_RULES, "DEFER", e.schema).alias("outcome"))


@query(f"WITH g AS (SELECT event_id, {_GATE} AS a, CASE WHEN value > 90 THEN 'DENY' ELSE 'ALLOW' END AS b FROM events) SELECT event_id, CASE WHEN a IN ('DENY', 'ESCALATE') THEN a WHEN b IN ('DENY', 'ESCALATE') THEN b ELSE 'ALLOW' END AS outcome FROM g")
def flt06_gate_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    second = F.when(F.col("value") > 90, "DENY").otherwise("ALLOW")
    return e.select("event_id", R.gate_pipeline([R.gate(GATE_RULES, "DEFER", e.schema), second]).alias("outcome"))


_POSED = "posed AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'please review the anchors ' WHEN 1 THEN 'compare ' WHEN 2 THEN 'give me an overview of ' ELSE 'no, wait ' END || text AS text FROM conversations)"


def _posed(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with openings that the classifiers tell apart."""
    k = F.col("turn") % 4
    opening = F.when(k == 0, "please review the anchors ").when(k == 1, "compare ").when(k == 2, "give me an overview of ").otherwise("no, wait ")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(opening, "text").alias("text"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"WITH {_POSED} SELECT conv_id, turn, length(trim(text)) >= 10 AND regexp_matches(text, '(?i){_re2(R.REVIEW_VERBS)}') AND regexp_matches(text, '(?i){_re2(R.CORPUS_NOUNS)}') AS review FROM posed")
def flt08_review_intent(spark: SparkSession, sf: str) -> DataFrame:
    return _posed(spark, sf).select("conv_id", "turn", R.is_review(F.col("text")).alias("review"))


@query(f"WITH {_POSED} SELECT conv_id, turn, regexp_matches(substr(text, 1, 2000), '(?i){_re2('|'.join(R.SYNTHESIS))}') OR turn % 3 >= 2 AS synthesis FROM posed")
def flt09_synthesis_intent(spark: SparkSession, sf: str) -> DataFrame:
    return _posed(spark, sf).select("conv_id", "turn", R.is_synthesis(F.col("text"), F.col("turn") % 3).alias("synthesis"))


@query(f"""WITH {_POSED}, s AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE (conv_id % 10) / CAST(10 AS DOUBLE) END AS sim, trim(text) AS t FROM posed)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'ambiguous' WHEN regexp_matches(t, '(?i){_re2(R.REJECT)}') THEN 'explicit_reject' WHEN regexp_matches(t, '(?i){_re2(R.ACCEPT)}') THEN 'explicit_accept'
 WHEN sim IS NOT NULL AND sim < 0.3 AND length(t) < 80 THEN 'implicit_accept' WHEN sim > 0.5 THEN 'unresolved' WHEN sim IS NOT NULL THEN 'ambiguous' WHEN length(t) < 80 THEN 'implicit_accept' ELSE 'unresolved' END AS resolution FROM s""")
def flt14_resolution(spark: SparkSession, sf: str) -> DataFrame:
    sim = F.when(F.col("conv_id") % 3 == 0, None).otherwise((F.col("conv_id") % 10) / 10)
    return _posed(spark, sf).select("conv_id", "turn", R.resolution(F.col("text"), sim).alias("resolution"))


_STARTS = " OR ".join("starts_with(low, '{}')".format(s.replace("'", "''")) for s in R.STARTERS)
_UNTAGGED = f"len(list_filter(list_transform(list_slice(string_split_regex(text, '[.!]\\s+|\\n'), 1, 15), lambda s: trim(s)), lambda s: length(s) >= 50 AND NOT ends_with(lower(s), '?') AND NOT ({_STARTS.replace('low', 'lower(s)')}) AND NOT regexp_matches(s, '{R.CLAIM_TAG}')))"


@query(f"SELECT doc_id, CAST({_UNTAGGED} AS INTEGER) AS untagged FROM documents")
def flt17_untagged(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", R.untagged_claims(F.col("text")).alias("untagged"))


def _phrases(groups: dict[str, tuple[str, ...]]) -> str:
    return " + ".join("CAST(" + " OR ".join("contains(low, '{}')".format(p.replace("'", "''")) for p in g) + " AS INTEGER)" for g in groups.values())


_OUTPUTS = "outs AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'It is known that. ' WHEN 1 THEN 'Let me be clear. You should do it. You must go. ' ELSE '' END || text AS text FROM documents)"


@query(f"""WITH {_OUTPUTS}, m AS (SELECT *, lower(text) AS low, doc_id % 3 AS streak, len(regexp_extract_all(text, '{_re2(R.DIRECTIVES)}')) >= 2 AND doc_id % 8 <> 5 AS slope FROM outs),
n AS (SELECT doc_id, CASE WHEN slope THEN least(streak + 1, 3) ELSE 0 END AS step, {_phrases(R.HARD_PHRASES)} + CAST({_UNTAGGED} > 3 AS INTEGER) AS hard, {_phrases({k: v for k, v in R.SOFT_PHRASES.items() if k != "style"})} + CASE WHEN doc_id % 8 = 1 THEN 0 ELSE {_phrases({"style": R.SOFT_PHRASES["style"]})} END AS soft FROM m),
f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE CAST(step AS INTEGER) END AS step, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE hard + CAST(step >= 3 AS INTEGER) END AS hard, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE soft + CAST(step BETWEEN 1 AND 2 AS INTEGER) END AS soft FROM n)
SELECT doc_id, step, hard, soft, CASE WHEN hard = 0 AND soft = 0 THEN 'PASS' WHEN hard = 0 THEN 'FLAGGED' WHEN doc_id % 2 = 0 THEN 'BLOCK' ELSE 'REGENERATE' END AS status FROM f""")
def flt16_validator(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 4
    opening = F.when(k == 0, "It is known that. ").when(k == 1, "Let me be clear. You should do it. You must go. ").otherwise("")
    outs = _docs(spark, sf).select("doc_id", F.concat(opening, "text").alias("text"))
    lifted = F.when(F.col("doc_id") % 8 == 1, F.array(F.lit("style"))).when(F.col("doc_id") % 8 == 5, F.array(F.lit("slope"), F.lit("floor")))
    out = outs.select("doc_id", R.validated(F.col("text"), F.col("doc_id") % 2 == 0, (F.col("doc_id") % 3).cast("int"), F.col("doc_id") % 11 != 0, lifted).alias("v"))
    return out.select("doc_id", "v.step", "v.hard", "v.soft", "v.status")


@query("SELECT conv_id, turn FROM conversations WHERE turn > 0 AND turn % 2 = 0")
def flt27_cadence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("turn > 0 AND turn % 2 = 0").select("conv_id", "turn")


# -- joins ----------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT p_name AS label, 'p' || p_partkey AS id, 1 AS priority FROM part UNION ALL SELECT p_type, 't' || p_partkey, 2 FROM part), r AS (SELECT lower(trim(label)) AS key, id, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY priority, id) AS k FROM e) SELECT key, id FROM r WHERE k = 1""")
def joi01_label_index(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    a = p.select(F.col("p_name").alias("label"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit(1).alias("priority"))
    b = p.select(F.col("p_type").alias("label"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"), F.lit(2).alias("priority"))
    return M.label_index(a.unionByName(b))


@query()
def joi02_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Misspelt and extended names against the names; alike ones need a ratio that SQL has no function for."""
    p = table(spark, sf, "part")
    index = M.label_index(p.select(F.col("p_name").alias("label"), F.col("p_name").alias("id"), F.lit(1).alias("priority")))
    asked = p.select(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" kit"))).when(F.col("p_partkey") % 3 == 1, F.regexp_replace("p_name", "e", "ee")).otherwise(F.upper("p_name")).alias("label"))
    return M.resolve_labels(asked, index)


_EDGE_LABELS = "pr AS (SELECT l_returnflag AS type, 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS s, 'NATION_' || l_partkey % 30 AS d, l_discount * 20 AS c FROM lineitem)"


@query(f"""WITH {GRAPH}, {_EDGE_LABELS}, ix AS (SELECT lower(label) AS key, min(id) AS id FROM nodes GROUP BY 1), r AS (SELECT 'LINKS' AS type, a.id AS src, b.id AS dst, max(greatest(0, least(1, c))) AS confidence FROM pr JOIN ix a ON a.key = lower(s) JOIN ix b ON b.key = lower(d) WHERE a.id <> b.id GROUP BY 1, 2, 3)
SELECT type, src, dst, round(confidence, 6) AS confidence FROM r WHERE (type, src, dst) NOT IN (SELECT type, src, dst FROM edges)""")
def joi04_edges(spark: SparkSession, sf: str) -> DataFrame:
    index = M.label_index(nodes(spark, sf).select("label", "id", F.lit(0).alias("priority")))
    key = F.lpad(F.col("l_suppkey").cast("string"), 9, "0")
    proposed = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("type"), F.concat(F.lit("Supplier#"), key).alias("src_label"), F.concat(F.lit("NATION_"), (F.col("l_partkey") % 30).cast("string")).alias("dst_label"), (F.col("l_discount") * 20).alias("confidence")
    )
    out = M.resolved_edges(proposed, index, edges(spark, sf), ["INVOKES", "SUPPORTS", "LINKS", "SEQUENCE"])
    return out.select("type", "src", "dst", F.round("confidence", 6).alias("confidence"))


_PHRASES = "ph AS (SELECT item_id AS id, array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 4), ' ') AS p FROM benchmark)"


@query(f"WITH {_PHRASES}, t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents) SELECT doc_id, id FROM t, ph WHERE contains(t, ' ' || p || ' ')")
def joi06_phrases(spark: SparkSession, sf: str) -> DataFrame:
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 1, 4)
    phrases = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.array_join(words, " ").alias("phrase"))
    return M.phrase_hits(_docs(spark, sf).select(F.col("doc_id").alias("text_id"), "text"), phrases).select(F.col("text_id").alias("doc_id"), "id")


@query("""WITH a AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM conversations), b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM benchmark),
s AS (SELECT conv_id, item_id, count(*) AS overlap FROM a JOIN b USING (w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, item_id) AS k FROM s) SELECT conv_id, item_id, overlap FROM r WHERE k <= 5""")
def joi15_overlap(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "conversations").select(F.col("conv_id").alias("text_id"), "text")
    return M.word_overlap(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), texts, 5).select(F.col("text_id").alias("conv_id"), F.col("id").alias("item_id"), "overlap")


@query("""WITH a AS (SELECT p_name AS key, p_partkey AS id, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part WHERE p_size < 20), b AS (SELECT p_name AS key, p_partkey AS id, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part WHERE p_size >= 30) SELECT key, a.id AS a, b.id AS b FROM a JOIN b USING (key, n)""")
def joi17_in_order(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("id"), "p_size")
    return M.paired_in_order(p.where("p_size < 20"), p.where("p_size >= 30"))


@query("""WITH k AS (SELECT trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS key, bool_or(p_size < 10) AS b, bool_or(p_size > 40) AS c FROM part WHERE p_size < 10 OR p_size > 40 GROUP BY 1) SELECT key, CASE WHEN b AND c THEN 'both' WHEN b THEN 'only_baseline' ELSE 'only_candidate' END AS side FROM k""")
def joi19_overlap_diff(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("label"), "p_size")
    return M.overlap_classes(p.where("p_size < 10"), p.where("p_size > 40"))


@query("SELECT l_orderkey AS id, 'part' AS field FROM lineitem WHERE l_partkey = 7 UNION ALL SELECT l_orderkey, 'supplier' FROM lineitem WHERE l_suppkey = 7")
def joi20_reverse(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    refs = li.select(F.col("l_orderkey").alias("id"), F.explode(F.array(F.struct(F.lit("part").alias("field"), F.col("l_partkey").alias("ref")), F.struct(F.lit("supplier").alias("field"), F.col("l_suppkey").alias("ref")))).alias("r"))
    return M.reverse_references(refs.select("id", "r.field", "r.ref"), F.lit(7))


@query("SELECT p_partkey, min(p_brand) AS owner, count(DISTINCT l_suppkey) AS touching, count(l_orderkey) = 0 AS safe_to_delete FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def joi21_dependents(spark: SparkSession, sf: str) -> DataFrame:
    use = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("touching"))
    out = table(spark, sf, "part").join(use, "p_partkey", "left")
    return out.select("p_partkey", F.col("p_brand").alias("owner"), F.coalesce("touching", F.lit(0)).alias("touching"), F.col("touching").isNull().alias("safe_to_delete"))


# -- projections and scalars ----------------------------------------------------------------------
@query("SELECT doc_id, coalesce(nullif(trim(substr(text, 1, 60)), ''), CAST(doc_id AS VARCHAR)) AS title FROM documents")
def prj04_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.first_of(F.trim(F.substring("text", 1, 60)), F.col("doc_id").cast("string")).alias("title"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (regexp_matches(line, '^#{1,6}[ \\t]+')) AS headings, count(*) FILTER (trim(line) = '') AS blanks FROM l GROUP BY doc_id""")
def prj11_headings(spark: SparkSession, sf: str) -> DataFrame:
    line = _docs(spark, sf).select("doc_id", F.split("text", "\n", -1).alias("l"))
    return line.select("doc_id", F.size(F.filter("l", lambda x: x.rlike(r"^#{1,6}[ \t]+"))).cast("long").alias("headings"), F.size(F.filter("l", lambda x: F.trim(x) == "")).cast("long").alias("blanks"))


@query(f"SELECT doc_id, array_to_string({T.search_tokens_sql('text')}, ' ') AS tokens FROM documents")
def sca01_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(T.search_tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS words FROM documents")
def sca03_word_set(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.size(T.word_set(F.col("text"))).cast("long").alias("words"))


@query("SELECT p_partkey, lower(trim(p_name)) AS key, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part")
def sca04_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.label_key(F.col("p_name")).alias("key"), T.alnum_key(F.col("p_brand")).alias("norm"))


@query("SELECT p_partkey, regexp_replace(substr(regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 12), '_+$', '') AS slug FROM part")
def sca06_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_brand", "p_name"), 12).alias("slug"))


@query("SELECT s_suppkey, 'e_' || substr(sha1(s_name || s_nationkey), 1, 10) AS id FROM supplier")
def sca08_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", T.stable_id("e_", F.col("s_name"), F.col("s_nationkey").cast("string")).alias("id"))


@query("SELECT doc_id, CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS tokens FROM documents")
def sca09_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@query("""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def sca13_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "benchmark").select("item_id", T.word_set(F.col("text")).alias("w"))
    a, b = w.select(F.col("item_id").alias("a"), F.col("w").alias("u")), w.select(F.col("item_id").alias("b"), F.col("w").alias("v"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(T.jaccard(F.col("u"), F.col("v")), 6).alias("jaccard"))


@query("WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 119) || '…' ELSE t END AS line FROM f")
def sca14_one_line(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.one_line(F.col("text")).alias("line"))


@query("SELECT event_id, CASE WHEN event_id * 30 < 3600 THEN event_id * 30 // 60 || 'm' WHEN event_id * 30 < 86400 THEN event_id * 30 // 3600 || 'h' ELSE event_id * 30 // 86400 || 'd' END AS age FROM events")
def sca15_age(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.age(F.col("event_id") * 30).alias("age"))
