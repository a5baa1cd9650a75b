"""Queries of collections on disk, Word documents, transcripts, previews, and of the miners that build on outlines."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import models as M
from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.operators import lifecycle as L
from weftline.operators import miners as N
from weftline.operators import outline as O
from weftline.plans.corpus import EDGES_SQL, NODES_SQL, edges, nodes
from weftline.plans.registry import Registry
from weftline.session import scratch_root, ship
from weftline.sources import conversations as C
from weftline.sources import docx as X
from weftline.sources import sessions as S
from weftline.sources.tables import table
from weftline.streaming import sessions as Z

registry = Registry()
query = registry.query
GRAPH = f"{NODES_SQL}, {EDGES_SQL}"


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/archive-{uuid.uuid4().hex}"


@query("SELECT r_regionkey AS id, r_name AS name, 'list' AS file FROM region")
def src01_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A file with a list, one with an object, and one that is not there."""
    root = _folder(spark)
    r = table(spark, sf, "region").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))))).alias("value"))
    r.coalesce(1).write.text(f"{root}/list")
    r.select(F.lit('{"id": 1, "name": "x"}').alias("value")).coalesce(1).write.text(f"{root}/object")
    out = None
    for name in ("list", "object", "nothing"):
        part = S.listed(spark, f"{root}/{name}", "id int, name string").withColumn("file", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT * FROM (VALUES ('a', true), ('b', true), ('default', false)) t(collection, own)")
def src03_discovered(spark: SparkSession, sf: str) -> DataFrame:
    """Collections by their folders: two of their own, and the default one at the old place; a folder without objects is none."""
    root = _folder(spark)
    one = table(spark, sf, "region").select(F.col("r_name").alias("value")).coalesce(1)
    for path in ("corpora/a/objects", "corpora/b/objects", "corpora/empty", "objects"):
        one.write.text(f"{root}/{path}")
    return S.discovered(spark, root).select("collection", F.contains("path", F.lit("/corpora/")).alias("own"))


@query(f"WITH {GRAPH} SELECT collection, count(*) AS n FROM nodes WHERE collection IN ('geo', 'building') GROUP BY collection")
def src04_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the active collections, one of them absorbed and one never found."""
    persisted = spark.createDataFrame([("geo",), ("building",), ("supply",), ("gone",)], "collection string")
    absorbed = spark.createDataFrame([("supply",)], "collection string")
    return S.loaded(nodes(spark, sf), persisted, absorbed).groupBy("collection").agg(F.count("*").alias("n"))


@query("SELECT r_name AS collection, CASE WHEN r_regionkey < 2 THEN '/corpora/' || r_name WHEN r_regionkey = 4 THEN '/old' END AS path, CASE WHEN r_regionkey IN (2, 3) THEN 'unknown collection: ' || r_name END AS error FROM region")
def src29_collection(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select(F.col("r_name").alias("collection"), "r_regionkey")
    path = F.when(F.col("r_regionkey") < 2, F.concat(F.lit("/corpora/"), "collection")).when(F.col("r_regionkey") == 4, "/old")
    return S.collection_place(r, r.select("collection", path.alias("path")).where("path is not null"))


@query("SELECT s_suppkey AS id, s_acctbal AS weight FROM supplier WHERE s_nationkey < 20")
def src05_artefacts(spark: SparkSession, sf: str) -> DataFrame:
    """A frame saved twice and read back: the last version, and no rows of a session that saved none."""
    root = _folder(spark)
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("weight"), "s_nationkey")
    S.save_artefact(s.select("id", "weight"), root, "one", "frame")
    S.save_artefact(s.where("s_nationkey < 20").select("id", "weight"), root, "one", "frame")
    read = lambda name: S.load_artefact(spark, root, name, "frame", "id int, weight double")
    return read("one").unionByName(read("other"))


@query("SELECT 'registry' AS kind, count(*) AS n, 1 AS version FROM nation UNION ALL SELECT 'stack', count(*), 2 FROM region")
def snk04_artefacts(spark: SparkSession, sf: str) -> DataFrame:
    root = _folder(spark)
    n, r = table(spark, sf, "nation").select(F.col("n_name").alias("id")), table(spark, sf, "region").select(F.col("r_name").alias("id"))
    versions = {"registry": S.save_artefact(n, root, "s", "registry"), "stack": S.save_artefact(n, root, "s", "stack")}
    versions["stack"] = S.save_artefact(r, root, "s", "stack")
    parts = [S.load_artefact(spark, root, "s", k, "id string").agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.lit(v).alias("version")) for k, v in versions.items()]
    return parts[0].unionByName(parts[1])


@query("""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role, CASE turn % 5 WHEN 3 THEN '@' || text WHEN 4 THEN 'short' ELSE text END AS content FROM conversations WHERE role <> 'system'),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, substr(content, 1, 200) ORDER BY turn) AS d FROM t WHERE length(trim(content, ' ' || chr(10) || chr(9) || chr(13))) >= 10 AND NOT (role = 'user' AND starts_with(content, '@')))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS index, role, content FROM k WHERE d = 1""")
def src19_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts of a line a message, each written twice: rows that repeat, are short or only name a file are left out."""
    ship(spark)
    c = table(spark, sf, "conversations").where("role <> 'system'")
    text = F.when(F.col("turn") % 5 == 3, F.concat(F.lit("@"), "text")).when(F.col("turn") % 5 == 4, "short").otherwise(F.col("text"))
    kind = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    row = F.to_json(F.struct(kind.alias("type"), F.struct(text.alias("content")).alias("message")))
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(row, F.lit("\n"), row).alias("l"))))
    raws = c.groupBy("conv_id").agg(F.concat(F.lit('{"type": "queue-operation"}\n{"type": "queue-operation"}\n'), F.array_join(F.transform(lines, lambda x: x["l"]), "\n")).alias("raw"))
    return C.normalised(raws).select("conv_id", "index", "role", "content")


@query("SELECT 5 AS files, (SELECT sum(length(r_name)) FROM region) + 5 AS chars")
def src22_code_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a source folder by their ending, a file a region."""
    root = _folder(spark)
    table(spark, sf, "region").select(F.col("r_name").alias("value")).repartitionByRange(5, "value").write.text(f"{root}/src/deep")
    files = S.code_files(spark, f"{root}/src", (".txt",)).where(F.length("text") > 0)
    return files.agg(F.count("*").cast("int").alias("files"), F.sum(F.length("text")).alias("chars"))


@query("SELECT CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS INTEGER) AS place, 'd' || s_suppkey AS id, s_name AS shown FROM supplier")
def src26_health_drafts(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("id"), none.alias("phrase"), F.col("s_name").alias("title"), none.alias("label"), none.alias("text"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("file"), F.col("s_acctbal").alias("modified"))
    return S.health_drafts(rows).select("place", "id", "shown")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as Word documents: a list of contents, the nations as headings, a paragraph below each."""
    ship(spark)

    @F.pandas_udf("binary")
    def write(names: pd.Series) -> pd.Series:
        from weftline.sources.docx import written

        rows = lambda ns: [(1, "Contents"), (None, "left out"), (1, "Nations")] + [x for n in ns for x in ((2, n), (None, f"all about {n} & more"))]
        return pd.Series([written(rows(ns)) for ns in names])

    names = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    return names.select("doc", write("names").alias("content"))


@query("""SELECT n_regionkey AS doc, '# Nations' || chr(10) || chr(10) || string_agg('## ' || n_name || chr(10) || chr(10) || 'all about ' || n_name || ' & more', chr(10) || chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1""")
def src13_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return X.document_markdown(_documents(spark, sf))


@query("""SELECT n_regionkey AS doc, 'all about ' || n_name || ' & more' AS text, 'Nations / ' || n_name AS path FROM nation UNION ALL SELECT r_regionkey, 'left out', 'Contents' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")
def src28_heading_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = O.heading_paths(X.document_paragraphs(_documents(spark, sf))).where("NOT heading")
    return paths.select("doc", "text", F.array_join("path", " / ").alias("path"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Nations / ' || n_name WHEN 1 THEN 'Nations / ' || n_name WHEN 2 THEN 'Own topic' ELSE '' END AS path, ['quote', 'section_number', 'retained', 'unresolved'][s_suppkey % 4 + 1] AS how FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def joi25_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Sidecars that quote a paragraph, name a section by its number, have a topic of their own, or say nothing."""
    ship(spark)
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    paragraphs = O.heading_paths(X.document_paragraphs(_documents(spark, sf)))
    k = F.col("s_suppkey") % 4
    none = F.array().cast("array<string>")
    own = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    side = own.select(
        F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("doc"), F.when(k == 0, F.array(F.concat(F.lit("quite all ABOUT "), "n_name", F.lit(" and more")), F.concat(F.lit("All About "), "n_name", F.lit(" & more")))).otherwise(none).alias("quotes"),
        F.when(k == 1, F.array(F.concat(F.lit("see "), F.col("n_nationkey").cast("string")))).when(k == 2, F.array(F.lit("segment 7000"), F.lit("Own topic"))).when(k == 3, F.array(F.lit("chunk"), F.lit("part 7000"))).otherwise(none).alias("topics"), none.alias("locators"),
    )
    return O.evidence_paths(side, paragraphs).select("id", F.array_join("path", " / ").alias("path"), "how")


@query(f"""WITH {GRAPH}, e2 AS (SELECT src AS id, dst AS o FROM edges UNION SELECT dst, src FROM edges), d AS (SELECT id, ord FROM nodes WHERE type = 'slab')
SELECT d.id, (SELECT count(DISTINCT o) FROM e2 WHERE e2.id = d.id AND o <> d.id AND o IN (SELECT id FROM nodes)) AS neighbours, (SELECT count(DISTINCT src) FROM edges WHERE dst = d.id) AS cascade, d.ord % 3 <> 0 OR d.ord % 2 = 0 AS facts_ok, CASE WHEN d.ord % 5 = 0 THEN 2 ELSE 0 END AS missing FROM d""")
def joi27_preview(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    d = n.where("type = 'slab'")
    facts = d.where("ord % 3 = 0").select("id", F.explode(F.when(F.col("ord") % 2 == 0, F.array(F.lit("CONFIRMED"))).otherwise(F.array(F.lit("CONFIRMED"), F.lit("UNRESOLVABLE")))).alias("outcome"))
    refs = d.where("ord % 5 = 0").select("id", F.explode(F.array(F.lit("no1"), F.lit("no2"), F.lit("c1"))).alias("ref"))
    return L.commit_preview(d, n, edges(spark, sf), facts, refs)


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


@query(f"SELECT item_id, word, CAST(1 AS DOUBLE) AS weight FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) WHERE NOT list_contains({_STOP}, word) UNION ALL SELECT -1, w, CAST({T.EXPANSION_WEIGHT} AS DOUBLE) FROM (VALUES ('saltwater'), ('saline'), ('salinity'), ('freshwater')) v(w) UNION ALL SELECT -1, 'salt', 1")
def sca02_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Words of items without stop words, and the terms of a query that has expansions."""
    words = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    own = words.where(~F.col("word").isin(*T.STOPWORDS)).select("item_id", "word", F.lit(1.0).alias("weight"))
    terms = spark.createDataFrame([(-1, w, x) for w, x in T.query_terms(["the", "salt", "of"]).items()], "item_id int, word string, weight double")
    return own.unionByName(terms.withColumn("item_id", F.col("item_id").cast(own.schema["item_id"].dataType)))


@query("SELECT p_partkey, true AS same, true AS unit FROM part")
def udf01_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of names: equal ones for equal texts in other cases, at unit length, or zero where the signs of two words cancel."""
    ship(spark)
    p = M.embedded(M.embedded(table(spark, sf, "part").select("p_partkey", "p_name", F.upper("p_name").alias("u")), "p_name", name="a"), "u", name="b")
    return p.select("p_partkey", (F.col("a") == F.col("b")).alias("same"), ((F.abs(V.norm(F.col("a")) - 1) < 1e-4) | (V.norm(F.col("a")) == 0)).alias("unit"))


@query("SELECT conv_id AS key, 'neural gravity' AS phrase, CAST(0.5 AS DOUBLE) AS confidence FROM (SELECT DISTINCT conv_id FROM conversations)")
def udf04_explicit(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals of the last messages of each chat by a model that always answers the same: headings go."""
    ship(spark)
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("chat"), "turn", "role", "text")
    answer = {"proposals": [{"type": "anchor", "canonical_phrase": "Ends and Means"}, {"type": "anchor", "canonical_phrase": "neural gravity"}]}
    return N.explicit(m, lambda _: answer).select("key", "phrase", "confidence")


def _halves(prompt: str) -> dict:
    text = prompt.split("DOCUMENT:\n", 1)[1]
    half = len(text) // 2
    return {"sections": [{"label": "first", "starts_with": text[:20]}, {"label": "lost", "starts_with": "\u0000"}, {"label": "second", "starts_with": text[half : half + 20]}]}


def _short(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("length(text) BETWEEN 400 AND 1500").where(~F.contains("text", F.lit("\r")))
    half = F.expr("length(text) div 2")
    mark = F.substring("text", half + 1, F.lit(20))
    return d.where((F.substring("text", 1, 20) != mark) & (F.instr(F.expr("substring(text, 2)"), mark) == half)).select("doc_id", "text")


@query()
def udf15_marked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut in two by a model that marks their half; a mark that is nowhere is left out. The tests tile texts by worked examples."""
    ship(spark)
    mark = F.substring("text", F.expr("length(text) div 2") + 1, F.lit(20))
    return N.outlined_by_model(_short(spark, sf).where(F.trim(mark) == mark), _halves)


def _leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sections of their source, in order of their ids."""
    k = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    d = table(spark, sf, "documents").where(F.length(F.trim("text")) >= 100)
    return d.select(F.coalesce("source", F.lit("")).alias("doc_id"), k.alias("place"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")


@query("""WITH k AS (SELECT coalesce(source, '') AS doc_id, 'd' || doc_id AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE length(trim(text)) >= 100), s AS (SELECT doc_id, path, unnest([0, 1]) AS n, place FROM k) SELECT doc_id, path, n, place * 1000 + n AS position FROM s""")
def udf07_drilled(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return N.drilled(_leaves(spark, sf), _two)[0].select("doc_id", "path", "n", "position")


def _two(_: str) -> dict:
    return {"proposals": [{"type": "slab", "title": "a", "canonical_text": "x"}, {"type": "slab", "title": "b", "canonical_text": "y"}]}


@query("""WITH k AS (SELECT coalesce(source, '') AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents WHERE length(trim(text)) >= 100), s AS (SELECT doc_id, place * 1000 + unnest([0, 1]) AS id FROM k), l AS (SELECT doc_id, id AS src, lead(id) OVER (PARTITION BY doc_id ORDER BY id) AS dst FROM s) SELECT * FROM l WHERE dst IS NOT NULL""")
def udf06_narrative(spark: SparkSession, sf: str) -> DataFrame:
    """The spine of all slabs that the leaves of each source give."""
    ship(spark)
    return N.drilled(_leaves(spark, sf), _two)[1]


@query("SELECT n_regionkey AS doc_id, 'R / ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' / ' || k ELSE '' END AS path FROM nation, (VALUES (1), (2)) v(k) WHERE n_nationkey % 2 = 0 OR k = 1")
def udf08_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of papers: nations below their region, the dense ones cut into two parts."""
    ship(spark)
    n = table(spark, sf, "nation")
    long_ = F.concat(F.repeat(F.lit("word "), F.lit(300)), F.lit("\n\n"), F.repeat(F.lit("more "), F.lit(300)))
    own = n.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("idx"), F.concat(F.lit("R / "), "n_name").alias("path"), F.when(F.col("n_nationkey") % 2 == 0, long_).otherwise("short text").alias("text"))
    tops = n.select(F.col("n_regionkey").alias("doc_id"), (F.col("n_regionkey") + 100).alias("idx"), F.lit("R").alias("path"), F.lit("top").alias("text")).distinct()
    return N.leaves(own.unionByName(tops), 2000).select("doc_id", "path")


@query("SELECT 'mined_anchor_' || substr(sha1('word'), 1, 10) || '_v1' AS id, 'Word' AS phrase")
def udf14_remined(spark: SparkSession, sf: str) -> DataFrame:
    """A fresh corpus of all documents by a model that always answers the same phrase."""
    ship(spark)
    answer = {"proposals": [{"type": "anchor", "canonical_phrase": "Word"}]}
    return N.remined(table(spark, sf, "documents").select("doc_id", "text"), lambda _: answer)["anchors"].select("id", "phrase")


@query("SELECT user_id, count(*) AS drafts FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def str08_after_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts of the sessions whose stream has ended, made by a second stream in two calls, each event once."""
    base = _folder(spark)
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    schema = e.schema

    def handle(batch: DataFrame, _: int) -> None:
        batch.where("event_type = 'purchase'").select("user_id", "event_id").write.mode("append").parquet(f"{base}/drafts")

    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        e.where(part).write.mode("append").parquet(f"{base}/in")
        if not Z.after_completion(spark.readStream.schema(schema).parquet(f"{base}/in"), handle, f"{base}/check"):
            raise RuntimeError("the stream did not end in time")
    return spark.read.schema("user_id long, event_id long").parquet(f"{base}/drafts").groupBy("user_id").agg(F.count("*").alias("drafts"))


@query("""WITH p AS (SELECT user_id AS job, event_type AS phase, min(event_id) AS began, max(event_id % 10) AS done FROM events GROUP BY ALL)
SELECT job, phase, began, lead(began) OVER (PARTITION BY job ORDER BY began, phase) AS ended, done, lead(began) OVER (PARTITION BY job ORDER BY began, phase) IS NULL AS current FROM p""")
def str09_phases(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), F.col("event_type").alias("phase"), (F.col("event_id") % 10).alias("done"), F.lit(10).alias("total"))
    return Z.phase_history(e).drop("total")
