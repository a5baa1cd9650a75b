"""Session artefacts, chats, logs and caches as files: JSON a row, appended or replaced as a whole.

Tables live in folders of JSON lines or of one JSON file a row. Replacing writes a new version beside the old one and then
appends its number to a control table, so that a reader sees the old or the new version and never a part of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Endings of files that are no drafts, topics of the event log, and prefixes of ids by type.
NOT_DRAFTS = (r"_raw\.json$", r"\.enriched\.json$")
TOPICS = ("match", "gate", "frame", "proposal", "commit", "drift", "verification", "push", "synthesis")
PREFIXES = {"anchor": ("draft_anchor_", "mined_anchor_"), "slab": ("draft_slab_", "mined_slab_"), "bundle": ("draft_bundle_", "mined_bundle_")}
SYSTEM, TITLE_CHARS = "system", 80


def _missing(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e)


def json_files(spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*.json") -> DataFrame:
    """Rows of the JSON files of a folder with ``file`` and ``modified``; files that are no JSON are left out, a missing folder has no rows."""
    try:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(path)
        rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    except Exception as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema).select("*", F.lit("").alias("file"), F.current_timestamp().alias("modified"))
    return rows


def draft_files(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Draft packets of a session or of all: raw sidecars and enriched copies are left out, and rows without an id."""
    rows = json_files(spark, path, schema).where("id is not null")
    for ending in NOT_DRAFTS:
        rows = rows.where(~F.col("file").rlike(ending))
    return rows


def drafts_of_chat(drafts: DataFrame, chat: str) -> DataFrame:
    """Drafts of a chat over all sessions, of each id the newest file's."""
    own = drafts.where(F.col("chat_id") == chat)
    n = F.row_number().over(W.partitionBy("id").orderBy(F.desc("modified"), F.desc("file")))
    return own.withColumn("__n", n).where("__n = 1").drop("__n")


def edges_of_chat(edges: DataFrame, chat: str) -> DataFrame:
    """(session, …) rows of proposed edges whose source is a chat, over all sessions."""
    return edges.where(F.col("source_chat_id") == chat)


def chats(rows: DataFrame) -> DataFrame:
    """Chat files, the newest first; ``place`` is their order."""
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc("modified"), "file")) - 1)  # a row for each chat file


def messages_of(rows: DataFrame, chat: str) -> DataFrame:
    """(turn, role, content) of a chat from ``rows(id, messages)``; no rows for an unknown one."""
    return rows.where(F.col("id") == chat).select(F.posexplode("messages").alias("turn", "m")).select("turn", "m.role", "m.content")


def session_durations(spark: SparkSession, path: str) -> list[int]:
    """Turn counts of ended sessions from JSON lines; one bad line, or no file, gives none at all."""
    try:
        rows = spark.read.schema("turns int, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).cache()
        try:
            if rows.where("_bad is not null or turns is null").limit(1).count():
                return []
            return [r.turns for r in rows.select("turns").collect()]  # a number for each ended session
        finally:
            rows.unpersist()
    except Exception as e:
        if not _missing(e):
            raise
        return []


def labelled_library(rows: DataFrame) -> DataFrame:
    """Library records with a label: phrase, title, label, first 80 characters of the text, or the file's stem."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    label = F.coalesce(some(F.col("phrase")), some(F.col("title")), some(F.col("label")), some(F.substring("text", 1, TITLE_CHARS)), stem)
    return rows.withColumn("shown", label)


def slab_records(sidecars: DataFrame, slabs: DataFrame) -> DataFrame:
    """(id, path, cross, order) of raw sidecars whose slab the store holds; topics are strings or lists of parts."""
    kept = sidecars.join(slabs.select("id"), "id", "left_semi")
    path = F.coalesce(F.trim("topic"), F.array_join(F.filter(F.transform("topics", lambda t: F.trim(t)), lambda t: t != ""), " / "))
    return kept.select("id", path.alias("path"), F.coalesce("cross", F.array().cast("array<string>")).alias("cross"), F.coalesce("order", F.lit(0)).alias("order"))


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """(collection, path): the default collection, if its old place has objects, then the folders with objects, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")  # paths alone: contents are not read
    inner = files.select(F.regexp_extract("path", r"/corpora/([^/]+)/objects/[^/]+$", 1).alias("collection"), F.regexp_extract("path", r"^(.*/corpora/[^/]+)/objects/[^/]+$", 1).alias("path"))
    old = files.where(F.col("path").rlike(r"/objects/[^/]+$") & ~F.contains("path", F.lit("/corpora/"))).select(F.lit("default").alias("collection"), F.regexp_extract("path", r"^(.*)/objects/[^/]+$", 1).alias("path"))
    found = inner.where("collection <> ''").unionByName(old).groupBy("collection").agg(F.max_by("path", F.contains("path", F.lit("/corpora/"))).alias("path"))
    return found


def code_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py", ".yaml", ".yml")) -> DataFrame:
    """(path, text) of the source files under a folder, paths relative to it; bytes that are no UTF-8 are replaced."""
    glob = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.removeprefix("file:").lstrip("/").rstrip("/") + "/"
    return files.select(F.substring_index("path", base, -1).alias("path"), F.decode("content", "UTF-8").alias("text"))


def uploaded_text(files: DataFrame, cap: int = 10 << 20, chars: int = 80_000) -> DataFrame:
    """(path, text, error) of ``files(path, content)``: UTF-8, without its mark, else Latin-1; too large, PDF and DOCX files give an error."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    error = F.when(F.length("content") > cap, "too_large").when(kind.isin("pdf", "docx"), "no_reader")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", F.when(error.isNull(), F.substring(F.regexp_replace(text, "^\ufeff", ""), 1, chars)).alias("text"), error.alias("error"))


# -- sinks ----------------------------------------------------------------------------------------
def replace(rows: DataFrame, path: str) -> int:
    """Writes a new version of a table and switches readers to it; returns its number. A failed write leaves the old one."""
    spark = rows.sparkSession
    version = (current_version(spark, path) or 0) + 1
    rows.write.mode("overwrite").json(f"{path}/version={version}")
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{path}/control")
    return version


def current_version(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.schema("version int").json(f"{path}/control").agg(F.max("version")).first()[0]
    except Exception as e:
        if not _missing(e):
            raise
        return None


def current(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of the last version that was written as a whole; none before the first."""
    version = current_version(spark, path)
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).json(f"{path}/version={version}")


def log_event(spark: SparkSession, root: str, topic: str, rows: DataFrame) -> None:
    """Appends rows to one of the nine topics, stamped with the time in UTC."""
    if topic not in TOPICS:
        raise ValueError(f"no topic {topic}")
    rows.withColumns({"at": F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "topic": F.lit(topic)}).write.mode("append").partitionBy("topic").json(root)


def session_ended(spark: SparkSession, path: str, session: str, turns: int) -> bool:
    """Appends the length of a session that had a turn; returns whether it did."""
    if turns < 1:
        return False
    spark.range(1).select(F.lit(session).alias("session"), F.lit(turns).alias("turns")).write.mode("append").json(path)
    return True


def with_message(chat: DataFrame, role: str, content: str) -> DataFrame:
    """``chat(turn, role, content)`` with one more message at its end."""
    last = chat.agg(F.coalesce(F.max("turn"), F.lit(-1)).alias("last"))
    return chat.unionByName(last.select((F.col("last") + 1).cast("int").alias("turn"), F.lit(role).alias("role"), F.lit(content).alias("content")))


def latest_settings(changes: DataFrame, fields: list[str]) -> DataFrame:
    """The state of each chat from its changes ``(id, at, field…)``: of every field the last value that is not null."""
    return changes.groupBy("id").agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("at"))).alias(f) for f in fields])


def cached_labels(cache: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels of ``clusters(scope, cluster, fingerprint)`` that ``cache(scope, cluster, fingerprint, label)`` still holds, and the clusters to label anew."""
    key = ["scope", "cluster", "fingerprint"]
    return clusters.join(cache.select(*key, "label"), key), clusters.join(cache.select(*key), key, "left_anti")


def without_scope(cache: DataFrame, scope: str | None = None) -> DataFrame:
    """The cache after a scope, or all of it, was made invalid."""
    return cache.limit(0) if scope is None else cache.where(F.col("scope") != scope)


def audit_lines(rewrites: DataFrame) -> DataFrame:
    """(place, line): the markdown audit log of ``rewrites(place, id, mode, score, before, after, reasons)``."""
    block = F.array(
        F.concat(F.lit("## "), "id"),
        F.concat(F.lit("- mode: "), "mode", F.lit(" ("), F.format_number("score", 4), F.lit(")")),
        F.concat(F.lit("- changed: "), F.when(F.col("before").eqNullSafe(F.col("after")), "no").otherwise("yes")),
        F.concat(F.lit("- reasons: "), F.coalesce(F.nullif(F.array_join("reasons", "; "), F.lit("")), F.lit("none"))),
        F.lit(""),
    )
    return rewrites.select("place", F.posexplode(block).alias("n", "line")).select((F.col("place") * 5 + F.col("n")).alias("place"), "line")


def registry_from_ids(ids: DataFrame) -> DataFrame:
    """(id, type): registry rows rebuilt from ids alone, by their prefix; other ids have none."""
    kind: Column = F.lit(None).cast("string")
    for name, starts in PREFIXES.items():
        for s in starts:
            kind = F.when(F.startswith("id", F.lit(s)), name).otherwise(kind)
    return ids.select("id", kind.alias("type")).where("type is not null").distinct()


def restored(frames: DataFrame, ids: DataFrame, session: str) -> DataFrame:
    """The registry of a session: as saved in ``frames(session, id, type)``, or rebuilt from its ids if nothing was."""
    saved = frames.where(F.col("session") == session).select("id", "type")
    some = saved.limit(1).select(F.lit(True).alias("some"))
    rebuilt = registry_from_ids(ids).join(F.broadcast(some), how="left").where("some is null").select("id", "type")  # one row at most
    return saved.unionByName(rebuilt)


# -- collections and artefacts --------------------------------------------------------------------
def listed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of a file that holds one list of objects, in JSON, which is YAML too; a missing file, or one that holds no list, has none."""
    try:
        text = spark.read.text(path, wholetext=True).where(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["))
        return text.select(F.inline(F.from_json("value", F.lit(f"array<struct<{_ddl(schema)}>>"))))
    except Exception as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema)


def _ddl(schema: StructType | str) -> str:
    fields = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return ", ".join(":".join(part.strip().split(" ", 1)) for part in fields.split(","))


def loaded(rows: DataFrame, persisted: DataFrame, absorbed: DataFrame) -> DataFrame:
    """``rows(id, collection, …)`` of the collections that are persisted as active and were found, without those absorbed into another."""
    active = persisted.select("collection").distinct().join(absorbed.select("collection"), "collection", "left_anti")
    return rows.join(active, "collection", "left_semi")


def collection_place(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(collection, path, error) of asked collections: their own folder, the old place for the default one, or an error."""
    own = asked.select("collection").join(found.select("collection", "path"), "collection", "left")
    return own.select("collection", "path", F.when(F.col("path").isNull(), F.concat(F.lit("unknown collection: "), "collection")).alias("error"))


def save_artefact(rows: DataFrame, root: str, session: str, kind: str) -> int:
    """Saves a session's frame, registry, stack, packets or edges as a whole."""
    return replace(rows, f"{root}/session={session}/{kind}")


def load_artefact(spark: SparkSession, root: str, session: str, kind: str, schema: StructType | str) -> DataFrame:
    return current(spark, f"{root}/session={session}/{kind}", schema)


def health_drafts(rows: DataFrame) -> DataFrame:
    """Drafts with their label, the newest first (``place``)."""
    return labelled_library(rows).withColumn("place", F.row_number().over(W.orderBy(F.desc("modified"), "file")) - 1)  # a row for each draft file
