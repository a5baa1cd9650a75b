"""Corpus collections, session artefacts and control tables on Parquet and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("anchors", "slabs", "bundles", "edges", "gates", "pillars")


def last_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row of each key, the last in order."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*[o.desc() for o in order]))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def save_collection(tables: dict[str, DataFrame], root: str, collection: str, version: int) -> str:
    """Writes a collection's tables into a folder of a new version; readers switch with the control table."""
    base = f"{root}/collection={collection}/version={version}"
    for kind, df in tables.items():
        if kind != "pillars" or not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{base}/{kind}")
    return base


def publish(spark: SparkSession, root: str, collection: str, version: int, active: bool = True) -> None:
    """Appends to the control table which version of a collection holds; the default collection stays active."""
    row = spark.range(1).select(F.lit(collection).alias("collection"), F.lit(version).alias("version"), (F.lit(active) | (F.lit(collection) == "default")).alias("active"), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/control")


def active_collections(spark: SparkSession, root: str) -> DataFrame:
    """(collection, version) of the collections that are active, by the last control row of each."""
    control = spark.read.parquet(f"{root}/control")
    return last_wins(control, "collection", [F.col("at"), F.col("version")]).where("active").select("collection", "version")


def load(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    """A table of all active collections with the column collection, or None where no collection has it."""
    out = None
    for r in sorted(active_collections(spark, root).collect()):  # collections are a handful
        try:
            part = spark.read.parquet(f"{root}/collection={r.collection}/version={r.version}/{kind}").withColumn("collection", F.lit(r.collection))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merged_view(rows: DataFrame, key: str = "id") -> DataFrame:
    """Of ids in several collections, the row of the first collection by name."""
    n = F.row_number().over(W.partitionBy(key).orderBy("collection"))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def append_new(path: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Appends the rows whose keys the table does not hold, each once, and returns them."""
    fresh = rows.dropDuplicates(keys)
    try:
        fresh = fresh.join(rows.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)
    return fresh


def policy(defaults: dict, overlay: dict) -> dict:
    """Defaults with the known keys of an overlay, each cast to the default's type."""
    out = {}
    for k, v in defaults.items():
        new = overlay.get(k)
        out[k] = policy(v, new if isinstance(new, dict) else {}) if isinstance(v, dict) else v if new is None else type(v)(new)
    return out


def code_chunks(files: DataFrame, limit: int = 1500, least: int = 20) -> DataFrame:
    """(path, start, chunk) of source files ``files(path, text)``: pieces that begin at top-level definitions, cut at the limit."""
    lines = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    starts = F.sum(F.when(F.col("line").rlike(r"^(class|def|async def|- )\b"), 1).otherwise(0)).over(W.partitionBy("path").orderBy("n"))
    parts = lines.withColumn("part", starts).groupBy("path", "part").agg(F.min("n").alias("start"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return parts.select("path", F.col("start").alias("start"), F.substring(text, 1, limit).alias("chunk")).where(F.length(F.trim("chunk")) > least)


def latex_to_plain(text: Column) -> Column:
    """LaTeX without comments, environments and commands, their arguments kept."""
    out = text
    for pattern, into in (
        (r"(?m)(?<!\\)%.*$", ""),
        (r"\\(?:begin|end)\{[^}]*\}", ""),
        (r"\\(?:section|subsection|subsubsection)\*?\{([^}]*)\}", "\n$1\n"),
        (r"\\(?:cite|ref|label)\w*\{[^}]*\}", ""),
        (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^}]*)\}", "$1"),
        (r"\\[a-zA-Z]+\*?", ""),
        (r"[{}$~]", " "),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
        (r"^\s+|\s+$", ""),
    ):
        out = F.regexp_replace(out, pattern, into)
    return out
