"""Retrieval beside the main ranking: an index of source code, and catalogues scoped to a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import vectors as V
from weftline.functions.models import Embedder, embedded, hashed_vectors

# Chunks returned, similarity from which a question is about the code, characters that are embedded, and the limits of a catalogue.
TOP_CHUNKS, CODE_FROM, EMBEDDED_CHARS = 8, 0.60, 500
CATALOGUE, CATALOGUE_LEAST, COLD_CATALOGUE = 20, 0.4, 60


def code_index(chunks: DataFrame, embedder: Embedder = hashed_vectors) -> DataFrame:
    """``chunks(path, name, start, chunk)`` with the vector of ``path::name`` and the chunk's first characters; zeros where the embedder fails."""
    text = F.concat("path", F.lit("::"), "name", F.lit("\n"), F.substring("chunk", 1, EMBEDDED_CHARS))
    return embedded(chunks.withColumn("__text", text), "__text", embedder, "v").drop("__text")


def _ranked(probes: DataFrame, rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k nearest rows of each of a caller's few ``probes(query_id, q)``."""
    near = rows.crossJoin(F.broadcast(probes)).withColumn("score", V.cosine(F.col("v"), F.col("q")))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), *order)
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("v", "q")


def code_context(index: DataFrame, probes: DataFrame, k: int = TOP_CHUNKS) -> DataFrame:
    """(query_id, rank, path, name, start, score, mode): the k chunks nearest to each probe, and whether its best makes it CODE or DOMAIN."""
    best = _ranked(probes, index.select("path", "name", "start", "v"), [F.col("path"), F.col("start")], k).withColumn("score", F.round("score", 4))
    top = F.max("score").over(W.partitionBy("query_id"))
    return best.select("query_id", "rank", "path", "name", "start", "score", F.when(top >= CODE_FROM, "CODE").otherwise("DOMAIN").alias("mode"))


def scoped_catalogue(nodes: DataFrame, vectors: DataFrame, probes: DataFrame, k: int = CATALOGUE, least: float = CATALOGUE_LEAST) -> DataFrame:
    """(query_id, type, catalogue): labels of the k nodes of a type nearest to each probe, at ``least`` or more.

    ``nodes(id, type, label, ord)``, ``vectors(id, v)``. A type without any such node gives its first sixty labels instead.
    """
    scored = nodes.select("id", "type", "label").join(vectors, "id").crossJoin(F.broadcast(probes)).withColumn("score", V.cosine(F.col("v"), F.col("q")))
    per_node = scored.groupBy("query_id", "type", "id").agg(F.max("score").alias("score"), F.first("label").alias("label")).where(F.col("score") >= least)
    best = W.partitionBy("query_id", "type").orderBy(F.desc("score"), "id")
    warm = per_node.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    cold = nodes.withColumn("rank", F.row_number().over(W.partitionBy("type").orderBy("ord", "id"))).where(F.col("rank") <= COLD_CATALOGUE).crossJoin(F.broadcast(probes.select("query_id")))
    cold = cold.join(warm.select("query_id", "type").distinct(), ["query_id", "type"], "left_anti")
    both = warm.select("query_id", "type", "rank", "label").unionByName(cold.select("query_id", "type", "rank", "label")).where("label <> ''")
    listed = F.array_sort(F.collect_list(F.struct("rank", "label")))
    return both.groupBy("query_id", "type").agg(F.array_join(F.transform(listed, lambda x: x["label"]), ", ").alias("catalogue"))
