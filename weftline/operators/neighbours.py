"""The nearest vectors of a block by cosine, all of them against all, as products of matrices.

Both sides of a block are dealt to tiles of bounded size, and every tile of queries meets every tile of the corpus
in one task. The product of two tiles finds the candidates, with a margin; those are taken again as sums in
order, as ``vectors.cosine`` takes them, so that equal vectors tie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weftline.operators.rank import top_per_group
from weftline.session import ship

#: Rows of a tile on each side, about; queries of a product; pairs that are taken again at once; margin of a product.
TILE, STRIP, PAIRS, MARGIN = 4096, 256, 1 << 16, 1e-9


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _copies(rows: np.ndarray) -> np.ndarray:
    """A number for each row, equal for equal rows."""
    if not rows.shape[1]:
        return np.zeros(len(rows), np.int64)
    return np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()


def _places(groups: np.ndarray) -> np.ndarray:
    """Place of each element in its run of equal ones."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def _similarities(v: np.ndarray, norms: np.ndarray, copy: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, sums taken in order; pairs of the same two vectors are taken once."""
    _, first, where = np.unique(copy[a] * np.int64(len(v)) + copy[b], return_index=True, return_inverse=True)
    a, b = a[first], b[first]
    dots = np.concatenate([_dot(v[a[i : i + PAIRS]], v[b[i : i + PAIRS]]) for i in range(0, max(1, len(a)), PAIRS)])
    n = norms[a] * norms[b]
    return np.where(n == 0, 0.0, dots / np.where(n == 0, 1.0, n))[where.ravel()]


def _tile(k: int, least: float, strict: bool, others: bool, bounded: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        ids, lists = table["id"].combine_chunks(), table["v"].combine_chunks()
        rank = lambda c: pc.rank(c, tiebreaker="dense").to_numpy().astype(np.int64)
        n, at, v = rank(ids), rank(table["at"].combine_chunks()), np.asarray(lists.flatten(), np.float64).reshape(len(ids), -1)
        side = table["asks"].to_numpy(zero_copy_only=False)
        q, c = np.flatnonzero(side), np.flatnonzero(~side)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        with np.errstate(all="ignore"):
            norms, copy = np.sqrt(_dot(v, v)), _copies(v)
            if not bounded:  # of equal vectors no more than the first k, and one for a query that is among them
                c = c[np.lexsort((n[c], copy[c]))]
                c = c[_places(copy[c]) <= k] if len(c) else c
            unit = v / np.where(norms == 0, 1.0, norms)[:, None]
            right = np.ascontiguousarray(unit[c].T)
            for start in range(0, len(q) if len(c) else 0, STRIP):
                own = q[start : start + STRIP]
                near = unit[own] @ right
                near[np.isnan(near)] = np.inf
                if others:
                    near[n[own][:, None] == n[c]] = -np.inf
                if bounded:
                    near[at[own][:, None] > at[c]] = -np.inf
                kth = near.max(axis=1) if k == 1 else np.partition(near, len(c) - min(k, len(c)), axis=1)[:, len(c) - min(k, len(c))]
                i, j = np.nonzero(near >= np.maximum(np.maximum(kth, least) - MARGIN, -np.finfo(float).max)[:, None])
                if not len(i):
                    continue
                a, b = own[i], c[j]
                s = _similarities(v, norms, copy, a, b)
                ok = ~(s <= least) if strict else ~(s < least)  # what is no number counts as the greatest
                i, a, b, s = i[ok], a[ok], b[ok], s[ok]
                order = np.lexsort((n[b], np.where(np.isnan(s), -np.inf, -s), i))
                order = order[_places(i[order]) < k] if len(order) else order
                found.append((a[order], b[order], s[order]))
        a, b, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.array([], np.int64), np.array([], np.int64), np.array([]))
        return pa.table({"query_id": ids.take(pa.array(a)), "id": ids.take(pa.array(b)), "similarity": pa.array(s)})

    return run


def nearest_in_blocks(queries: DataFrame, corpus: DataFrame, k: int, least: float, strict: bool = False, others: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of ``corpus(id, block, v)`` to each of ``queries(id, block, v)`` of the same block.

    Similarities are ``least`` or more, above it if ``strict``; ties go to the smaller id. ``others`` leaves a query's own id out. With a
    column ``at`` on both sides a query meets rows whose ``at`` is no less than its own. Ids of both sides are of one type. Vectors
    that are null or hold null take no part, those of no length are at 0.
    """
    spark = queries.sparkSession
    ship(spark)
    bounded = "at" in queries.columns

    def side(df: DataFrame) -> DataFrame:
        own = df.select("id", "block", F.size("v").alias("dim"), F.col("at") if bounded else F.lit(0).alias("at"), "v")
        return own.where("id is not null AND block is not null AND at is not null AND v is not null AND NOT exists(v, x -> x is null)")

    q, c = side(queries), side(corpus)
    tiles = lambda df, name: df.groupBy("block", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    sizes = tiles(q, "nq").join(tiles(c, "nc"), ["block", "dim"])
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["block", "dim", "qt", "ct", "asks", "id", "at", "v"]
    left = q.join(sizes, ["block", "dim"]).withColumn("qt", dealt("nq")).withColumn("ct", all_("nc")).withColumn("asks", F.lit(True))
    right = c.join(sizes, ["block", "dim"]).withColumn("ct", dealt("nc")).withColumn("qt", all_("nq")).withColumn("asks", F.lit(False))
    kind = q.schema["id"].dataType
    schema = StructType([StructField("query_id", kind), StructField("id", kind), StructField("similarity", DoubleType())])
    pairs = left.select(columns).unionByName(right.select(columns)).groupBy("block", "dim", "qt", "ct").applyInArrow(_tile(k, least, strict, others, bounded), schema)
    return top_per_group(pairs, ["query_id"], [F.desc("similarity"), F.col("id")], k)


def _best(table: pa.Table) -> pa.Table:
    lists, side = table["v"].combine_chunks(), table["asks"].to_numpy(zero_copy_only=False)
    v, bar = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1), table["bar"].to_numpy()
    q, c = np.flatnonzero(side), np.flatnonzero(~side)
    handle, phrase = (np.zeros(len(lists), np.int64) for _ in range(2))
    for out, name in ((handle, "id"), (phrase, "phrase")):
        out[c] = pc.rank(table[name].combine_chunks().take(pa.array(c)), tiebreaker="dense").to_numpy().astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    with np.errstate(all="ignore"):
        norms, copy = np.sqrt(_dot(v, v)), _copies(v)
        unit = v / np.where(norms == 0, 1.0, norms)[:, None]
        strip = max(1, STRIP * TILE // max(1, len(c)))
        for start in range(0, len(q) if len(c) else 0, strip):
            near = unit[q[start : start + strip]] @ unit[c].T
            i, j = np.nonzero(~(near < bar[c] - MARGIN))
            if not len(i):
                continue
            a, b = q[start + i], c[j]
            s = _similarities(v, norms, copy, a, b)
            ok = ~(s < bar[b])
            a, b, s = a[ok], b[ok], s[ok]
            order = np.lexsort((-phrase[b], np.where(np.isnan(s), -np.inf, -s), handle[b], a))
            if len(order):
                pair = a[order] * (len(v) + 1) + handle[b[order]]
                order = order[np.r_[True, pair[1:] != pair[:-1]]]
            found.append((a[order], b[order], s[order]))
    a, b, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.array([], np.int64), np.array([], np.int64), np.array([]))
    take = lambda name, rows: table[name].combine_chunks().take(pa.array(rows))
    return pa.table({"text_id": take("text_id", a), "id": take("id", b), "phrase": take("phrase", b), "similarity": pa.array(s)})


def best_in_groups(probes: DataFrame, phrases: DataFrame, tile: int = TILE) -> DataFrame:
    """(text_id, id, phrase, similarity): the best of ``phrases(id, phrase, v, bar)`` of each id for each of ``probes(text_id, v)``, at their ``bar`` or more.

    Of equal ones the last phrase. A null bar lets all through. Both sides are read twice.
    """
    ship(probes.sparkSession)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    q = probes.select(F.size("v").alias("dim"), F.lit(True).alias("asks"), "text_id", none(phrases, "id"), none(phrases, "phrase"), F.lit(0.0).alias("bar"), "v")
    c = phrases.select(F.size("v").alias("dim"), F.lit(False).alias("asks"), none(probes, "text_id"), "id", "phrase", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"), "v")
    q, c = (df.where("v is not null AND NOT exists(v, x -> x is null)") for df in (q, c))
    tiles = lambda df, name: df.groupBy("dim").agg(F.ceil(F.count("*") / tile).cast("int").alias(name))
    sizes = tiles(q, "nq").join(tiles(c, "nc"), "dim")
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["dim", "qt", "ct", "asks", "text_id", "id", "phrase", "bar", "v"]
    left = q.join(sizes, "dim").withColumn("qt", dealt("nq", "text_id")).withColumn("ct", all_("nc")).select(columns)
    right = c.join(sizes, "dim").withColumn("ct", dealt("nc", "id", "phrase")).withColumn("qt", all_("nq")).select(columns)
    schema = StructType([StructField(n, df.schema[n].dataType) for n, df in (("text_id", probes), ("id", phrases), ("phrase", phrases))] + [StructField("similarity", DoubleType())])
    pairs = left.unionByName(right).groupBy("dim", "qt", "ct").applyInArrow(_best, schema)
    return pairs.groupBy("text_id", "id").agg(F.max(F.struct("similarity", "phrase")).alias("m")).select("text_id", "id", "m.phrase", "m.similarity")
