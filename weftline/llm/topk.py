"""Exact top-k inner-product search with KD-trees per shard.

Shards are the lower part of one tree: median splits of the widest dimension, fitted on a bounded sample,
deal all vectors to cells, and a cell beyond the size of a shard is cut on. Each shard has a tight box and its
own KD-tree: median splits down to small leaves, with tight boxes again. A query walks a tree best first by
the greatest inner product a box allows, and stops where that is below its kth score. First each query
searches the shard whose box allows most; the kth of those scores goes with it to the other shards, and only
to those whose box allows as much.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import Scratch, ship

#: Vectors in a shard and in a leaf at most, components in a shard at most, queries in a block.
SHARD, LEAF, SHARD_COMPONENTS, BLOCK = 8192, 32, 1 << 19, 256
#: Components of the sample on which the upper splits are fitted, and of the boxes that are broadcast at once.
SAMPLE_COMPONENTS, BOX_COMPONENTS = 1 << 22, 1 << 22
SCALE = 1024
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class KdTree:
    """Nodes in arrays; a node's rows are order[start:stop]. Splits halve the rows, so the depth is logarithmic."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.floats = points, points.astype(np.float64)
        self.widest = float(np.abs(self.floats).max()) if points.size else 0.0
        self.order = np.arange(len(points))
        self.low, self.high, self.spans, self.children = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            start, stop, parent = todo.pop()
            node = len(self.spans)
            own = points[self.order[start:stop]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            self.low.append(lo)
            self.high.append(hi)
            self.spans.append((start, stop))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            spread = hi.astype(np.float64) - lo
            if stop - start <= leaf or not len(spread) or spread.max() == 0:
                continue
            mid = (stop - start) // 2
            part = np.argpartition(own[:, spread.argmax()], mid)
            self.order[start:stop] = self.order[start:stop][part]
            todo += [(start, start + mid, node), (start + mid, stop, node)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No less than the greatest inner product of each query with a point of each node's box."""
        return box_bounds(queries, self.low, self.high)

    def scores(self, rows: np.ndarray, query: np.ndarray, greatest: float) -> np.ndarray:
        """Inner products as whole numbers; one beyond a long is the nearest long. None exceeds ``greatest``.

        Floating point is exact below 2**53 and a long below 2**63; beyond that Python's numbers are.
        """
        if greatest < 1 << 53:
            return self.floats[rows] @ query
        points = self.points[rows]
        if greatest < 1 << 62:
            return points @ query
        whole = (sum(a * b for a, b in zip(p, query.tolist(), strict=True)) for p in points.tolist())
        return np.array([min(max(s, _LEAST), _MOST) for s in whole], dtype=np.int64)

    def search(self, query: np.ndarray, bound: np.ndarray, ids: np.ndarray, own: int, k: int, kth: int | None) -> list[tuple[int, int]]:
        """Up to k (score, id) of at least ``kth``, best first; ``own`` is left out."""
        least = -float("inf") if kth is None else kth
        best: list[tuple[int, int]] = []  # a heap whose root is the worst: lowest score, then greatest id
        heap = [(-bound[0], 0)]
        greatest = float(np.abs(query.astype(np.float64)).sum()) * self.widest
        if greatest < 1 << 53:
            query = query.astype(np.float64)
        while heap:
            upper, node = heapq.heappop(heap)
            if -upper < least:
                break
            if self.children[node]:
                for c in self.children[node]:
                    if bound[c] >= least:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            start, stop = self.spans[node]
            rows = self.order[start:stop]
            score = self.scores(rows, query, greatest)
            near = np.flatnonzero(score >= least)
            for s, i in zip(map(int, score[near].tolist()), ids[rows[near]].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    least = max(least, best[0][0])
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Greatest inner products of queries with boxes in floating point, made greater than any rounding of them."""
    q, lo, hi = (x.astype(np.float64) for x in (queries, low, high))
    slack = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T
    return np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T + slack * 2.0**-40 + 1


class Splits:
    """The upper part of the tree: cells by median splits of a sample's widest dimension."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []  # dimension, threshold, next nodes; a cell is -1 - its number
        self.cells = 0

        def grow(rows: np.ndarray, cells: int) -> int:
            own = sample[rows]
            spread = own.max(axis=0) - own.min(axis=0) if len(own) and own.shape[1] else np.zeros(1)
            if cells < 2 or len(rows) < 2 or spread.max() == 0:
                self.cells += 1
                return -self.cells
            d = int(spread.argmax())
            at = float(np.median(own[:, d]))
            left = own[:, d] < at
            if not left.any():  # the median is the least value: what equals it goes left
                at = float(own[own[:, d] > at, d].min())
                left = own[:, d] < at
            node = len(self.nodes)
            self.nodes.append((d, at, 0, 0))
            self.nodes[node] = (d, at, grow(rows[left], cells // 2), grow(rows[~left], cells - cells // 2))
            return node

        self.root = grow(np.arange(len(sample)), cells)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.empty(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            d, at, left, right = self.nodes[node]
            below = points[rows, d] < at
            todo += [(left, rows[below]), (right, rows[~below])]
        return out


def whole_numbers(column: str = "embedding") -> Column:
    """floor(1024 x) of each component; null for vectors that are null or hold a null or non-finite one."""
    x = F.col(column).cast("array<double>")
    # a null, NaN or infinite component has no finite difference from itself
    fit = F.forall(x, lambda v: F.coalesce((v - v) == 0, F.lit(False)))
    return F.when(fit, F.transform(x, lambda v: F.floor(v * SCALE)))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, -1) if n else values.reshape(0, 0)


def _dealt(splits: dict[int, Splits]):
    """(dim, vec_id, v) with the cell of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(0).to_numpy()
            cells = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                cells[rows] = splits[dim].place(_matrix(b.column(2).take(pa.array(rows)), len(rows)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells), b.column(1), b.column(2)], ["dim", "cell", "vec_id", "v"])

    return run


_SHARDS = "dim int, shard string, ids array<long>, points array<long>, low array<long>, high array<long>"


def _sharded(size: int):
    """Rows (dim, cell, vec_id, v) in order -> shards of at most ``size`` vectors of a cell, with their boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, points, number = None, [], [], 0

        def out() -> pa.RecordBatch:
            own = np.array(points, np.int64).reshape(len(ids), at[0])
            row = [at[0], f"{at[0]}-{at[1]}-{number}", ids, own.ravel().tolist(), own.min(axis=0).tolist(), own.max(axis=0).tolist()]
            kinds = [pa.int32(), pa.string(), *[pa.list_(pa.int64())] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["dim", "shard", "ids", "points", "low", "high"])

        for b in batches:
            for dim, cell, vec_id, v in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                most = max(1, min(size, SHARD_COMPONENTS // max(1, dim)))
                if ids and ((dim, cell) != at or len(ids) == most):
                    yield out()
                    number = number + 1 if (dim, cell) == at else 0
                    ids, points = [], []
                at = (dim, cell)
                ids.append(vec_id)
                points.append(v)
        if ids:
            yield out()

    return run


_ROUTES = "query_id long, shard string, bound double"


def _routed(home: bool):
    """Rows (ids, values, kths, homes, shards, low, high): a block of queries and a chunk of boxes -> _ROUTES.

    The first time the box that allows a query most; then all others that allow its kth score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                shards = row["shards"]
                q = np.array(row["values"], np.int64).reshape(len(row["ids"]), -1)
                low, high = (np.array(row[x], np.int64).reshape(len(shards), -1) for x in ("low", "high"))
                bound = box_bounds(q, low, high)
                if home:
                    at = bound.argmax(axis=1)
                    pairs = list(enumerate(at.tolist()))
                else:
                    least = np.array([-np.inf if x is None else float(x) for x in row["kths"]])
                    pairs = [(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(bound >= least[:, None])), strict=True) if shards[j] != row["homes"][i]]
                columns = [[row["ids"][i] for i, _ in pairs], [shards[j] for _, j in pairs], [float(bound[i, j]) for i, j in pairs]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64()), strict=True)], ["query_id", "shard", "bound"])

    return run


_KINDS = "query_id long, vec_id long, score long"


def _searched(k: int):
    """Rows of one shard, sorted: itself, then blocks of queries; streams the blocks through its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, ids = None, None, None
        for b in batches:
            for r in range(b.num_rows):
                at, kind = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                own = b.column(2)[r].values.to_numpy(zero_copy_only=False)
                values = b.column(3)[r].values.to_numpy(zero_copy_only=False).reshape(len(own), -1)
                if kind == 0:
                    shard, ids, tree = at, own, KdTree(values)
                    continue
                if at != shard:
                    raise RuntimeError(f"queries without shard {at}")
                bound = tree.bounds(values)
                kths = b.column(4)[r].as_py()
                out = [(q, v, s) for i, q in enumerate(own.tolist()) for s, v in tree.search(values[i], bound[i], ids, q, k, kths[i])]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return run


def _splits(own: DataFrame, shard: int) -> dict[int, Splits]:
    """Fits the upper splits of each length of vectors on a sample by hash, of at most SAMPLE_COMPONENTS components in all."""
    sizes = {r.dim: r["count"] for r in own.groupBy("dim").count().collect()}  # a row for each length of vectors
    share = SAMPLE_COMPONENTS // max(1, len(sizes))
    order = W.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    several = [d for d, n in sizes.items() if n > shard and d > 0]
    out = {d: Splits(np.zeros((0, d)), 1) for d in sizes}
    if several:
        part = own.where(F.col("dim").isin(several)).withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.greatest(F.lit(share) / F.col("dim"), F.lit(2)))
        found: dict[int, list] = {}
        for r in part.select("dim", "v").collect():  # bounded by SAMPLE_COMPONENTS
            found.setdefault(r.dim, []).append(r.v)
        for d, rows in found.items():
            most = max(1, min(shard, SHARD_COMPONENTS // d))
            out[d] = Splits(np.array(rows, np.float64), min(-(-sizes[d] // most), max(1, len(rows) // 8)))
    return out


def build_shards(own: DataFrame, scratch: Scratch, shard: int = SHARD) -> DataFrame:
    """_SHARDS of ``own(dim, vec_id, v)``."""
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = own.select("dim", "vec_id", "v").mapInArrow(_dealt(_splits(own, shard)), "dim int, cell long, vec_id long, v array<long>")
    return scratch.save(cells.repartition(n, "dim", "cell").sortWithinPartitions("dim", "cell", "vec_id").mapInArrow(_sharded(shard), _SHARDS))


def routes(asked: DataFrame, shards: DataFrame, scratch: Scratch, home: bool) -> DataFrame:
    """_ROUTES of ``asked(dim, vec_id, v, kth, home)``: their home shards, or all the other shards that they must search.

    Boxes are broadcast in chunks of a bounded size, and each chunk meets all blocks of queries.
    """
    number = F.row_number().over(W.partitionBy("dim").orderBy("shard"))  # a row for each shard
    per_chunk = F.greatest(F.lit(BOX_COMPONENTS) / F.greatest(F.col("dim"), F.lit(1)), F.lit(1)).cast("int")
    boxes = shards.select("dim", "shard", "low", "high").withColumn("chunk", F.floor((number - 1) / per_chunk).cast("int"))
    chunks = scratch.save(boxes.groupBy("dim", "chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "low", "high"))).alias("b")))
    blocks = asked.withColumn("block", F.floor((F.row_number().over(W.partitionBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(1024))).orderBy("vec_id")) - 1) / BLOCK).cast("int"))
    blocks = blocks.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(1024)).alias("deal"), "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v", "kth", "home"))).alias("q"))
    blocks = scratch.save(blocks)
    out = None
    for c in range((chunks.agg(F.max("chunk")).first()[0] or 0) + 1):
        both = blocks.join(F.broadcast(chunks.where(F.col("chunk") == c)), "dim")
        rows = both.select(F.col("q.vec_id").alias("ids"), F.flatten("q.v").alias("values"), F.col("q.kth").alias("kths"), F.col("q.home").alias("homes"), F.col("b.shard").alias("shards"), F.flatten("b.low").alias("low"), F.flatten("b.high").alias("high"))
        part = rows.mapInArrow(_routed(home), _ROUTES)
        out = part if out is None else out.unionByName(part)
    if home:
        out = out.groupBy("query_id").agg(F.max(F.struct("bound", "shard")).alias("m")).select("query_id", "m.shard", "m.bound")
    return out


def _found(asked: DataFrame, pairs: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of queries in the shards to which ``pairs(query_id, shard)`` send them."""
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor((F.row_number().over(W.partitionBy("shard").orderBy("query_id")) - 1) / BLOCK).cast("int")
    rows = pairs.withColumn("block", block).join(asked.select(F.col("vec_id").alias("query_id"), "v", "kth"), "query_id")
    rows = rows.groupBy("shard", "block").agg(F.sort_array(F.collect_list(F.struct("query_id", "v", "kth"))).alias("q"))
    queries = rows.select("shard", F.lit(1).alias("kind"), F.col("q.query_id").alias("ids"), F.flatten("q.v").alias("values"), F.col("q.kth").alias("kths"))
    used = shards.join(pairs.select("shard").distinct(), "shard", "left_semi")
    own = used.select("shard", F.lit(0).alias("kind"), "ids", F.col("points").alias("values"), F.lit(None).cast("array<long>").alias("kths"))
    # by a hash of the column: by the column itself, the exchange above a union whose parts are dealt by it can be left out, with the parts apart
    return own.unionByName(queries).repartition(n, F.xxhash64("shard")).sortWithinPartitions("shard", "kind").mapInArrow(_searched(k), _KINDS)


def top_k(vectors: DataFrame, queries: Column, k: int = 10, column: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest integer inner products of each query row.

    ``queries`` says which rows of ``vectors(vec_id, <column>)`` are queries; candidates are all rows
    with another vec_id. Ties go to the smaller vec_id; fewer candidates give fewer ranks. Vectors
    that are null, hold a null or non-finite component, or have a null vec_id take no part, and
    only vectors of one length are compared. Of rows that repeat a vec_id the least vector counts. Products are
    exact; one beyond a long counts as the nearest long. An empty table gives no rows.
    """
    ship(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(column).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    own = own.where("v is not null and vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("v", "q")).alias("r")).select("vec_id", "r.v", "r.q")
    own = scratch.save(own.withColumn("dim", F.size("v")))
    shards = build_shards(own, scratch, shard)
    asked = own.where("q").select("dim", "vec_id", "v", F.lit(None).cast("long").alias("kth"), F.lit(None).cast("string").alias("home"))
    homes = scratch.save(routes(asked, shards, scratch, True))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = scratch.save(_found(asked, homes.select("query_id", "shard"), shards, k))
    kths = ranked(first).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    ready = scratch.save(asked.drop("kth", "home").join(homes.select(F.col("query_id").alias("vec_id"), F.col("shard").alias("home")), "vec_id", "left").join(kths, "vec_id", "left"))
    more = _found(ready, routes(ready, shards, scratch, False).select("query_id", "shard"), shards, k)
    return ranked(first.unionByName(more)).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH own AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM own q JOIN own c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
