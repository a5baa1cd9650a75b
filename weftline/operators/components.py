"""Connected components by alternating star contraction (distributed union-find)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import Scratch, ship

#: Edges that are made stars at once.
RUN = 1 << 18


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars, each from its nodes to their smallest, a run of edges at a time."""

    def stars(u: list, v: list) -> pa.RecordBatch:
        parent: dict = {}

        def find(x):
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        for x, y in zip(u, v, strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["u", "v"])

    u: list = []
    v: list = []
    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        u.extend(b.column(0).to_pylist())
        v.extend(b.column(1).to_pylist())
        if len(u) >= RUN:
            yield stars(u, v)
            u, v = [], []
    if u:
        yield stars(u, v)


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    ``edges`` has the columns a and b of one orderable type. Self-loops and edges with a null end
    are ignored, repeated edges count once, no edges give no rows. Each round runs a large-star and
    a small-star step. The edges of a task are first made stars. Minima are combined before the shuffle
    and written, so that their join with the edges exchanges both and adaptive execution can split the
    edges of a hub, and the number of edges never grows.
    """
    ship(edges.sparkSession)
    e = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    e = scratch.save(e.mapInArrow(_forest, e.schema).distinct())
    last = _signature(e)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = scratch.save(large)
        small = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(small, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = scratch.save(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(e, low, large, small)
        e, before = nxt, last
        last = _signature(e)
        if last == before:
            break
    else:
        raise RuntimeError("components did not converge")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
