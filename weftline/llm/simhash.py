"""Near-duplicate documents by SimHash with deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most three
bits, one of the segments differs in at most one bit, so the two share a variant of that segment in
which one bit is a wildcard. Fingerprints are indexed by their 64 one-wildcard variants, joined by
equality of the variant (a sorted exchange on it) and verified by Hamming distance; from each
variant's bucket only a spanning forest of the verified links leaves, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import connected_components
from weftline.llm.memory import released
from weftline.session import Scratch, ship

SEED = 42
#: Most fingerprints with one exact segment value that are compared inside a bucket; others go by balls.
BUCKET_LIMIT = 8192


def simhash(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of one text; null and wordless texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    shingles = words if width == 1 else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_key, fp): xxhash64 and the signed 64-bit fingerprint of every text, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), width) for t in b.column(2)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "fp"])

    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(released(run), "doc_id long, text_key long, fp long")


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within one bucket, as pairs of positions."""
    out, rest = [], np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]) <= distance
            if near.any():
                for y in rest[near].tolist():
                    out.append((x, y))
                    queue.append(y)
                rest = rest[~near]
    return out


_WILD = np.array([0xFFFFFFFF & ~(1 << i) for i in range(32)], dtype=np.uint64)
_TAG = (np.arange(32, dtype=np.uint64) << np.uint64(32)).astype(np.uint64)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, hot0, hot1) -> (key, fp): 32 one-wildcard variants of each segment that is not hot."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        hot = [b.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (1, 2)]
        for i in range(0, len(fp), 4096):
            for segment in (0, 1):
                own = fp[i : i + 4096][~hot[segment][i : i + 4096]]
                value = (own >> np.uint64(32)) if segment else (own & np.uint64(0xFFFFFFFF))
                key = (value[:, None] & _WILD[None, :]) | _TAG[None, :] | np.uint64(segment << 37)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(own, 32).view(np.int64))], ["key", "fp"]
                )


def _bucket_links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
            a, b = [fps[two]], [fps[two + 1]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if pairs := forest(own := fps[s : s + n], distance):
                    p = np.array(pairs)
                    a.append(own[p[:, 0]])
                    b.append(own[p[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            if whole:
                yield linked(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield linked(keys, fps)

    return run


def _segment(segment: int) -> Column:
    return F.shiftrightunsigned("fp", 32) if segment else F.col("fp").bitwiseAND(0xFFFFFFFF)


def _ball_links(near: DataFrame) -> DataFrame:
    """Exact links at up to three bits, linear in the rows whatever the bucket's size.

    Fingerprints at up to one bit from a point are its centres, those at up to two bits its members;
    a centre and a member differ by at most three bits, and any two linked fingerprints meet at
    such a point, so linking all members of a point to one of its centres loses no link.
    """
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    one = F.array(F.lit(0), *[F.lit(b) for b in bits]).cast("array<long>")
    point = lambda flips: F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))
    centres = near.select("fp", F.explode(point(one)).alias("key")).groupBy("key").agg(F.min("fp").alias("a"))
    two = F.array_distinct(F.flatten(F.transform(one, lambda x: F.transform(one, lambda y: x.bitwiseXOR(y)))))
    members = near.select("fp", F.explode(point(two)).alias("key"))
    return members.join(centres, "key").where("fp <> a").select(F.col("a"), F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, scratch: Scratch, distance: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): links of distinct fingerprints ``fps(fp)`` that connect every pair within ``distance`` bits.

    A segment value that more than ``bucket_limit`` fingerprints share is left out of the index;
    they and the fingerprints whose segment is one bit away are linked by balls instead. So a
    bucket holds at most twice the limit.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments serve distances up to 3")
    segs = fps.select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _segment(s).alias("value")) for s in (0, 1)])).alias("s")
    ).select("s.*")
    hot = scratch.save(segs.groupBy("segment", "value").count().where(F.col("count") > bucket_limit).select("segment", "value"))
    if hot.isEmpty():
        marked = fps.select("fp", F.lit(False).alias("hot0"), F.lit(False).alias("hot1"))
        rest = None
    else:
        flips = F.array(*[F.lit(x) for x in [0] + [1 << i for i in range(32)]]).cast("array<long>")
        around = hot.select("segment", F.explode(F.transform(flips, lambda x: F.col("value").bitwiseXOR(x))).alias("value")).distinct()
        marked, near = fps, []
        for s in (0, 1):
            own = hot.where(F.col("segment") == s).select(F.col("value").alias(f"v{s}"), F.lit(True).alias(f"hot{s}"))
            marked = marked.withColumn(f"v{s}", _segment(s)).join(own, f"v{s}", "left").withColumn(f"hot{s}", F.coalesce(f"hot{s}", F.lit(False)))
            wide = around.where(F.col("segment") == s).select(F.col("value").alias("v"))
            near.append(fps.withColumn("v", _segment(s)).join(wide, "v", "left_semi").select("fp"))
        marked = marked.select("fp", "hot0", "hot1")
        rest = _ball_links(near[0].unionByName(near[1]).distinct())
        if distance < 3:
            rest = rest.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    ship(fps.sparkSession)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        marked.mapInArrow(_variants, "key long, fp long")
        .repartition(n, "key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(_bucket_links(distance), "a long, b long")
    )
    return found if rest is None else found.unionByName(rest)


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    component_id is the smallest doc_id among the documents reachable by links of at most
    ``distance`` differing bits. Null, empty and wordless texts have fingerprint zero and are linked
    like any other. Repeated rows stay, equal fingerprints are one node. A null doc_id is ignored in
    the minimum; an empty table gives no rows. Columns besides doc_id and text are ignored.
    """
    return _with_components(docs, distance, width, bucket_limit).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_components(docs: DataFrame, distance: int, width: int, bucket_limit: int) -> DataFrame:
    """(doc_id, text_key, fp, component_id) for every document."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.save(fingerprints(docs, width))
    nodes = scratch.save(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = connected_components(links(nodes.select("fp"), scratch, distance, bucket_limit), scratch)
    comp = scratch.save(comp)
    rooted = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "text_key", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """``docs`` without the documents whose component holds one with a smaller doc_id.

    All columns stay. Of rows that repeat the kept doc_id all stay; rows with a null doc_id stay. Of rows
    that share a doc_id but not the text each goes by its own component.
    """
    found = _with_components(docs, distance, width, BUCKET_LIMIT)
    gone = found.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__text")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__text"]), "left_anti")
