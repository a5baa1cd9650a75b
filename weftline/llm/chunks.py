"""Substring deduplication by content-defined chunking with a gear rolling hash.

A boundary falls where the gear hash of the last 32 bytes has its low bits zero, so chunks depend
on their content alone and an insertion moves only the chunks around it. Chunks are deduplicated by
a 128-bit digest; runs of chunks that repeat form spans, and spans of at least ``min_bytes`` are
reported with the document that holds the first occurrence of their first chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.rows import field, packed, unpacked
from weftline.session import Scratch, ship

#: Least and greatest chunk in bytes; a boundary comes each 2**BITS bytes on average after the least.
LEAST, GREATEST, BITS = 16, 256, 4
#: Least span of repeated chunks in bytes: about 20 words. Chance repeats of single chunks stay below.
MIN_BYTES = 120
_WINDOW = 32


def gear_table() -> np.ndarray:
    """256 numbers of 32 bits, from the hash of each byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], dtype=np.uint32)


_GEAR = gear_table()


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """h[t] = sum of gear[raw[t-k]] << k for k below 32, by doubling the window."""
    h = _GEAR[raw]
    width = 1
    while width < _WINDOW:
        h[width:] += h[:-width] << np.uint32(width)  # the right side is evaluated first
        width *= 2
    return h


def boundaries(raw: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's bytes, the last one being its length."""
    n = len(raw)
    if not n:
        return []
    h = gear_hash(raw)
    # the top bits depend on all 32 bytes of the window
    marks = (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist()
    out, last = [], 0
    for m in marks:
        if m - last < LEAST:
            continue
        while m - last > GREATEST:
            last += GREATEST
            out.append(last)
        if m - last >= LEAST:
            out.append(m)
            last = m
    while n - last > GREATEST:
        last += GREATEST
        out.append(last)
    if n > last:
        out.append(n)
    return out


def chunk(text: str | None) -> list[bytes]:
    """The chunks of one text's UTF-8 bytes; joined they are the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ends = boundaries(np.frombuffer(raw, dtype=np.uint8))
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


_SPECIES = "digest binary, doc_id long, row_key long, begin int, finish int, first_doc long, first_key long, first_begin int, here boolean"
_NAMES = ["digest", "doc_id", "row_key", "begin", "finish", "first_doc", "first_key", "first_begin", "here"]
_PLACE = ("doc_id", "row_key", "begin")
_NULL = -(1 << 63)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk places; a digest goes to the exchange once a batch, later places in it are known repeats and name that head."""
    for whole in batches:
        ids, keys, texts = whole.column(0), whole.column(1), whole.column(2)
        start = 0
        while start < whole.num_rows:
            seen: dict[bytes, int] = {}
            met: set[tuple[int, int]] = set()
            digests, docs, rows, begins, ends, firsts = [], [], [], [], [], []
            while start < whole.num_rows and len(digests) < 150_000:
                raw = (texts[start].as_py() or "").encode("utf-8", "surrogatepass")
                doc, key = ids[start].as_py(), keys[start].as_py()
                doc = _NULL if doc is None else doc
                start += 1
                if (doc, key) in met:  # a repeated row
                    continue
                met.add((doc, key))
                stops = boundaries(np.frombuffer(raw, dtype=np.uint8))
                a = 0
                for b in stops:
                    d = xxhash.xxh3_128_digest(raw[a:b])
                    at = seen.setdefault(d, len(digests))
                    digests.append(d)
                    docs.append(doc)
                    rows.append(key)
                    begins.append(a)
                    ends.append(b)
                    firsts.append(at)
                    a = b
            first = np.array(firsts, dtype=np.int64)
            if not len(first):
                continue
            doc, row, begin = np.array(docs, np.int64), np.array(rows, np.int64), np.array(begins, np.int32)
            # the first place of a digest in the batch is the least by document, text and position
            order = np.lexsort((begin, row, doc, first))
            heads = order[np.r_[True, first[order][1:] != first[order][:-1]]]
            lead = np.empty(len(first), np.int64)
            lead[first[heads]] = heads
            lead = lead[first]
            repeats = np.bincount(first, minlength=len(first))
            here = repeats[first] > 1
            alone = lead == np.arange(len(first))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d if k else None for d, k in zip(digests, alone.tolist(), strict=True)], pa.binary()),
                    pa.array(doc), pa.array(row), pa.array(begin), pa.array(np.array(ends, np.int32)),
                    pa.array(doc[lead]), pa.array(row[lead]), pa.array(begin[lead]), pa.array(here),
                ],
                _NAMES,
            )


def _first_of_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest and place -> the places of digests that repeat, each with the first."""

    def out(d: list, cols: list[np.ndarray], here: np.ndarray, head: tuple | None) -> tuple[pa.RecordBatch, tuple]:
        new = np.array([True] + [x != y for x, y in zip(d[1:], d[:-1], strict=True)])
        doc, row, begin, finish = cols
        lead = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
        first = [doc[lead], row[lead], begin[lead]]
        more = np.r_[~new[1:], False] | ~new | here
        if head is not None and d[0] == head[0]:  # the digest began in the batch before
            same = lead == 0
            more |= same
            for k in range(3):
                first[k] = np.where(same, head[k + 1], first[k])
        batch = pa.RecordBatch.from_arrays(
            [pa.array(x[more]) for x in (doc, row, begin, finish, *first)], ["doc_id", "row_key", "begin", "finish", "first_doc", "first_key", "first_begin"]
        )
        return batch, (d[-1], first[0][-1], first[1][-1], first[2][-1])

    def places(b: pa.RecordBatch) -> tuple[list, list[np.ndarray], np.ndarray]:
        """Digests, places and whether they repeat in a batch; a place that repeated rows gave more than once is one."""
        d = b.column(0).to_pylist()
        cols = [b.column(k).to_numpy() for k in (1, 2, 3, 4)]
        here = b.column(5).to_numpy(zero_copy_only=False).astype(bool)
        again = np.logical_and.reduce([x[1:] == x[:-1] for x in cols[:3]])
        for k in np.flatnonzero(again).tolist():
            again[k] = d[k + 1] == d[k]
        if not again.any():
            return d, cols, here
        starts = np.flatnonzero(np.r_[True, ~again])
        return [d[k] for k in starts.tolist()], [x[starts] for x in cols], np.logical_or.reduceat(here, starts)

    head, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        d, cols, here = places(b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0])
        held = pa.RecordBatch.from_arrays([pa.array(d[-1:], b.schema.types[0]), *(pa.array(x[-1:]) for x in (*cols, here))], schema=b.schema)
        if len(d) < 2:
            continue  # whether the last repeats, the next batch tells
        here[-2] |= d[-2] == d[-1]
        batch, head = out(d[:-1], [x[:-1] for x in cols], here[:-1], head)
        yield batch
    if held is not None:
        batch, _ = out(*places(held), head)
        yield batch


def _spans(min_bytes: int):
    """Repeated chunks sorted by document and position -> maximal runs of at least min_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        last = None
        rows: list[list] = []

        def end() -> None:
            if now is not None and now[3] - now[2] >= min_bytes:
                rows.append(now)

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        names = ["doc_id", "row_key", "begin", "finish", "first_doc", "kept"]
        for b in batches:
            for doc, key, begin, finish, fdoc, fkey, fbegin in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if last == (doc, key, begin):
                    continue  # a repeated row
                last = (doc, key, begin)
                kept = (fdoc, fkey, fbegin) == last
                if now is not None and now[0] == doc and now[1] == key and now[3] == begin and now[5] == kept:
                    now[3] = finish
                else:
                    end()
                    now = [doc, key, begin, finish, fdoc, kept]
            if len(rows) > 10_000:
                yield out()
                rows.clear()
        end()
        yield out()

    return run


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, row_key, begin, finish, n_bytes, first_doc_id, kept): byte spans of repeated chunks.

    One row for each maximal run of chunks that stand elsewhere too. In a run with kept false every
    chunk stands earlier, by doc_id (null first), text key and position: it can be removed. A run
    with kept true holds the first occurrences. first_doc_id is the document of the first occurrence of the
    run's first chunk; row_key is xxhash64 of the text. Documents without repeats have no row; null
    and empty texts have no chunks; rows that repeat doc_id and text count as one document. Columns
    besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    places = own.mapInArrow(_chunked, _SPECIES)
    heads = places.where("digest is not null").select("digest", "doc_id", "row_key", "begin", "finish", "here")
    found = "doc_id long, row_key long, begin int, finish int, first_doc long, first_key long, first_begin int"
    led = heads.repartition(n, "digest").sortWithinPartitions("digest", "doc_id", "row_key", "begin").mapInArrow(_first_of_digest, found)
    led = led.select("doc_id", "row_key", "begin", "finish", F.struct("first_doc", "first_key", "first_begin").alias("first"), *(F.col(c).alias(f"head_{c}") for c in _PLACE))
    # known repeats take the first that their head has got
    known = places.where("digest is null").select("doc_id", "row_key", "begin", "finish", F.lit(None).cast(led.schema["first"].dataType).alias("first"), *(F.col(f"first_{a}").alias(f"head_{c}") for a, c in zip(("doc", "key", "begin"), _PLACE, strict=True)))
    of_head = F.max("first").over(W.partitionBy(*(f"head_{c}" for c in _PLACE)))
    repeats = led.unionByName(known).select("doc_id", "row_key", "begin", "finish", of_head.alias("first")).select("doc_id", "row_key", "begin", "finish", "first.*")
    spans = repeats.repartition(n, "doc_id", "row_key").sortWithinPartitions("doc_id", "row_key", "begin").mapInArrow(
        _spans(min_bytes), "doc_id long, row_key long, begin int, finish int, first_doc long, kept boolean"
    )
    real = lambda c: F.when(F.col(c) == _NULL, None).otherwise(F.col(c))
    return spans.select(
        real("doc_id").alias("doc_id"), "row_key", "begin", "finish", (F.col("finish") - F.col("begin")).cast("long").alias("n_bytes"), real("first_doc").alias("first_doc_id"), "kept"
    )


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with the column __kept_text: its text without the spans that stand earlier.

    Cuts move inwards to whole characters. All rows and columns stay, whatever their names (but for one of that
    name); null and empty texts stay as they are, and an empty table gives no rows.
    """
    docs = docs.drop("__kept_text")
    scratch = Scratch(docs.sparkSession)
    cut = repeated_spans(docs, min_bytes).where(~F.col("kept"))
    cut = scratch.save(cut.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("begin", "finish"))).alias("cut")))
    text = field("text").cast("string")
    same = field("doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("row_key"))
    joined = packed(docs).withColumn("text_key", F.xxhash64(text)).join(cut, same, "left")

    @F.pandas_udf("string")
    def kept(texts, cuts):
        out = []
        for t, c in zip(texts, cuts, strict=True):
            if t is None or c is None or not len(c):
                out.append(t)
                continue
            raw, parts, at = t.encode("utf-8", "surrogatepass"), [], 0
            for span in c:
                a, b = span["begin"], span["finish"]
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(raw[at:a])
                at = b
            out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass"))
        import pandas as pd

        return pd.Series(out, dtype=object)

    return joined.select(*unpacked(docs), kept(text, F.col("cut")).alias("__kept_text"))
