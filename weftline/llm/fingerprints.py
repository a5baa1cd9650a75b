"""Canonical exact document fingerprints.

A text is normalised (NFKC, case folding, NFKC again, white space folded), hashed with 128-bit
xxhash and grouped by digest; inside groups of equal digests the canonical texts are compared byte
by byte, and should two texts ever collide, the later ones in byte order get a suffix of their own.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import Scratch, ship

#: Up to so many shared digests (of 40 bytes) are broadcast to find the texts to compare.
BROADCAST_DIGESTS = 100_000
#: Places in which the texts of one digest are compared first.
SALTS = 32


def canonical(text: str | None) -> str:
    """NFKC, case folding and white space folding; null is the empty text."""
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def wide_digest(raw: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(raw)


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _bytes_column(docs: DataFrame, name: str) -> DataFrame:
    """(digest, canon) of a text column, canon as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([_raw(canonical(t.as_py())) for t in b.column(1)], pa.binary())], ["digest", "canon"]
            )

    return docs.select("digest", F.col(name)).mapInArrow(run, "digest string, canon binary")


def _compared(candidates: DataFrame) -> DataFrame:
    """(digest, canon, suffix): the texts of digests that more than one canonical text has."""
    # a digest that stands everywhere has a row from each task: they meet in SALTS places first
    salted = candidates.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    ends = salted.groupBy("digest", "salt").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    ends = ends.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    split = ends.where("low <> high").select("digest")
    texts = candidates.join(split, "digest", "left_semi").distinct()
    lower = texts.select("digest", F.col("canon").alias("other"))
    # collisions of a wide digest are a handful at most; each text counts those before it
    below = texts.join(lower, "digest").where("other < canon").groupBy("digest", "canon").agg(F.count("*").alias("suffix"))
    return below


def fingerprints(docs: DataFrame, digest: Callable[[bytes], str] = wide_digest) -> DataFrame:
    """(doc_id, fingerprint) of every row; equal canonical texts, and only those, have equal fingerprints.

    Null and empty texts share the fingerprint of the empty text. Columns besides doc_id and text
    are ignored, repeated rows stay, an empty table gives no rows.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([digest(_raw(canonical(t.as_py()))) for t in b.column(1)], pa.string())], ["doc_id", "text", "digest"])

    hashed = own.mapInArrow(run, "doc_id long, text string, digest string")
    scratch = Scratch(docs.sparkSession)
    shared = scratch.save(hashed.groupBy("digest").count().where("count > 1").select("digest"))
    few = shared.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    some = hashed.join(F.broadcast(shared) if few else shared, "digest", "left_semi")
    below = scratch.save(_compared(_bytes_column(some, "text")))
    if below.isEmpty():
        return hashed.select("doc_id", F.col("digest").alias("fingerprint"))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([_raw(canonical(t.as_py())) for t in b.column(1)], pa.binary())], ["doc_id", "digest", "canon"])

    named = hashed.mapInArrow(spelled, "doc_id long, digest string, canon binary").join(below, ["digest", "canon"], "left")
    return named.select("doc_id", F.concat_ws("-", "digest", F.col("suffix").cast("string")).alias("fingerprint"))


def edited(text: str | None, following: str | None) -> str:
    """The text with its last half replaced by as much of the start of the following one."""
    text, following = text or "", following or ""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _cuts(docs: DataFrame, n: int) -> tuple[list[int], int | None, bool]:
    """Up to n - 1 doc_ids that begin a range each, the smallest doc_id, whether one is null."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    low, nulls = ids.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if low is None:
        return [], None, bool(nulls)
    cuts = ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.001 if n < 500 else 0.1 / n)
    return sorted({int(c) for c in cuts if c > low}), low, bool(nulls)


def _neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """(range, copy, doc_id, text) dealt by ranges of doc_id; the first rows of a range also stand, as copies, behind the range before."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, low, nulls = _cuts(docs, n)
    starts = [None if nulls else low, *cuts]
    if nulls and low is not None:
        cuts, starts = [low, *cuts], [None, low, *cuts]
    size = max(1, len(starts))
    key = F.col("doc_id")
    at: Column = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
        # position of the last cut that is not above the id, by binary search in a sorted literal array
        at = F.when(key.isNull(), F.lit(0)).otherwise(_position(key, cuts, bounds))
    rows = docs.select(key.cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_start = F.lit(False)
    if None in starts:
        is_start = key.isNull()
    values = [c for c in starts if c is not None]
    if values:
        is_start = is_start | F.coalesce(key.isin(values), F.lit(False))
    own = rows.withColumn("range", at)
    behind = F.pmod(F.col("range") - 1, F.lit(size))
    both = F.when(is_start, F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("copy")), F.struct(behind.alias("range"), F.lit(True).alias("copy")))).otherwise(
        F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("copy")))
    )
    return own.withColumn("to", F.explode(both)).select("to.range", "to.copy", "doc_id", "text"), size


def _position(key: Column, cuts: list[int], bounds: Column) -> Column:
    """How many cuts are at most ``key``: a binary tree of comparisons, of logarithmic depth."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def _paired(batches: Iterator[pa.RecordBatch], handle: Callable[[int | None, str, str], tuple], pack: Callable[[list[tuple]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls handle with each document and the text of the next one, and packs its results.

    Rows come range by range, own rows in order before the copies; a range's last document is
    followed by the first copy. A range without copies follows itself (the whole table in one).
    """
    current = None  # (range, doc_id, text)
    first = None
    closed = False
    rows: list[tuple] = []
    size = 0
    for b in batches:
        for r, copy, doc_id, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if current is not None and current[0] != r:
                if not closed:
                    rows.append(handle(current[1], current[2], first or ""))
                current, closed = None, False
            if copy:
                if current is not None and not closed:
                    rows.append(handle(current[1], current[2], text or ""))
                    closed = True
            else:
                if current is not None:
                    rows.append(handle(current[1], current[2], text or ""))
                else:
                    first = text
                current = (r, doc_id, text or "")
            size += len(text or "")
            if size > 4_000_000 or len(rows) > 4096:
                yield pack(rows)
                rows, size = [], 0
    if current is not None and not closed:
        rows.append(handle(current[1], current[2], first or ""))
    yield pack(rows)


def edit_report(docs: DataFrame, digest: Callable[[bytes], str] = wide_digest) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (1.0 for equal fingerprints, else 0.0, as a digest has no degrees). The
    edited text is that of ``edited`` with the next document by doc_id, the first one following the
    last. Null texts are empty; null doc_ids stand first; rows with one doc_id go by text; an only
    row follows itself. Columns besides doc_id and text are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, tuple[str, str]] = {}

        def print_of(text: str) -> str:
            if memo.get(0, ("", ""))[0] != text or 0 not in memo:
                memo[0] = (text, digest(_raw(canonical(text))))
            return memo[0][1]

        def handle(doc_id: int | None, text: str, following: str) -> tuple:
            new = edited(text, following)
            own = print_of(text)
            nxt = print_of(following)
            return doc_id, len(text), hashlib.sha256(_raw(new)).hexdigest(), own, digest(_raw(canonical(new))), nxt, xxhash.xxh3_128_hexdigest(_raw(text)), xxhash.xxh3_128_hexdigest(_raw(following))

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        names = ["doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", "next_digest", "exact", "next_exact"]
        yield from _paired(batches, handle, pack)

    ship(docs.sparkSession)
    dealt, size = _neighbours(docs)
    dealt = dealt.repartitionById(size, F.col("range")).sortWithinPartitions("range", "copy", "doc_id", "text")
    kinds = "doc_id long, n_chars long, edited_sha256 string, digest string, edited_digest string, next_digest string, exact string, next_exact string"
    told = scratch.save(dealt.mapInArrow(described, kinds))

    # digests that more than one different text has: those texts are compared
    pooled = told.select("digest", F.col("exact").alias("text_key")).unionByName(
        told.select(F.col("edited_digest").alias("digest"), F.col("edited_sha256").alias("text_key"))
    )
    shared = pooled.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    shared = scratch.save(shared)
    few = shared.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    wanted = F.broadcast(shared) if few else shared

    def canons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [_raw(canonical(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(r) for r in raws], pa.string()), pa.array(raws, pa.binary())], ["digest", "canon"])

    originals = docs.select(F.col("text").cast("string")).mapInArrow(canons, "digest string, canon binary").join(wanted, "digest", "left_semi")
    # distinct first: copies followed by copies are one pair of texts, however many there are
    pairs = told.select("exact", "next_exact", "edited_digest").distinct()
    again = pairs.join(shared, pairs["edited_digest"] == shared["digest"], "left_semi").select("exact", "next_exact").distinct()
    candidates = originals.unionByName(_edited_again(docs, scratch.save(again), digest, scratch))
    below = scratch.save(_compared(candidates))
    plain = told.select(
        "doc_id", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), F.col("next_digest").alias("next_fingerprint")
    )
    if not below.isEmpty():  # never seen with a wide digest; exact all the same
        plain = _resolved(docs, below, digest)
    same = lambda c: F.when(F.col("fingerprint") == F.col(c), 1.0).otherwise(0.0)
    return plain.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))


def _edited_again(docs: DataFrame, again: DataFrame, digest: Callable[[bytes], str], scratch: Scratch) -> DataFrame:
    """(digest, canon) of the edited texts whose digest is shared, made again from the two texts they join."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [xxhash.xxh3_128_hexdigest(_raw(t.as_py() or "")) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), b.column(0)], ["exact", "text"])

    needed = scratch.save(again.select("exact").unionByName(again.select(F.col("next_exact").alias("exact"))).distinct())
    few = needed.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    texts = docs.select(F.col("text").cast("string")).mapInArrow(keyed, "exact string, text string").join(F.broadcast(needed) if few else needed, "exact", "left_semi")
    texts = scratch.save(texts.dropDuplicates(["exact"]))
    both = again.join(texts, "exact").join(texts.select(F.col("exact").alias("next_exact"), F.col("text").alias("following")), "next_exact").select("text", "following")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [_raw(canonical(edited(t.as_py(), f.as_py()))) for t, f in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(r) for r in raws], pa.string()), pa.array(raws, pa.binary())], ["digest", "canon"])

    return both.mapInArrow(made, "digest string, canon binary")


def _resolved(docs: DataFrame, below: DataFrame, digest: Callable[[bytes], str]) -> DataFrame:
    """The report's fingerprints once more, with the canonical texts at hand, suffixed where digests collide."""
    dealt, size = _neighbours(docs)
    dealt = dealt.repartitionById(size, F.col("range")).sortWithinPartitions("range", "copy", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "digest", "canon", "edited_digest", "edited_canon", "next_digest", "next_canon"]

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handle(doc_id: int | None, text: str, following: str) -> tuple:
            new = edited(text, following)
            raws = [_raw(canonical(t)) for t in (text, new, following)]
            return doc_id, len(text), hashlib.sha256(_raw(new)).hexdigest(), *[x for r in raws for x in (digest(r), r)]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.string(), pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        yield from _paired(batches, handle, pack)

    out = dealt.mapInArrow(spelled, "doc_id long, n_chars long, edited_sha256 string, digest string, canon binary, edited_digest string, edited_canon binary, next_digest string, next_canon binary")
    for prefix, name in (("", "fingerprint"), ("edited_", "edited_fingerprint"), ("next_", "next_fingerprint")):
        own = below.select(F.col("digest").alias(f"{prefix}digest"), F.col("canon").alias(f"{prefix}canon"), "suffix")
        out = out.join(own, [f"{prefix}digest", f"{prefix}canon"], "left")
        out = out.withColumn(name, F.concat_ws("-", f"{prefix}digest", F.col("suffix").cast("string"))).drop("suffix")
    return out
