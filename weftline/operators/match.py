"""Joins of labels, phrases and references."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.functions import text as T
from weftline.session import Scratch


def label_index(entries: DataFrame) -> DataFrame:
    """(key, id): of ``entries(label, id, priority)`` the first registration of each key."""
    keyed = entries.select(T.label_key(F.col("label")).alias("key"), "id", "priority").where("key <> ''")
    return keyed.groupBy("key").agg(F.min(F.struct("priority", "id")).alias("m")).select("key", "m.id")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings; Levenshtein distance is another measure."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


#: Longest keys that meet on pieces at their places; where one of two keys is longer, they meet on any run of characters.
PLACED = 64
#: Shortest key that is contained, or contains, and its least share of the other's length.
INSIDE, HALF = 5, 0.5
#: Lengths of the pieces on which contained keys meet.
_PIECES = [3, *sorted(k << i for k in (4, 6) for i in range(12))]


def _grams(key: Column) -> Column:
    """Runs of three characters of a key, and of two where it is no longer than eight."""
    runs = lambda k: F.when(F.length(key) >= k, F.transform(F.sequence(F.lit(1), F.length(key) - k + 1), lambda i: F.substring(key, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs(3), F.when(F.length(key) <= 8, runs(2)).otherwise(F.array().cast("array<string>"))))


def _edits(a: int, b: int, ratio: float) -> int | None:
    """Characters of two keys of these lengths that may stay without a match if they are alike at ``ratio``; None if they can't be."""
    matched = math.ceil(ratio * (a + b) / 2 - 1e-9)
    return a + b - 2 * matched if matched <= min(a, b) else None


def _segments(length: int, n: int) -> list[tuple[int, int]]:
    """(start, length) of n even parts of a key, the shorter ones at its ends."""
    base, more = divmod(length, n)
    first = (n - more) // 2
    return [(i * base + min(max(i - first, 0), more), base + (first <= i < first + more)) for i in range(n)]


def _below(length: int) -> int:
    return max(p for p in _PIECES if p <= length)


def _held(length: int) -> tuple[bool, int, int]:
    """Whether a key of the index can contain or be contained, and the lengths of its opening and of its parts end to end, of which a key inside it holds one."""
    return length >= INSIDE, _below(max(length, 3)), _below((max(INSIDE, math.ceil(length * HALF)) + 1) // 2)


def _kept_pieces(length: int, asked: list[int], ratio: float) -> Iterator[tuple[int, int, int]]:
    """(salt, start, length) of the pieces of an index key of a length under which it is kept."""
    whole, opening, part = _held(length)
    if whole:
        yield 1 << 40, 0, opening
        for start in range(0, length - part + 1, part):
            yield 2 << 40, start, part
    for edits in sorted({e for a in asked if (e := _edits(a, length, ratio)) is not None}):
        for i, (start, n) in enumerate(_segments(length, edits + 1)):
            yield (3 << 40) + (length << 24) + (edits << 12) + i, start, n


def _sought_pieces(length: int, kept: list[int], ratio: float) -> Iterator[tuple[int, int, int]]:
    """(salt, start, length) of the pieces of an asked key of a length under which keys of the lengths ``kept`` are sought.

    A key inside another shares its opening, or one of the other's parts. Of two alike keys, with ``edits`` characters
    without a match, take edits + 1 parts of one: in the first part i up to whose end there are no more than i edits
    there is none, so it stands whole in the other, moved by a sum of i steps, and the rest of them bring it back.
    """
    fits = [k for k in kept if min(k, length) >= INSIDE and min(k, length) >= HALF * max(k, length)]
    for salt, sizes in ((1, {_held(k)[1] for k in fits if k <= length}), (2, {_held(k)[2] for k in fits if k >= length})):
        for n in sorted(sizes):
            yield from ((salt << 40, start, n) for start in range(length - n + 1))
    for k in kept:
        edits = _edits(length, k, ratio)
        if edits is None:
            continue
        for i, (start, n) in enumerate(_segments(k, edits + 1)):
            for moved in range(-i, i + 1, 2):
                if abs(length - k - moved) <= edits - i and 0 <= start + moved <= length - n:
                    yield (3 << 40) + (k << 24) + (edits << 12) + i, start + moved, n


def _placed(keys: DataFrame, plan: dict[int, list[tuple[int, int, int]]], name: str) -> DataFrame:
    """(h, name): the pieces of keys, by a plan for each of their lengths, which are no more than ``PLACED``."""
    rows = keys.sparkSession.createDataFrame(list(plan.items()), "l int, plan array<struct<salt:long,start:int,n:int>>")
    own = keys.join(F.broadcast(rows), F.length("key") == F.col("l"))
    return own.select(F.col("key").alias(name), F.explode(F.array_distinct(F.transform("plan", lambda p: F.xxhash64(p["salt"], F.substring(F.col("key"), p["start"] + 1, p["n"]))))).alias("h"))


def _near_keys(asked: DataFrame, index: DataFrame, ratio: float) -> DataFrame:
    """(k0, k1): of ``asked(key)`` and ``index(key)`` all pairs of which one contains the other or that may be alike."""
    both = (asked.select("key").distinct(), index.select("key").distinct())
    lengths = [[r.l for r in df.select(F.least(F.length("key"), F.lit(PLACED + 1)).alias("l")).where("l > 0").distinct().collect()] for df in both]  # no more than PLACED + 1 numbers
    short = [sorted(n for n in side if n <= PLACED) for side in lengths]
    plans = {a: list(_sought_pieces(a, short[1], ratio)) for a in short[0]}, {k: list(_kept_pieces(k, short[0], ratio)) for k in short[1]}
    pairs = _placed(both[0], plans[0], "k0").join(_placed(both[1], plans[1], "k1"), "h").drop("h")
    if PLACED + 1 in lengths[0] + lengths[1]:
        least = PLACED * min(HALF, ratio / (2 - ratio))
        grams = [df.where(F.length("key") > least).select(F.col("key").alias(name), F.explode(_grams(F.col("key"))).alias("w")) for df, name in zip(both, ("k0", "k1"), strict=True)]
        pairs = pairs.unionByName(grams[0].join(grams[1], "w").drop("w").where(F.greatest(F.length("k0"), F.length("k1")) > PLACED))
    total = F.length("k0") + F.length("k1")
    edits = (total - 2 * F.ceil(ratio * total / 2 - 1e-9)).cast("int")
    may = (2 * F.least(F.length("k0"), F.length("k1")) >= ratio * total) & (F.call_function("levenshtein", "k0", "k1", edits) >= 0)  # no more than those without a match
    return pairs.where(_inside() | may).distinct()


def _inside() -> Column:
    short, long_ = F.least(F.length("k0"), F.length("k1")), F.greatest(F.length("k0"), F.length("k1"))
    return (short >= INSIDE) & (short / long_ >= HALF) & (F.contains("k0", F.col("k1")) | F.contains("k1", F.col("k0")))


def resolve_labels(labels: DataFrame, index: DataFrame, ratio: float = 0.85) -> DataFrame:
    """(label, id, strategy) of ``labels(label)``: exact, contained, alike, or miss.

    Containment needs five characters and half the length on either side, the longest key winning.
    Labels that are not found exactly meet the keys that hold one of their pieces at a place where contained or alike
    keys must; keys of more than 64 characters meet on any three characters in a row, which alike ones share. Pairs that need
    too many edits are left out before their blocks are compared.
    """
    asked = labels.select("label", T.label_key(F.col("label")).alias("key")).distinct()
    scratch = Scratch(labels.sparkSession)
    exact = scratch.save(asked.join(index, "key").select("label", "id", F.lit("exact").alias("strategy")))
    rest = scratch.save(asked.join(exact, "label", "left_anti"))
    near = _near_keys(rest, index, ratio).join(rest.withColumnRenamed("key", "k0"), "k0").join(index.withColumnRenamed("key", "k1"), "k1")
    near = scratch.save(near.select("label", "k0", "k1", "id"))
    part = near.where(_inside()).groupBy("label").agg(F.min(F.struct((-F.length("k1")).alias("l"), "k1", "id")).alias("m")).select("label", "m.id", F.lit("contained").alias("strategy"))
    close = near.where(2 * F.least(F.length("k0"), F.length("k1")) >= ratio * (F.length("k0") + F.length("k1")))  # no more than the shorter can match
    alike = close.join(part, "label", "left_anti").withColumn("r", sequence_ratio("k0", "k1")).where(F.col("r") >= ratio)
    alike = alike.groupBy("label").agg(F.min(F.struct((-F.col("r")).alias("r"), "k1", "id")).alias("m")).select("label", "m.id", F.lit("alike").alias("strategy"))
    found = exact.unionByName(part).unionByName(alike)
    miss = asked.join(found, "label", "left_anti").select("label", F.lit(None).cast("string").alias("id"), F.lit("miss").alias("strategy"))
    return found.unionByName(miss)


def phrase_hits(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(text_id, id): phrases, of at least one word, that stand in a text by words in a row.

    ``texts(text_id, text)``, ``phrases(id, phrase)``. Texts and phrases meet on the phrase's first word,
    and the phrase is then looked for in the text, so that no text meets all phrases.
    """
    key = lambda c: F.concat(F.lit(" "), T.alnum_key(c), F.lit(" "))
    t = texts.select("text_id", key(F.col("text")).alias("t"))
    p = phrases.select("id", key(F.col("phrase")).alias("p")).where("p <> '  '").withColumn("w", F.split(F.trim("p"), " ")[0])
    words = t.select("text_id", F.explode(F.array_distinct(F.split(F.trim("t"), " "))).alias("w"))
    pairs = words.join(p, "w").select("text_id", "id", "p")
    return pairs.join(t, "text_id").where(F.contains("t", F.col("p"))).select("text_id", "id").distinct()


def word_overlap(catalog: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(text_id, id, overlap): the k entries that share most words with a text, ties to the smaller id."""
    a = texts.select("text_id", F.explode(T.word_set(F.col("text"))).alias("w")).distinct()
    b = catalog.select("id", F.explode(T.word_set(F.col("text"))).alias("w")).distinct()
    shared = a.join(b, "w").groupBy("text_id", "id").agg(F.count("*").alias("overlap"))
    best = W.partitionBy("text_id").orderBy(F.desc("overlap"), "id")
    return shared.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).drop("k")


def reverse_references(refs: DataFrame, target: Column) -> DataFrame:
    """Rows of ``refs(id, field, ref)`` that list the target."""
    return refs.where(F.col("ref") == target).select("id", "field")


def resolved_edges(proposed: DataFrame, index: DataFrame, existing: DataFrame, types: list[str]) -> DataFrame:
    """Edges of ``proposed(type, src_label, dst_label, confidence)``: unknown types are LINKS, ends resolve exactly, no repeats."""
    kind = F.when(F.upper("type").isin(types), F.upper("type")).otherwise("LINKS")
    s = index.select(F.col("key").alias("sk"), F.col("id").alias("src"))
    d = index.select(F.col("key").alias("dk"), F.col("id").alias("dst"))
    keyed = proposed.select(kind.alias("type"), T.label_key(F.col("src_label")).alias("sk"), T.label_key(F.col("dst_label")).alias("dk"), T.clamp01(F.col("confidence")).alias("confidence"))
    found = keyed.join(s, "sk").join(d, "dk").where("src <> dst").groupBy("type", "src", "dst").agg(F.max("confidence").alias("confidence"))
    return found.join(existing.select("type", "src", "dst"), ["type", "src", "dst"], "left_anti")


def overlap_classes(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(key, side): keys of both, of the baseline alone, or of the candidate alone."""
    b = base.select(T.alnum_key(F.col("label")).alias("key")).distinct().withColumn("b", F.lit(True))
    c = candidate.select(T.alnum_key(F.col("label")).alias("key")).distinct().withColumn("c", F.lit(True))
    side = F.when(F.col("b") & F.col("c"), "both").when(F.col("b"), "only_baseline").otherwise("only_candidate")
    return b.join(c, "key", "full").select("key", side.alias("side"))


def paired_in_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b): rows of both sides with one key, each used once, in order of their numbers."""
    n = lambda df, name: df.select("key", F.col("id").alias(name), F.row_number().over(W.partitionBy("key").orderBy("id")).alias("n"))
    return n(a, "a").join(n(b, "b"), ["key", "n"]).select("key", "a", "b")
