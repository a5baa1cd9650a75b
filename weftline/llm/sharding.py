"""Sharding by extendible hashing, as DataFrame operations alone.

A document's hash is 60 bits of an MD5 of doc_id and text. The directory is indexed by hash-prefix
bits; a bucket whose bytes exceed the limit splits on the next bit, any other stays whole, until
every bucket fits or holds one hash value only. Rows of one hash value (full repeats of a row) go on
pages of the bucket, as many to a page as fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import Scratch

HASH_BITS = 60
#: Bits by which a round of the directory goes deeper at most.
ROUND_BITS = 10


def key_hash() -> Column:
    """The hash as a number below 2**60; nulls count as empty strings."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(text("doc_id"), F.lit(":"), text("text"))), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column | int) -> Column:
    return F.call_function("shiftright", F.col("h"), (F.lit(HASH_BITS) - bits).cast("int")) if isinstance(bits, Column) else F.shiftright("h", HASH_BITS - bits)


def directory(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """(bits, prefix, depth, shard): the leaf of each prefix of ``bits`` bits, for ``rows(h, bytes)``.

    Each round sums bytes by prefixes of a fixed number of bits, derives the sums of all shorter ones,
    and leaves to the next round the prefixes that are still too large.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    base, rest, parts = 0, rows, []
    width = min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + 2))
    while True:
        bits = min(HASH_BITS, base + width)
        width = ROUND_BITS
        known = rest.groupBy(_prefix(bits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high"))
        known = scratch.save(known)
        depths = F.explode(F.sequence(F.lit(base), F.lit(bits))).alias("depth")
        up = F.call_function("shiftright", F.col("prefix"), F.lit(bits) - F.col("depth"))
        nodes = known.select("prefix", "bytes", "low", "high", depths).select("depth", up.alias("node"), "bytes", "low", "high")
        nodes = nodes.groupBy("depth", "node").agg(((F.sum("bytes") <= limit) | (F.min("low") == F.max("high"))).alias("fits"))
        at = known.select("prefix", depths).select("prefix", "depth", up.alias("node"))
        leaf = at.join(nodes.where("fits"), ["depth", "node"]).groupBy("prefix").agg(F.min("depth").alias("depth"))
        leaf = leaf.withColumn("shard", F.lpad(F.conv(F.call_function("shiftright", F.col("prefix"), F.lit(bits) - F.col("depth")).cast("string"), 10, 2), F.col("depth"), F.lit("0")))
        part = scratch.save(leaf.select(F.lit(bits).alias("bits"), "prefix", "depth", F.when(F.col("depth") == 0, "").otherwise(F.col("shard")).alias("shard")))
        parts.append(part)
        left = known.join(part, "prefix", "left_anti").select("prefix")
        if bits == HASH_BITS or left.isEmpty():
            break
        left = scratch.save(left)
        rest = rest.withColumn("prefix", _prefix(bits)).join(left, "prefix", "left_semi").drop("prefix")
        base = bits
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shard(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, page) of every document.

    shard is the bucket's hash prefix in binary (empty if all fits in one), depth its number of bits;
    its bytes are at most ``limit``, unless all its rows have one hash: such repeats of one row go on
    pages 0, 1, ... of max(1, limit / n_bytes) rows each, so that only a single document beyond the limit exceeds it.
    Null and empty texts have 0 bytes. Columns besides doc_id and text are ignored; an empty table gives no rows.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), key_hash().alias("h"))
    own = scratch.save(own.groupBy("doc_id", "n_bytes", "h").agg(F.count("*").alias("n")))
    found = directory(own.select("h", (F.col("n_bytes") * F.col("n")).alias("bytes")), limit, scratch)
    depths = sorted(r[0] for r in found.select("bits").distinct().collect())  # one number a round, six at most
    out, rest = None, own
    for bits in depths:
        part = found.where(F.col("bits") == bits).select("prefix", "depth", "shard")
        keyed = rest.withColumn("prefix", _prefix(bits))
        hit = keyed.join(part, "prefix").drop("prefix")
        rest = keyed.join(part, "prefix", "left_anti").drop("prefix")
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        return own.select("doc_id", "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("page"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    a_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
    return out.select("doc_id", "n_bytes", "shard", "depth", each).select("doc_id", "n_bytes", "shard", "depth", F.when(F.col("n_bytes") == 0, 0).otherwise(F.floor(F.col("copy") / a_page)).cast("long").alias("page"))


def sql(limit: int) -> str:
    return f"""
WITH own AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
nodes AS (
  SELECT d, h >> (60 - d) AS node, sum(n_bytes) <= {limit} OR min(h) = max(h) AS fits
  FROM own, (SELECT unnest(range(0, 61)) AS d) GROUP BY ALL),
leaf AS (
  SELECT h, min(d) AS depth FROM (SELECT DISTINCT h FROM own) o JOIN nodes n ON n.node = h >> (60 - d) WHERE fits GROUP BY h),
paged AS (
  SELECT o.*, l.depth, row_number() OVER (PARTITION BY o.h ORDER BY o.doc_id) - 1 AS copy FROM own o JOIN leaf l USING (h))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, substr(lpad(CAST(h AS BIT)::VARCHAR, 64, '0'), 5, CAST(depth AS INTEGER)) AS shard, CAST(depth AS INTEGER) AS depth,
       CAST(CASE WHEN n_bytes = 0 THEN 0 ELSE copy // greatest(1, {limit} // greatest(n_bytes, 1)) END AS BIGINT) AS page
FROM paged
"""
