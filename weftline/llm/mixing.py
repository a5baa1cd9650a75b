"""Mixing sources to target weights by weighted fair queueing.

The documents of a source queue in the order of a hash; every pass over the source queues them
again, three at most. The virtual finish time of a place in the queue is the number of words its
source has served up to it, divided by the source's target. All places are sorted globally by finish
time, range by range, and cut where their words reach the budget, the number of words of all documents:
the sums of the ranges tell the range of the cut, and its own rows the place. Sums of hash buckets stand
between documents and sources, so no source is ever in one task, and the mix itself comes down to the
last hash taken of each source and pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.rows import field, packed, unpacked
from weftline.session import Scratch

#: Most copies of a document, and so of a source's words.
COPIES = 3
#: Rows of a bucket within a source, in the mean and at most; first characters of the hash name the bucket.
BUCKET_ROWS = 1 << 16


def size_in_words() -> Column:
    """Number of words of the text, a null one having none."""
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(within: str = "") -> Column:
    """The place of a document in its source's queue: an MD5 of doc_id and text."""
    text = lambda c: F.coalesce(F.col(within + c).cast("string"), F.lit(""))
    return F.md5(F.concat(text("doc_id"), F.lit(":"), text("text")))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of sources ``sizes(source, source_size)``.

    In code point order, null last, sources weigh 1, 2, 3, repeating, and share the sum of sizes;
    a target stops at COPIES times the source's size and the excess is shared again by weight. With
    sources ordered by their cap over their weight, those before the first whose cap is not below its share
    stand at their caps. The table has a row for each source.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    ratio = F.col("source_size") * COPIES / F.col("weight")
    order = W.orderBy(ratio, F.col("source").isNull(), F.col("source"))
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(F.col("source_size") * COPIES).over(before), F.lit(0))) / F.sum("weight").over(onward)
    ranked = weighed.withColumn("ratio", ratio).withColumn("level", level)
    free = ranked.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct(F.col("ratio"), F.col("level")))).over(W.partitionBy()))
    target = F.when(F.col("ratio") >= F.col("level"), F.col("final.level") * F.col("weight")).otherwise(F.col("source_size") * F.lit(float(COPIES)))
    return free.select("source", "source_size", F.least(target, F.col("source_size") * F.lit(float(COPIES))).alias("target"))


def _finish(copy: int) -> Column:
    return (F.lit(copy) * F.col("source_size") + F.col("served")) / F.col("target")


def plan(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, target, last): of ``slim(source, size, h)``, the last hash taken in each pass.

    last[c] is null if pass c takes nothing.
    """
    source = lambda: F.col("source")
    slim = scratch.save(slim.select("source", "size", "h"))
    chars = max(1, math.ceil(math.log(max(1, slim.count() / BUCKET_ROWS), 16)))
    slim = slim.withColumn("bucket", F.substring("h", 1, chars))
    sums = scratch.save(slim.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goal = scratch.save(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))))
    budget = goal.agg(F.sum("source_size")).first()[0]
    if not budget:
        return goal.withColumn("last", F.array(*[F.lit(None).cast("string")] * COPIES))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.withColumn("earlier", F.coalesce(F.sum("words").over(earlier), F.lit(0))).select("source", "bucket", "earlier")
    base = base.join(goal, base["source"].eqNullSafe(goal["source"])).select(base["source"], "bucket", "earlier", "source_size", "target").where("target > 0")
    base = base.select(source().alias("s"), F.col("bucket").alias("b"), "earlier", "source_size", "target")
    queue = W.partitionBy("source", "bucket").orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    queued = slim.join(base, slim["source"].eqNullSafe(base["s"]) & (slim["bucket"] == base["b"]))
    served = queued.withColumn("served", F.sum("size").over(queue) + F.col("earlier"))
    places = scratch.save(served.select("source", "h", "size", *[_finish(c).alias(f"t{c}") for c in range(COPIES)]))
    each = F.explode(F.array(*[F.struct(F.col(f"t{c}").alias("t"), F.lit(c).alias("copy")) for c in range(COPIES)])).alias("p")
    n = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("t", "h", "copy")
    queue_all = places.where("size > 0").select("h", "size", each).select("h", "size", "p.t", "p.copy")
    ranged = scratch.save(queue_all.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    reached = ranged.groupBy("range").agg(F.sum("size").alias("words")).withColumn("sum", F.sum("words").over(W.orderBy("range")))  # a row for each of n ranges
    over = reached.where(F.col("sum") > budget).orderBy("range").limit(1).collect()
    last = [F.max("h").alias(f"l{c}") for c in range(COPIES)]
    if over:
        before = over[0]["sum"] - over[0]["words"]
        inside = ranged.where(F.col("range") == over[0]["range"])
        running = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        cut = inside.withColumn("sum", F.sum("size").over(running) + before).where(F.col("sum") > budget).orderBy(*order).limit(1).collect()[0]
        t, h, copy = F.lit(cut["t"]), F.lit(cut["h"]), cut["copy"]
        taken = lambda c: (F.col(f"t{c}") < t) | ((F.col(f"t{c}") == t) & ((F.col("h") < h) | ((F.col("h") == h) & F.lit(c < copy))))
        last = [F.max(F.when(taken(c), F.col("h"))).alias(f"l{c}") for c in range(COPIES)]
    ends = places.groupBy("source").agg(*last).select(source().alias("s"), F.array(*[f"l{c}" for c in range(COPIES)]).alias("last"))
    joined = goal.join(ends, goal["source"].eqNullSafe(ends["s"]), "left")
    return scratch.save(joined.select("source", "source_size", "target", "last"))


def _mixed(docs: DataFrame, size: Column) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession)
    slim = docs.select(F.col("source").cast("string").alias("source"), size.alias("size"), shuffle_key().alias("h"))
    goal = plan(slim, scratch).select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("last").alias("__last"))
    return goal, docs


def _copies(h: Column) -> Column:
    return sum((F.when(h <= F.col("__last")[c], 1).otherwise(0) for c in range(COPIES)), F.lit(0))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    taken is size times the number of passes, up to three, that take the document; rows that
    repeat doc_id and text share their place in the queue. Null texts have no words, a null source
    is a source of its own and the last; sources without words have target 0. An empty table gives
    no rows. Columns besides doc_id, text and source are ignored.
    """
    goal, docs = _mixed(docs, size_in_words())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_in_words().alias("size"), shuffle_key().alias("h"))
    joined = own.join(goal, own["source"].eqNullSafe(goal["__source"]))
    return joined.select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * _copies(F.col("h"))).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns.

    Rows without words take no place of their own and come with the place before the cut that sorts after them.
    Null texts have no words, a null source is a source of its own, repeated rows are taken together, and an
    empty table gives no rows.
    """
    goal, _ = _mixed(docs, size_in_words())
    keyed = packed(docs).withColumn("h", shuffle_key("row."))
    joined = keyed.join(goal, field("source").cast("string").eqNullSafe(F.col("__source")))
    copies = joined.withColumn("copies", _copies(F.col("h"))).where("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*unpacked(docs))


SQL = r"""
WITH slim AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM sizes),
ranked AS (
  SELECT *, source_size * 3 / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source IS NULL, source
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY source_size * 3 / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goal AS (
  SELECT source, source_size,
         least(CASE WHEN ratio >= level THEN (SELECT arg_min(level, ratio) FROM ranked WHERE ratio >= level) * weight
                    ELSE source_size * CAST(3 AS DOUBLE) END, source_size * CAST(3 AS DOUBLE)) AS target
  FROM ranked),
queued AS (
  SELECT s.*, g.source_size, g.target, sum(size) OVER (PARTITION BY s.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS served
  FROM slim s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
places AS (
  SELECT doc_id, h, size, copy, (copy * source_size + served) / target AS t
  FROM queued, (VALUES (0), (1), (2)) c(copy) WHERE target > 0),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY t, h, copy ROWS UNBOUNDED PRECEDING) AS total FROM places),
taken AS (
  SELECT doc_id, h, sum(size) AS taken FROM summed WHERE total <= (SELECT sum(size) FROM slim) GROUP BY doc_id, h)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.h = t.h
"""
