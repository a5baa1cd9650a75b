"""Counts, summaries and set operations over corpora, sessions, drafts and views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Sessions in a baseline and its default, what a message costs beside its characters, characters of a token, titles listed.
BASELINE_SESSIONS, BASELINE_TURNS, MESSAGE_COST, TOKEN_CHARS, TITLES = 5, 5.0, 20, 4, 10


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(type, n): how many objects there are of each type; a type without any has a row with 0."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(kind).alias("type"), F.count("*").alias("n")) for kind, df in tables.items()])


def pivoted_counts(rows: DataFrame, group: str, kinds: dict[str, str], kind: str = "type") -> DataFrame:
    """(group, column…): counts of each kind under the column's name, 0 where there is none."""
    return rows.groupBy(group).agg(*[F.count_if(F.col(kind) == k).alias(name) for name, k in kinds.items()])


def hit_totals(hits: DataFrame) -> DataFrame:
    """(id, hits, last_turn, sessions) of ``hits(session, id, hits, turn)`` over all sessions."""
    return hits.groupBy("id").agg(F.sum("hits").alias("hits"), F.max("turn").alias("last_turn"), F.countDistinct(F.when(F.col("hits") > 0, F.col("session"))).alias("sessions"))


def review_queue(drafts: DataFrame, pending: tuple[str, ...]) -> DataFrame:
    """(status, type, n, pending) with subtotals of both; ``pending`` counts the drafts that wait."""
    return drafts.cube("status", "type").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin(*pending)).alias("pending"))


def pair_weights(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, weight): weights of edges between different groups ``members(id, top)``, by unordered pair, to three places."""
    side = lambda key, name: members.select(F.col("id").alias(key), F.col("top").alias(name))
    pairs = edges.join(side("src", "ta"), "src").join(side("dst", "tb"), "dst").where("ta <> tb")
    return pairs.groupBy(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).agg(F.round(F.sum("weight"), 3).alias("weight"))


def structural_weights(active: DataFrame, references: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, structural_weight): references ``(id, ref)`` to each active node and edges that touch it."""
    ends = references.select(F.col("ref").alias("id")).unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id")))
    return active.select("id").join(ends.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("structural_weight"))


def mismatch(frame: DataFrame, group: str) -> DataFrame:
    """(group, mismatch): the mean distance of the salience now from the smoothed one, over ``frame(group, now, smoothed)``; 0 without a node."""
    return frame.groupBy(group).agg(F.coalesce(F.avg(F.abs(F.col("now") - F.col("smoothed"))), F.lit(0.0)).alias("mismatch"))


def verification_summary(results: DataFrame, batches: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, n, confirmed, all_confirmed, has_contradictions, unresolvable) of ``results(batch, outcome)``; an empty batch is confirmed."""
    s = F.col("outcome")
    told = results.groupBy(batch).agg(F.count("*").alias("n"), F.count_if(s == "CONFIRMED").alias("confirmed"), F.bool_and(s == "CONFIRMED").alias("all_confirmed"), F.bool_or(s == "CONTRADICTED").alias("has_contradictions"), F.count_if(s == "UNRESOLVABLE").alias("unresolvable"))
    out = batches.select(batch).distinct().join(told, batch, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(batch, zero("n"), zero("confirmed"), F.coalesce("all_confirmed", F.lit(True)).alias("all_confirmed"), F.coalesce("has_contradictions", F.lit(False)).alias("has_contradictions"), zero("unresolvable"))


def awareness(objects: DataFrame, owners: DataFrame, unassigned) -> DataFrame:
    """(owner, n): objects by the collection that ``owners(id, owner)`` name, those without one under ``unassigned``."""
    return objects.select("id").join(owners.select("id", "owner"), "id", "left").groupBy(F.coalesce("owner", F.lit(unassigned)).alias("owner")).agg(F.count("*").alias("n"))


def session_list(files: DataFrame) -> DataFrame:
    """(session, drafts, dreamed, pending, modified) of ``files(session, name, modified)``: drafts, those with an enriched copy, and the rest."""
    enriched = F.endswith("name", F.lit(".enriched.json"))
    draft = F.endswith("name", F.lit(".json")) & ~enriched & ~F.endswith("name", F.lit("_raw.json"))
    out = files.groupBy("session").agg(F.count_if(draft).alias("drafts"), F.count_if(enriched).alias("dreamed"), F.max("modified").alias("modified"))
    return out.select("session", "drafts", "dreamed", F.greatest(F.col("drafts") - F.col("dreamed"), F.lit(0)).alias("pending"), "modified")


def session_review(hits: DataFrame, group: str = "session") -> DataFrame:
    """(session, hits, nodes, trajectory) of ``hits(session, id, n)``: the total, the nodes, and ``id:n`` in order of the ids."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("id", "n"))), lambda x: F.concat(x["id"], F.lit(":"), x["n"].cast("string")))
    return hits.groupBy(group).agg(F.sum("n").alias("hits"), F.countDistinct("id").alias("nodes"), F.array_join(line, ",").alias("trajectory"))


def duration_baseline(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """(user, baseline): the mean turns of the last five of ``sessions(user, at, turns)``, or five for a user without one."""
    k = F.row_number().over(W.partitionBy("user").orderBy(F.desc("at")))
    mean = sessions.withColumn("k", k).where(F.col("k") <= BASELINE_SESSIONS).groupBy("user").agg(F.avg("turns").alias("mean"))
    return users.select("user").distinct().join(mean, "user", "left").select("user", F.coalesce("mean", F.lit(BASELINE_TURNS)).alias("baseline"))


def crossings(records: DataFrame) -> DataFrame:
    """(home, target, n) of ``records(home, cross)``: how often slabs of a path name another path in their array."""
    each = records.select("home", F.explode("cross").alias("target"))
    return each.where("home <> target").groupBy("home", "target").agg(F.count("*").alias("n"))


def progress(done: DataFrame, weights: dict[str, float], group: str) -> DataFrame:
    """(group, pct) of ``done(group, phase, done, total)``: weighted phases, each by the part of it that is done."""
    weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    part = F.least(F.lit(1.0), F.col("done") / F.greatest(F.col("total"), F.lit(1)))
    return done.groupBy(group).agg(F.round(100 * F.sum(F.coalesce(F.element_at(weight, F.col("phase")), F.lit(0.0)) * part), 2).alias("pct"))


def context_tokens(text: Column) -> Column:
    """Tokens of the messages of a context, as an aggregate."""
    return F.sum(F.floor((F.length(text) + MESSAGE_COST) / TOKEN_CHARS).cast("long"))


def previews(rows: DataFrame, bucket: str, key: str, most: int) -> DataFrame:
    """(bucket, n, sample): the size of each bucket and its first keys."""
    k = F.row_number().over(W.partitionBy(bucket).orderBy(key))
    first = rows.select(bucket, key).withColumn("k", k).where(F.col("k") <= most)
    return first.join(rows.groupBy(bucket).agg(F.count("*").alias("n")), bucket).select(bucket, "n", F.col(key).alias("sample"))


def best_per_id(similar: DataFrame, key: str = "id") -> DataFrame:
    """(id, similarity): the greatest similarity with which an id was found."""
    return similar.groupBy(key).agg(F.max("similarity").alias("similarity"))


def distinct_titles(rows: DataFrame, group: str, order: str, title: str, most: int = TITLES) -> DataFrame:
    """(group, titles): the different titles of a group in the order in which they first stand, ten at most."""
    first = rows.groupBy(group, title).agg(F.min(order).alias("o"))
    ranked = first.withColumn("k", F.row_number().over(W.partitionBy(group).orderBy("o"))).where(F.col("k") <= most)
    return ranked.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", title))), lambda x: x[title]).alias("titles"))


def inlined(anchors: DataFrame, verdicts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After a consolidation: the anchors that stay, the edges without those that left, and (slab, inline): demoted anchors in their slab."""
    gone = verdicts.where("verdict <> 'KEEP'").select("id")
    inline = anchors.join(verdicts.where("verdict = 'DEMOTE'").select("id", F.col("parent").alias("slab")), "id").groupBy("slab").agg(F.array_sort(F.collect_list(F.struct("id", "phrase"))).alias("inline"))
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return anchors.join(gone, "id", "left_anti"), left, inline


# -- sets -----------------------------------------------------------------------------------------
def merged_view(rows: DataFrame, collections: list[str] | None = None) -> DataFrame:
    """Rows ``(id, collection, …)`` of all or the named collections as one view: the first collection by name that has an id holds it."""
    own = rows if collections is None else rows.where(F.col("collection").isin(*collections))
    rest = [c for c in rows.columns if c not in ("id", "collection")]
    first = own.groupBy("id").agg(F.min(F.struct("collection", *rest)).alias("m"))
    return first.select("id", "m.collection", *[f"m.{c}" for c in rest])


def all_ids(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [t.select("id") for t in tables]).distinct()


def active_set(persisted: DataFrame, discovered: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Persisted collections that were discovered and not absorbed into another."""
    return persisted.select("collection").distinct().join(discovered, "collection", "left_semi").join(absorbed, "collection", "left_anti")


def unreferenced(objects: DataFrame, references: DataFrame) -> DataFrame:
    return objects.select("id").join(references.select(F.col("ref").alias("id")), "id", "left_anti")


def duplicated_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, types): ids that tables of more than one type hold."""
    rows = reduce(DataFrame.unionByName, [df.select("id", F.lit(kind).alias("type")) for kind, df in tables.items()])
    return rows.groupBy("id").agg(F.countDistinct("type").alias("types")).where("types > 1")


def within(found: DataFrame, scope: DataFrame) -> DataFrame:
    return found.join(scope.select("id").distinct(), "id", "left_semi")


def without(found: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Ids that none of the parts, seeds, tiers and conflicts, holds."""
    return found.select("id").distinct().join(all_ids(parts), "id", "left_anti")


def bound_view(rows: DataFrame, name: str) -> DataFrame:
    """Binds a view to a name, in place of the one before, and reads it by it."""
    rows.createOrReplaceTempView(name)
    return rows.sparkSession.table(name)
