"""Validation and state transitions of corpus objects and drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing_references(refs: DataFrame, ids: DataFrame, check: str) -> DataFrame:
    """(check, id, target): references of ``refs(id, ref)`` to ids that do not exist."""
    gone = refs.join(ids.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti")
    return gone.select(F.lit(check).alias("check"), "id", F.col("ref").alias("target"))


def duplicate_ids(objects: DataFrame) -> DataFrame:
    """Ids that more than one type has."""
    return objects.groupBy("id").agg(F.countDistinct("type").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("check"), "id", F.lit(None).cast("string").alias("target"))


def bad_suffixes(objects: DataFrame) -> DataFrame:
    """Ids that do not end in their version."""
    wanted = F.concat(F.lit("_"), F.col("version"))
    return objects.where(~F.col("id").endswith(wanted)).select(F.lit("version_suffix").alias("check"), "id", wanted.alias("target"))


def constrained(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with ``broken``, the names of the constraints that do not hold."""
    names = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])
    return rows.withColumn("broken", F.array_compact(names))


def reviewed(drafts: DataFrame) -> DataFrame:
    """Drafts ``(id, status, action, severity, facts_ok)`` with their new status and, if refused, the reason.

    Promotion to the corpus needs verified facts and a drift severity below high; decided drafts stay as they are.
    """
    open_ = F.col("status").isin("DRAFT_UNAUTHORIZED", "TENTATIVE")
    corpus = F.col("action") == "promote_corpus"
    reason = F.when(~open_, "closed").when(corpus & (F.col("severity") == "high"), "drift").when(corpus & ~F.coalesce("facts_ok", F.lit(False)), "facts")
    new = F.when(reason.isNotNull(), F.col("status")).when(F.col("action") == "discard", "DISCARDED").when(F.col("action") == "promote_tentative", "TENTATIVE").when(corpus, "COMMITTED").otherwise(F.col("status"))
    return drafts.withColumn("new_status", new).withColumn("reason", reason)


def swept_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their next status: PROPOSED and ACCEPTED ones are committed with both ends, rejected without either."""
    s = nodes.select(F.col("id").alias("src"), F.lit(True).alias("has_src"))
    d = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("has_dst"))
    both = edges.join(s, "src", "left").join(d, "dst", "left")
    open_ = F.col("status").isin("PROPOSED", "ACCEPTED")
    ready = F.col("has_src").isNotNull() & F.col("has_dst").isNotNull()
    new = F.when(~open_, F.col("status")).when(ready & (F.col("status") == "ACCEPTED"), "COMMITTED").when(ready, "PROPOSED").otherwise("REJECTED")
    return both.select("src", "dst", "status", new.alias("new_status"))


def pressured(nodes: DataFrame, deltas: DataFrame) -> DataFrame:
    """Pressure of each node after its increments, 1 at most."""
    d = deltas.groupBy("id").agg(F.sum("delta").alias("d"))
    return nodes.join(d, "id", "left").select("id", F.least(F.lit(1.0), F.col("pressure") + F.coalesce("d", F.lit(0.0))).alias("pressure"))


def deletable(ids: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, dependents, safe): how many rows of ``refs(id, ref)`` point to each id; it can go if none does."""
    n = refs.groupBy(F.col("ref").alias("id")).agg(F.count("*").alias("dependents"))
    out = ids.select("id").join(n, "id", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    return out.withColumn("safe", F.col("dependents") == 0)


def amended(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Old rows with the new values that are given, their status set back; identity fields are not among ``fields``."""
    n = new.select("id", F.lit(True).alias("__hit"), *[F.col(f).alias(f"__{f}") for f in fields])
    out = old.join(n, "id", "left")
    status = F.when(F.col("__hit"), "DRAFT_UNAUTHORIZED").otherwise(F.col("status"))
    return out.select("id", *[F.coalesce(f"__{f}", f).alias(f) for f in fields], status.alias("status"))


# Verbs of a review with the status they lead to, verdicts of a trajectory with the verb they call, and verdicts that note a successor.
VERBS = {
    "discard": "REJECTED", "promote_tentative": "PROVISIONAL", "promote_corpus": "COMMITTED", "promote_library": "COMMITTED", "delete": "DELETED", "accept": "ACCEPTED", "reject": "REJECTED", "dismiss": "DISMISSED",
}
VERDICT_VERBS = {"CONFIRMED": "promote_corpus", "UNTOUCHED_KEEP": "promote_tentative", "UNTOUCHED_DROP": "discard", "RETRACTED": "discard", "DRIFTED": "discard"}
SUPERSEDED = ("RETRACTED", "DRIFTED")
OPEN = ("DRAFT_UNAUTHORIZED", "TENTATIVE", "PROVISIONAL", "PROPOSED", "ACCEPTED")


def _chosen(key: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def acted(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """Rows ``(id, status)`` after ``actions(id, verb)``, with the error of an action that can't be done: an unknown verb, or a closed row.

    A row without an action stays; each row is judged alone, so that one error stops no other.
    """
    out = rows.join(actions.select("id", "verb"), "id", "left")
    new = _chosen(F.col("verb"), VERBS)
    error = F.when(F.col("verb").isNotNull() & new.isNull(), "unknown_verb").when(F.col("verb").isNotNull() & ~F.col("status").isin(*OPEN), "closed")
    return out.withColumn("error", error).withColumn("status", F.when(error.isNull() & new.isNotNull(), new).otherwise(F.col("status"))).drop("verb")


def trajectory_applied(drafts: DataFrame, verdicts: DataFrame, successors: DataFrame) -> DataFrame:
    """Drafts ``(id, status, epistemic)`` after the verdicts of a trajectory plan, with ``superseded_by`` and ``error``.

    Confirmed drafts are committed, kept ones go to the library, the others are rejected. All but plainly dropped ones are marked as
    canonicalised, and those that were drafts of something else note the successor from ``successors(id, by)``, if there is one.
    """
    plan = verdicts.select("id", "verdict").withColumn("verb", _chosen(F.col("verdict"), VERDICT_VERBS))
    moved = acted(drafts.select("id", "status"), plan.where("verb is not null")).withColumnRenamed("status", "new_status")
    out = drafts.join(moved, "id").join(plan.drop("verb"), "id", "left").join(successors.select("id", "by"), "id", "left")
    done = F.col("error").isNull() & F.col("verdict").isin(*[v for v in VERDICT_VERBS if v != "UNTOUCHED_DROP"])
    note = F.when(F.col("error").isNull() & F.col("verdict").isin(*SUPERSEDED), F.col("by"))
    return out.select("id", F.col("new_status").alias("status"), F.when(done, "CANONICALIZED").otherwise(F.col("epistemic")).alias("epistemic"), note.alias("superseded_by"), "error", "verdict")


def trajectory_counts(applied: DataFrame) -> DataFrame:
    """(outcome, n) of an applied plan: what became of the drafts that a verdict named, errors apart."""
    names = {"CONFIRMED": "confirmed_promoted", "UNTOUCHED_KEEP": "untouched_preserved", "UNTOUCHED_DROP": "untouched_discarded", "RETRACTED": "retracted_demoted", "DRIFTED": "drifted_demoted"}
    outcome = F.when(F.col("error").isNotNull(), "errors").otherwise(_chosen(F.col("verdict"), names))
    return applied.where("verdict is not null").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n")).where("outcome is not null")


def committed(corpus: DataFrame, candidates: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The corpus ``(id, type, version)`` after a commit, and the errors that its candidates would bring.

    Candidates are validated together with the corpus: ids of several types, ids without their version, references
    (``refs(id, ref)``) to nothing. With any error the corpus stays as it was, else it holds the candidates too, each id once.
    """
    own = candidates.select("id", "type", "version")
    held = corpus.select("id", "type", "version")
    both = held.unionByName(own.join(held.select("id", "type"), ["id", "type"], "left_anti"))
    mine = refs.join(own.select("id"), "id", "left_semi")
    errors = duplicate_ids(both).join(own.select("id"), "id", "left_semi").unionByName(bad_suffixes(own)).unionByName(missing_references(mine, both, "missing_reference"))
    failed = errors.limit(1).select(F.lit(True).alias("failed"))
    new = both.join(held.select("id", "type", F.lit(True).alias("old")), ["id", "type"], "left")
    kept = new.join(F.broadcast(failed), how="left").where(F.col("old").isNotNull() | F.col("failed").isNull())  # one row at most
    return kept.select("id", "type", "version"), errors


def library_promoted(corpus: DataFrame, library: DataFrame, wanted: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, library and errors after ``wanted(id)`` rows of the library were committed: they leave it only if the commit holds."""
    chosen = library.join(wanted.select("id"), "id", "left_semi")
    new, errors = committed(corpus, chosen, refs)
    return new, library.join(new.select("id"), "id", "left_anti"), errors


def consolidation_preview(verdicts: DataFrame, examples: int, confirmed: bool) -> tuple[DataFrame, DataFrame]:
    """(verdict, n, examples) of consolidation verdicts, and the anchors that go: none unless it was confirmed."""
    names = F.slice(F.array_sort(F.collect_list("id")), 1, examples)
    counts = verdicts.groupBy("verdict").agg(F.count("*").alias("n"))
    first = verdicts.withColumn("k", F.row_number().over(W.partitionBy("verdict").orderBy("id"))).where(F.col("k") <= examples).groupBy("verdict").agg(names.alias("examples"))
    return counts.join(first, "verdict"), verdicts.where((F.col("verdict") != "KEEP") & F.lit(confirmed)).select("id")


def chat_closed(messages: DataFrame, chats: DataFrame, chat: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the end of a chat leaves: its messages in order for a last extraction, its length (if it has a user's turn), and the chats with it closed."""
    own = messages.where(F.col("chat") == chat)
    turns = own.agg(F.count_if(F.col("role") == "user").alias("turns")).where("turns >= 1").select(F.lit(chat).alias("chat"), "turns")
    status = F.when(F.col("id") == chat, "CLOSED").otherwise(F.col("status"))
    return own.orderBy("turn"), turns, chats.withColumn("status", status)


def commit_preview(drafts: DataFrame, nodes: DataFrame, edges: DataFrame, facts: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, neighbours, cascade, facts_ok, missing) of ``drafts(id)``: what a commit of each would touch, without doing it.

    Neighbours are nodes one edge away, the cascade those that point to the draft, ``facts(id, outcome)`` are all confirmed (or none are known),
    and missing counts references ``(id, ref)`` to nodes that do not exist.
    """
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    near = ends.where("id <> other").join(nodes.select(F.col("id").alias("other")), "other", "left_semi").groupBy("id").agg(F.countDistinct("other").alias("neighbours"))
    back = edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("cascade"))
    checked = facts.groupBy("id").agg(F.bool_and(F.col("outcome") == "CONFIRMED").alias("ok"))
    gone = missing_references(refs, nodes, "missing").groupBy("id").agg(F.count("*").alias("missing"))
    out = drafts.select("id").join(near, "id", "left").join(back, "id", "left").join(checked, "id", "left").join(gone, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("id", zero("neighbours"), zero("cascade"), F.coalesce("ok", F.lit(True)).alias("facts_ok"), zero("missing"))
