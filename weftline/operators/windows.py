"""Ordered-sequence operators: drift, salience, spans of turns, sequence edges, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as T

# Drift window, weights of the composite and severity thresholds.
WINDOW, WEIGHTS = 50, (0.30, 0.25, 0.25, 0.20)
THRESHOLDS = {"external": (0.39, 0.69), "internal": (0.54, 0.79)}
BASELINE = 5.0
# Smoothing of salience, inheritance, weight decay and its floor.
ALPHA, INHERIT, DECAY, FLOOR = 0.3, 0.9, 0.85, 0.10


def severity(composite: Column, mode: Column) -> Column:
    low = F.when(mode == "internal", THRESHOLDS["internal"][0]).otherwise(THRESHOLDS["external"][0])
    medium = F.when(mode == "internal", THRESHOLDS["internal"][1]).otherwise(THRESHOLDS["external"][1])
    return F.when(composite <= low, "low").when(composite <= medium, "medium").otherwise("high")


def drift(signals: DataFrame, baseline: float = BASELINE, size: int = WINDOW) -> DataFrame:
    """One assessment for each row of ``signals(session, turn, affect, volatility, rigor, mode)``.

    The last ``size`` rows are weighed 1, 2, ..., n over n (n + 1) / 2, oldest to newest; the duration signal
    reaches 1 after 1.4 times the baseline. A weighted sum over the frame is the difference of two running sums:
    sum(x (i - first + 1)) with i the row's number in the session.
    """
    part = W.partitionBy("session").orderBy("turn")
    frame = part.rowsBetween(-(size - 1), 0)
    n = F.least(F.col("i"), F.lit(size))
    numbered = signals.withColumn("i", F.row_number().over(part)).withColumn("start", F.first("turn").over(part))
    out = numbered.withColumn("n", n)
    for c in ("affect", "volatility", "rigor"):
        weighted = F.sum(F.col(c) * F.col("i")).over(frame) - (F.col("i") - F.col("n")) * F.sum(c).over(frame)
        out = out.withColumn(f"w_{c}", weighted / (F.col("n") * (F.col("n") + 1) / 2))
    duration = F.least(F.lit(1.0), (F.col("turn") - F.col("start")) / F.greatest(F.lit(1.0), F.lit(baseline * 0.7 * 2)))
    out = out.withColumn("duration", duration)
    a, v, r, d = WEIGHTS
    composite = T.clamp01(a * F.col("w_affect") + v * F.col("w_volatility") + r * F.col("w_rigor") + d * F.col("duration"))
    out = out.withColumn("composite", composite).withColumn("severity", severity(F.col("composite"), F.col("mode")))
    damp = F.when(F.col("severity") == "low", "none").otherwise(F.col("severity"))
    return out.select(
        "session", "turn", F.col("w_affect").alias("affect"), F.col("w_volatility").alias("volatility"), F.col("w_rigor").alias("rigor"), "duration", "composite", "severity",
        damp.alias("dampening"), F.col("n").alias("window"),
    )


def drift_reason(assessed: DataFrame) -> DataFrame:
    """The two greatest signals of each assessment, as ``name value`` joined by commas."""
    signal = F.array(*[F.struct((-F.col(c)).alias("v"), F.lit(c).alias("name")) for c in ("affect", "volatility", "rigor", "duration")])
    top = F.slice(F.array_sort(signal), 1, 2)
    return assessed.withColumn("reason", F.array_join(F.transform(top, lambda x: x["name"]), ","))


def smoothed(values: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(session, turn, now, smoothed): s = alpha * now + (1 - alpha) * s before, beginning with now.

    A fold along each session's turns; the array of a session is bounded by its turns.
    """
    rows = values.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("turn", "now"))).alias("rows"))
    empty = F.array().cast("array<struct<turn:long,now:double,smoothed:double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)["smoothed"]
        s = F.when(F.size(acc) == 0, x["now"]).otherwise(alpha * x["now"] + (1 - alpha) * last)
        return F.concat(acc, F.array(F.struct(x["turn"].cast("long").alias("turn"), x["now"].cast("double").alias("now"), s.cast("double").alias("smoothed"))))

    folded = F.aggregate("rows", empty, lambda acc, x: F.when(F.size(acc) == 0, F.array(F.struct(x["turn"].cast("long").alias("turn"), x["now"].cast("double").alias("now"), x["now"].cast("double").alias("smoothed")))).otherwise(step(acc, x)))
    return rows.select("session", F.explode(folded).alias("r")).select("session", "r.turn", "r.now", "r.smoothed")


def decayed(weight: Column, turns: Column) -> Column:
    """Weight after so many turns, not below the floor."""
    return F.greatest(F.lit(FLOOR), weight * F.pow(F.lit(DECAY), turns))


def pair_exchanges(messages: DataFrame) -> DataFrame:
    """(chat, user_turn, assistant_turn): a user message with the assistant's right after it, either alone otherwise."""
    part = W.partitionBy("chat").orderBy("turn")
    m = messages.where(F.col("role").isin("user", "assistant"))
    m = m.withColumn("next_role", F.lead("role").over(part)).withColumn("next_turn", F.lead("turn").over(part)).withColumn("before", F.lag("role").over(part))
    users = m.where("role = 'user'").select("chat", F.col("turn").alias("user_turn"), F.when(F.col("next_role") == "assistant", F.col("next_turn")).alias("assistant_turn"))
    orphans = m.where("role = 'assistant' AND coalesce(before, '') <> 'user'").select("chat", F.lit(None).cast("long").alias("user_turn"), F.col("turn").alias("assistant_turn"))
    pairs = users.unionByName(orphans)
    order = W.partitionBy("chat").orderBy(F.coalesce("user_turn", "assistant_turn"))
    return pairs.withColumn("pair", F.row_number().over(order) - 1)


def chunk_pairs(pairs: DataFrame, size: int = 4) -> DataFrame:
    """(chat, start, pairs...): windows of ``size`` pairs, each beginning half a window after the last; short tails stay.

    A pair joins the windows that hold it by arithmetic on its number, not by a range join.
    """
    step = max(1, size // 2)
    starts = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (F.col("pair") >= k) & ((F.col("pair") - k) % step == 0))
    return pairs.withColumn("start", F.explode(F.transform(starts, lambda k: F.col("pair") - k)))


def sequence_edges(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(group..., src, dst): each row and the one after it."""
    nxt = F.lead("id").over(W.partitionBy(*group).orderBy(*order))
    return rows.withColumn("dst", nxt).where("dst IS NOT NULL").select(*group, F.col("id").alias("src"), "dst")


def streaks(rows: DataFrame, group: str, order: str, hit: str) -> DataFrame:
    """Rows with ``streak``, the number of hits in a row up to this one; a row without one starts anew."""
    part = W.partitionBy(group).orderBy(order)
    island = F.sum(F.when(F.col(hit), 0).otherwise(1)).over(part)
    marked = rows.withColumn("__island", island)
    return marked.withColumn("streak", F.sum(F.col(hit).cast("int")).over(W.partitionBy(group, "__island").orderBy(order))).drop("__island")


def with_cooldown(turns: Column, wants: Column, gap: int) -> Column:
    """Turns at which it fires: those that want to, at least ``gap`` after the last that fired.

    ``turns`` and ``wants`` are ordered arrays of one session; the decision depends on earlier ones, so it is a fold.
    """
    both = F.zip_with(turns, wants, lambda t, w: F.struct(t.alias("turn"), w.alias("want")))
    empty = F.array().cast("array<long>")

    def step(acc: Column, x: Column) -> Column:
        free = (F.size(acc) == 0) | (x["turn"] - F.element_at(acc, -1) >= gap)
        return F.when(x["want"] & F.when(F.size(acc) == 0, True).otherwise(free), F.concat(acc, F.array(x["turn"].cast("long")))).otherwise(acc)

    return F.aggregate(both, empty, step)


def trajectory(drafts: DataFrame, final: Column, grace: int = 3, keep: float = 0.4) -> DataFrame:
    """Verdict of each draft by its references and peak salience.

    Two references confirm it; none is untouched, or too fresh within the grace turns; one is kept at a
    peak of ``keep`` or more, else dropped.
    """
    n = F.col("references")
    verdict = (
        F.when(n >= 2, "CONFIRMED")
        .when((n == 0) & (final - F.col("raised") < grace), "FRESH")
        .when(n == 0, "UNTOUCHED")
        .when(F.col("peak") >= keep, "AMBIGUOUS_KEEP")
        .otherwise("AMBIGUOUS_DROP")
    )
    return drafts.withColumn("verdict", verdict)
