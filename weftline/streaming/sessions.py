"""Stateful streams of sessions: drift, and appended event logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.windows import BASELINE, THRESHOLDS, WEIGHTS, WINDOW

OUTPUT = "session long, turn long, affect double, volatility double, rigor double, duration double, composite double, severity string, window int"
STATE = "start long, affect array<double>, volatility array<double>, rigor array<double>"


def assess(history: list[tuple[float, float, float]], start: int, turn: int, mode: str, baseline: float = BASELINE) -> dict:
    """One assessment from the last rows of a session: the batch operator's arithmetic."""
    n = len(history)
    total = n * (n + 1) / 2
    signals = [sum(x * i for i, x in enumerate(col, 1)) / total for col in zip(*history, strict=True)]
    duration = min(1.0, (turn - start) / max(1.0, baseline * 0.7 * 2))
    composite = max(0.0, min(1.0, sum(w * s for w, s in zip(WEIGHTS, [*signals, duration], strict=True))))
    low, medium = THRESHOLDS["internal" if mode == "internal" else "external"]
    severity = "low" if composite <= low else "medium" if composite <= medium else "high"
    return {"turn": turn, "affect": signals[0], "volatility": signals[1], "rigor": signals[2], "duration": duration, "composite": composite, "severity": severity, "window": n}


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, idle: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    start, *columns = state.get if state.exists else (None, [], [], [])
    history = list(zip(*columns, strict=True))
    rows = pd.concat(list(frames)).sort_values("turn")
    out = []
    for r in rows.itertuples():
        start = r.turn if start is None else start
        history = [*history, (r.affect, r.volatility, r.rigor)][-WINDOW:]
        out.append({"session": key[0], **assess(history, int(start), int(r.turn), r.mode)})
    state.update((int(start), *[[float(h[k]) for h in history] for k in range(3)]))
    if idle is not None:
        state.setTimeoutDuration(idle)
    yield pd.DataFrame(out)


def drift_stream(signals: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Assessments of a stream ``(session, turn, affect, volatility, rigor, mode)``; the state is a session's last 50 rows.

    A continuous stream should name ``idle_ms``, after which a session without rows is forgotten, so that states do not gather for ever;
    a run over what there is leaves it out, as a stream with such a limit has always one more batch to do.

    Rows of a batch are taken in order of their turn; a turn that comes in a later batch counts as later.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _step(key, frames, state, idle_ms)

    return signals.groupBy("session").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def append_log(stream: DataFrame, path: str, checkpoint: str, topic: str = "topic"):
    """Starts appending a stream of events to Parquet, a folder for each topic; it ends when all input is read."""
    return stream.writeStream.format("parquet").partitionBy(topic).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, spark, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all available input into Parquet, and reads it."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def after_completion(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, limit_s: int = 600) -> bool:
    """Hands the events that a stream holds now to ``handle(batch, number)``, once each; returns whether it ended within the limit.

    The checkpoint remembers what was handled, so that a later call, or one after a failure, goes on behind it.
    """
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    ended = query.awaitTermination(limit_s)
    if not ended:
        query.stop()
    return bool(ended)


def phase_history(events: DataFrame) -> DataFrame:
    """(job, phase, began, ended, done, total, current) of ``events(job, at, phase, done, total)``: a row for each phase of a job.

    A phase ends where the next one begins; the one that began last is current. Counters never go back.
    """
    each = events.groupBy("job", "phase").agg(F.min("at").alias("began"), F.max("done").alias("done"), F.max("total").alias("total"))
    order = W.partitionBy("job").orderBy("began", "phase")
    return each.withColumn("ended", F.lead("began").over(order)).select("job", "phase", "began", "ended", "done", "total", F.col("ended").isNull().alias("current"))
