"""Structured Streaming forms of the live operators; batch and stream share the same columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from viaduct.functions.semantics import Step, fold_sorted


def coverage(obs: DataFrame, late: str = "1 hour", width: str = "15 minutes") -> DataFrame:
    """Observations of each source in tumbling windows; ``obs`` has ts (epoch ms) and source."""
    rows = obs.withColumn("at", F.timestamp_millis("ts"))
    rows = rows.withWatermark("at", late) if obs.isStreaming else rows
    return rows.groupBy(F.window("at", width), "source").agg(F.count("*").alias("n")).select(F.unix_millis("window.start").alias("bucket"), "source", "n")


def first_seen(obs: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Drops repeats of the same keys; the watermark bounds the state."""
    if not obs.isStreaming:
        return obs.dropDuplicates(keys)
    return obs.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys).drop("at")


def sliding(obs: DataFrame, late: str = "1 hour", length: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """(since, until, source, n, mean_delay): delays of each source in overlapping windows."""
    rows = _timed(obs, late)
    out = rows.groupBy(F.window("at", length, slide), "source").agg(F.count("delay_seconds").alias("n"), F.round(F.avg("delay_seconds"), 4).alias("mean_delay"))
    return out.select(F.unix_millis("window.start").alias("since"), F.unix_millis("window.end").alias("until"), "source", "n", "mean_delay")


def sessions(obs: DataFrame, late: str = "1 hour", gap: str = "15 minutes") -> DataFrame:
    """(run_id, since, until, n): visits of a run, which end once nothing was heard of it for ``gap``.

    Session windows that touch are merged, so they are a millisecond, the unit of ``ts``, shorter.
    """
    rows = _timed(obs, late)
    out = rows.groupBy(F.session_window("at", f"{gap} -1 milliseconds"), "run_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return out.select("run_id", F.unix_millis("session_window.start").alias("since"), F.col("last_ts").alias("until"), "n")


def outcomes(predictions: DataFrame, arrivals: DataFrame, late: str = "1 hour", within: str = "6 hours") -> DataFrame:
    """Predictions (prediction_id, run_id, stop_id, generated_at, our_p50, operator_eta) with the arrival
    (run_id, stop_id, actual_arr_epoch) that came after them, and both errors.

    Both sides may be streams: the time bound lets the join forget.
    """
    at = lambda df, c, name: df.withColumn(name, F.timestamp_millis(c)) if not df.isStreaming else df.withColumn(name, F.timestamp_millis(c)).withWatermark(name, late)
    p = at(predictions, "generated_at", "said_at")
    a = at(arrivals.select(F.col("run_id").alias("a_run"), F.col("stop_id").alias("a_stop"), "actual_arr_epoch"), "actual_arr_epoch", "came_at")
    met = p.join(a, F.expr(f"run_id = a_run AND stop_id = a_stop AND came_at >= said_at AND came_at <= said_at + interval {within}"))
    error = lambda c: F.floor((F.col("actual_arr_epoch") - F.col(c)) / 1000 + 0.5).cast("long")
    return met.select("prediction_id", "actual_arr_epoch", error("our_p50").alias("our_error_sec"), error("operator_eta").alias("operator_error_sec"))


def _timed(obs: DataFrame, late: str) -> DataFrame:
    rows = obs.withColumn("at", F.timestamp_millis("ts"))
    return rows.withWatermark("at", late) if obs.isStreaming else rows


def _none(value) -> int | None:
    return None if value is None or pd.isna(value) else int(value)


def folded(rows: DataFrame, key: str, step: Step, out: str, state: str, forget_ms: int = 86_400_000) -> DataFrame:
    """Folds each key's rows in the order of (ts, id); ``step`` takes the state and a row and gives the new
    state and what to emit, or None.

    A batch folds a key's sorted rows at once.  A stream keeps the state of a key between micro-batches
    and forgets it once nothing came for ``forget_ms``.
    """

    def fold(frame: pd.DataFrame, held: tuple | None) -> tuple[tuple | None, list[tuple]]:
        told = []
        for r in frame.sort_values(["ts", "id"]).itertuples(index=False):
            held, said = step(held, r)
            if said is not None:
                told.append(said)
        return held, told

    names = [part.split()[0] for part in out.split(", ")]
    if not rows.isStreaming:
        return fold_sorted(rows.select(key, *[c for c in rows.columns if c != key]), [key], ["ts", "id"], step, out)

    def run(key_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        # One key's rows of one micro-batch; sources limit a micro-batch by maxFilesPerTrigger.
        new, told = fold(pd.concat(list(frames)), held.get if held.exists else None)
        if new is not None:
            held.update(new)
            held.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(told, columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def throttled(rows: DataFrame, move_ms: int = 30_000, wait_ms: int = 120_000) -> DataFrame:
    """Of the estimates (run_id, ts, id, p50, operator_eta) of each run those that moved, are unknown or are
    due since the last kept one."""

    def step(last: tuple | None, r) -> tuple[tuple | None, tuple | None]:
        p50, eta = _none(r.p50), _none(r.operator_eta)
        if last is not None:
            moved = any(a is None or b is None or abs(a - b) > move_ms for a, b in ((p50, _none(last[1])), (eta, _none(last[2]))))
            if not moved and r.ts - last[0] <= wait_ms:
                return last, None
        return (int(r.ts), p50, eta), (int(r.run_id), int(r.id))

    return folded(rows.select("run_id", "ts", "id", "p50", "operator_eta"), "run_id", step, "run_id long, id long", "ts long, p50 long, eta long")


def flagged(rows: DataFrame) -> DataFrame:
    """(id, flags) of every observation, late ones too: out of order, delay jumps, stale; none is dropped.

    ``rows`` has run_id, source, ts, id, observed_at and delay_seconds.  Order and jump compare with the
    last known value of the same run and source.
    """

    def step(last: tuple | None, r) -> tuple[tuple | None, tuple | None]:
        seen, delay = (None, None) if last is None else map(_none, last)
        mine, late = _none(r.observed_at), _none(r.delay_seconds)
        flags = []
        if seen is not None and mine is not None and seen - mine >= 1000:
            flags.append("OUT_OF_ORDER")
        if delay is not None and late is not None and abs(late - delay) > 3600:
            flags.append("DELAY_JUMP")
        if mine is not None and r.ts - mine > 600_000:
            flags.append("STALE_SOURCE")
        return (seen if mine is None else mine, delay if late is None else late), (int(r.id), ",".join(flags))

    keyed = rows.select(F.concat_ws("/", F.col("run_id").cast("string"), "source").alias("key"), "ts", "id", "observed_at", "delay_seconds")
    return folded(keyed, "key", step, "id long, flags string", "seen long, delay long")


def pushes(rows: DataFrame, move_ms: int = 120_000, gap_ms: int = 600_000) -> DataFrame:
    """(watch, id, kind): what a traveller is told of a watched run, at most once in ``gap_ms``.

    ``rows`` has watch, ts, id, status, p50 and risk.  A cancellation and a risk are told once, an
    estimate when it moved by more than ``move_ms`` from the one told last; the first estimate seen
    is not told but moves are measured from it.
    """

    def step(last: tuple | None, r) -> tuple[tuple | None, tuple | None]:
        eta, cancelled, risk, at = (None, False, False, None) if last is None else (_none(last[0]), bool(last[1]), bool(last[2]), _none(last[3]))
        p50, kind = _none(r.p50), None
        if at is not None and r.ts - at < gap_ms:
            return last, None
        if r.status == "cancelled" and not cancelled:
            kind = "cancelled"
        elif p50 is not None and eta is not None and abs(p50 - eta) > move_ms:
            kind = "eta"
        elif r.risk and not risk:
            kind = "risk"
        if kind is None:
            return (p50 if eta is None else eta, cancelled, risk, at), None
        return (eta if p50 is None else p50, cancelled or kind == "cancelled", risk or kind == "risk", int(r.ts)), (r.watch, int(r.id), kind)

    return folded(rows.select("watch", "ts", "id", "status", "p50", "risk"), "watch", step, "watch string, id long, kind string", "eta long, cancelled boolean, risk boolean, at long")
