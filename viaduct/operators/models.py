"""Arrival models: the heuristic, feature rows, ridge and quantile fits, boosted trees, residual correction and gates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.semantics import clamp, is_peak, js_round, rome_hour

DWELL_SEC = 45


def heuristic(events: DataFrame, stats: DataFrame, corridors: DataFrame, operator: DataFrame) -> DataFrame:
    """Arrival of each run at its last stop.

    events: run_id, stop_sequence, stop_id, sched_*_epoch and the actual times known by then; stats:
    segment_id, p10, p50 and p90 runtime; corridors: segment_id, corridor_delta; operator: run_id,
    operator_eta_epoch, stale.  The remaining segments are added to the last known time (or the
    timetable), then blended with the operator's estimate by how much history covers them.
    """
    w = Window.partitionBy("run_id")
    order = w.orderBy("stop_sequence")
    seen = F.coalesce("actual_dep_epoch", "actual_arr_epoch")
    at = F.max(F.when(seen.isNotNull(), F.struct("stop_sequence", seen.alias("epoch"), F.when(F.col("actual_dep_epoch").isNull(), DWELL_SEC).otherwise(0).alias("dwell")))).over(w)
    e = events.select("run_id", "stop_sequence", F.concat_ws(">", "stop_id", F.lead("stop_id").over(order)).alias("segment_id"), ((F.lead("sched_arr_epoch").over(order) - F.col("sched_dep_epoch")) / 1000).alias("sched"), at.alias("at"), F.min("sched_dep_epoch").over(w).alias("start"))
    left = e.where("sched IS NOT NULL AND stop_sequence >= coalesce(at.stop_sequence, 0)")
    j = left.join(stats, "segment_id", "left").join(corridors.select("segment_id", "corridor_delta"), "segment_id", "left")
    known = F.col("p50_runtime").isNotNull()
    seconds = F.greatest(F.lit(30), F.coalesce("p50_runtime", "sched") + F.coalesce("corridor_delta", F.lit(0)))
    spread = F.when(known, F.greatest(F.lit(20), (F.col("p90_runtime") - F.col("p10_runtime")) / 2)).otherwise(F.greatest(F.lit(45), 0.25 * F.col("sched")))
    g = j.groupBy("run_id").agg(F.first(F.coalesce("at.epoch", "start")).alias("anchor"), F.first(F.coalesce("at.dwell", F.lit(0))).alias("dwell"), F.sum(seconds).alias("secs"), F.sum(spread * spread).alias("sq"), F.avg(known.cast("double")).alias("coverage"), F.count("*").alias("segments"))
    g = g.join(operator, "run_id", "left").withColumn("own", F.col("anchor") + (F.col("dwell") + F.col("secs")) * 1000)
    base = F.when(F.col("stale"), 0.45).otherwise(0.65)
    weight = F.when(F.col("operator_eta_epoch").isNull(), 0.0).when(F.col("coverage") < 0.34, F.greatest(base, F.lit(0.8))).when(F.col("coverage") >= 0.67, F.least(base, F.lit(0.55))).otherwise(base)
    g = g.withColumn("weight", weight).withColumn("p50", js_round(F.coalesce(F.col("weight") * F.col("operator_eta_epoch") + (1 - F.col("weight")) * F.col("own"), F.col("own"))))
    band = F.least(F.lit(900.0), F.sqrt("sq") + 40) * 1000
    return g.select("run_id", "segments", F.round("coverage", 6).alias("coverage"), "weight", js_round(F.col("p50") - 0.8 * band).alias("p10"), "p50", js_round(F.col("p50") + 1.2 * band).alias("p90"))


# Name, input column (seconds or counts), bound, scale, default.
BOUNDED = (
    ("operatorDelay", "operator_delay", 1800, 600, 0), ("ourDelay", "our_delay", 1800, 600, 0), ("independentDelay", "independent_delay", 1800, 600, 0),
    ("corridorAdjust", "corridor_adjust", 600, 300, 0), ("originDepDelay", "origin_delay", 1800, 600, 0), ("trainHistoryDelay", "history_delay", 1800, 600, 0),
    ("networkDelay", "network_delay", 900, 300, 0), ("etaDrift", "eta_drift", 600, 300, 0), ("alertsRun", "alerts_run", 10, 5, 0), ("alertsRoute", "alerts_route", 10, 5, 0),
    ("precip", "precip_mm", 10, 5, 0), ("eventHours", "event_hours", 24, 24, 24), ("upstreamMaxDelay", "upstream_max", 1800, 600, 0), ("upstreamDelayed", "upstream_delayed", 10, 5, 0),
    ("routeEnc", "route_enc", 600, 300, 0), ("etaAccel", "eta_accel", 1200, 600, 0), ("sourceSpread", "source_spread", 1800, 600, 0),
)
PLAIN = (("operatorWeight", "operator_weight"), ("statsCoverage", "stats_coverage"), ("strikeActive", "strike_active"), ("holiday", "holiday"))
NAMES = ("bias", "logHorizon", "operatorDelay", "ourDelay", "independentDelay", "operatorWeight", "statsCoverage", "logSegments", "corridorAdjust", "anchorActual", "anchorNone", "hourSin", "hourCos", "peak", "originDepDelay", "trainHistoryDelay", "networkDelay", "etaDrift", "alertsRun", "alertsRoute", "precip", "strikeActive", "eventHours", "holiday", "upstreamMaxDelay", "upstreamDelayed", "routeEnc", "etaAccel", "sourceSpread")


def feature_row(rows: DataFrame) -> list[Column]:
    """The model's features, in order; an input column that the frame lacks counts as null, hence as its default."""
    has = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(float(default))) if c in rows.columns else F.lit(float(default))
    made = {name: clamp(has(c, default), -float(bound), float(bound)) / scale for name, c, bound, scale, default in BOUNDED} | {name: has(c, 0) for name, c in PLAIN}
    horizon = F.coalesce(F.greatest(F.lit(0.0), (F.col("sched_arr_epoch") - F.col("generated_at")) / 1000), F.lit(1800.0))
    rome = rome_hour(F.col("generated_at"))
    hour = F.when(rome == 0, 12).otherwise(rome)
    anchor = F.col("anchor_kind") if "anchor_kind" in rows.columns else F.lit(None).cast("string")
    made |= {
        "bias": F.lit(1.0), "logHorizon": F.log1p(horizon) / 8, "logSegments": F.log1p(has("remaining_segments", 0)) / 3,
        "anchorActual": F.coalesce(anchor.isin("actual_dep", "actual_arr"), F.lit(False)).cast("double"), "anchorNone": anchor.isNull().cast("double"),
        "hourSin": F.sin(2 * math.pi * hour / 24), "hourCos": F.cos(2 * math.pi * hour / 24), "peak": (hour.isin(7, 8) | hour.between(16, 18)).cast("double"),
    }
    return [made[name].alias(name) for name in NAMES]


#: Features of a change between trains.
CONNECTION = ("slack", "arrivalDelay", "departureDelay", "hourSin", "hourCos", "peak")


def connection_row(slack: Column, arrival_delay: Column, departure_delay: Column, hour: Column) -> list[Column]:
    """The features of CONNECTION; an unknown delay of the second train counts as none, hour 0 as noon."""
    at = F.when(hour == 0, 12).otherwise(hour)
    made = [
        F.greatest(F.lit(0.0), F.least(slack.cast("double"), F.lit(1800.0))) / 300, clamp(arrival_delay.cast("double"), -900.0, 900.0) / 300,
        clamp(F.coalesce(departure_delay, F.lit(0)).cast("double"), -900.0, 900.0) / 300, F.sin(2 * math.pi * at / 24), F.cos(2 * math.pi * at / 24), is_peak(at).cast("double"),
    ]
    return [c.alias(name) for c, name in zip(made, CONNECTION, strict=True)]


def ridge(rows: DataFrame, features: Sequence[str], target: str, strength: float = 1.0) -> dict[str, float]:
    """Ridge regression from one pass: every task sums its rows' products, the driver solves one small system.

    The bias is shrunk like the rest.  Rows with a null are left out; no rows give zeros.
    """
    size = len(features)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            x = batch.to_numpy(float)
            total += x.T @ x
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    wanted = rows.select(*[F.col(c).cast("double") for c in (*features, target)]).dropna()
    sums = wanted.mapInPandas(products, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # (features + 1) squared rows
    total = np.zeros((size + 1) ** 2)
    for row in sums:
        total[row["at"]] = row["v"]
    total = total.reshape(size + 1, size + 1)
    return dict(zip(features, map(float, np.linalg.solve(total[:size, :size] + strength * np.eye(size), total[:size, size])), strict=True))


def linear(weights: dict[str, float]) -> Column:
    """The weighted sum of the features."""
    return sum((F.col(c) * F.lit(v) for c, v in weights.items()), F.lit(0.0))


def pinball(rows: DataFrame, features: Sequence[str], target: str, quantile: float, epochs: int = 500, rate: float = 0.05, sample_rows: int = 100_000) -> dict[str, float]:
    """Linear quantile regression by full-batch sub-gradients.

    The first feature must be the constant; it starts at the empirical quantile.  All epochs run in one
    task over at most ``sample_rows`` rows, those with the smallest hashes; fewer rows are all used.
    Rows with a null are left out.
    """
    names = [*features, target]
    wanted = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    sample = wanted.orderBy(F.xxhash64(*names), *names).limit(sample_rows)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[list(features)].to_numpy(), frame[target].to_numpy()
        weights = np.zeros(len(features))
        weights[0] = np.quantile(y, quantile)
        for _ in range(epochs):
            weights += rate * (np.where(y > x @ weights, quantile, quantile - 1.0) @ x) / len(y)
        return pd.DataFrame({"weights": [weights.tolist()]})

    found = sample.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(fit, "weights array<double>").first()
    return dict(zip(features, found[0] if found else [0.0] * len(features), strict=True))


def forest(trees: Sequence[tuple], rate: float, start: float = 0.0) -> Column:
    """Prediction of given trees, each a number or (feature, threshold, tree if at most, tree if above)."""
    walk = lambda t: F.when(F.col(t[0]) <= t[1], walk(t[2])).otherwise(walk(t[3])) if isinstance(t, tuple) else F.lit(float(t))
    return sum((walk(t) * rate for t in trees), F.lit(start))


def corrected(p50: Column, correction_sec: Column, offset_sec: Column) -> list[Column]:
    """Quantiles after a learned correction, with a band of at least 30 seconds to either side."""
    moved, half = p50 + correction_sec * 1000, F.greatest(offset_sec * 1000, F.lit(30_000))
    return [js_round(moved - half).alias("p10"), js_round(moved).alias("p50"), js_round(moved + half).alias("p90"), js_round((moved - p50) / 1000).alias("correction_sec")]


def gate(rows: DataFrame, before: str, after: str, inside: Column, least_gain: float = 0.5, least_coverage: float = 0.75) -> DataFrame:
    """Whether a model may be deployed: its error must fall by more than ``least_gain`` seconds and its band hold."""
    g = rows.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(before)), 4).alias("mae_before"), F.round(F.avg(F.abs(after)), 4).alias("mae_after"), F.round(F.avg(inside.cast("double")), 4).alias("coverage"))
    return g.withColumn("deploy", F.coalesce((F.col("mae_before") - F.col("mae_after") > least_gain) & (F.col("coverage") >= least_coverage), F.lit(False)))
