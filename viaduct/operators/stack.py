"""The residual model: ridge or boosted trees, blended with a model of the state at the last stop, with bands."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.functions.semantics import js_round
from viaduct.operators import boosting as bs
from viaduct.operators import models as md

# The largest correction, the rounds of both forests, rows that a model of stops needs, the edges
# of the horizons, the share that a band holds and its least and usual half width, and what the gate asks.
LIMIT, ROUNDS, STOP_ROUNDS, LEAST_STOPS = 1200.0, 150, 120, 5000
EDGES, SHARE, LEAST_BAND, USUAL_BAND = (300, 900, 1800, 3600), 0.9, 60, 120
LEAST_GAIN, LEAST_COVERAGE = 0.5, 0.75
WEIGHTS = tuple(k / 10 for k in range(11))


@dataclass
class Residual:
    """A fitted model; ``weight`` is None without a model of stops, ``bands`` the half width of each horizon."""

    features: list[str]
    ridge: dict[str, float]
    forest: bs.Forest
    method: str = "ridge"
    stop: bs.Forest | None = None
    weight: float | None = None
    bands: dict[int, int] = field(default_factory=dict)
    told: dict[str, float | int | str | bool | None] = field(default_factory=dict)


def stop_features(features: Sequence[str]) -> list[str]:
    """Names of the columns that hold a prediction's features as of the operator's estimate."""
    return [f"at_stop_{c}" for c in features]


def with_stop_features(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds :func:`stop_features`: as a row at a stop, the operator's delay stands for both own estimates."""
    state = F.coalesce("operator_delay", "our_delay")
    there = {"our_delay": state, "independent_delay": F.coalesce("operator_delay", "independent_delay") if "independent_delay" in rows.columns else state}
    own = {c: f"_own_{c}" for c in there if c in rows.columns}
    made = rows.withColumns({kept: F.col(c) for c, kept in own.items()}).withColumns(there)
    wanted = dict(zip(md.NAMES, md.feature_row(made), strict=True))
    return made.select(*[F.col(own.get(c, c)).alias(c) for c in rows.columns], *[wanted[f].alias(f"at_stop_{f}") for f in features])


def _clipped(c: Column) -> Column:
    return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c))


def _blend(own: Column, stop: Column, weight: float) -> Column:
    """Correction in seconds of the weighted mean of both estimates."""
    other = (F.col("sched_arr_epoch") + stop * 1000 - F.col("our_p50")) / 1000
    return F.when(F.col("sched_arr_epoch").isNull(), own).otherwise(weight * own + (1 - weight) * other)


def _horizon() -> Column:
    """The edge of a prediction's horizon; the last one beyond all edges."""
    sec = F.coalesce(F.greatest(F.lit(0.0), (F.col("sched_arr_epoch") - F.col("generated_at")) / 1000), F.lit(1800.0))
    out = F.lit(EDGES[-1])
    for edge in reversed(EDGES):
        out = F.when(sec <= edge, edge).otherwise(out)
    return out


def scored(rows: DataFrame, model: Residual) -> DataFrame:
    """``rows`` with the corrections that the model's parts give, in seconds: _ridge, _gbm and _stop."""
    out = bs.predicted(rows, model.features, {"_gbm": model.forest}).withColumn("_ridge", md.linear(model.ridge))
    out = out.withColumns({"_gbm": _clipped(F.col("_gbm")), "_ridge": _clipped(F.col("_ridge"))})
    return bs.predicted(out, stop_features(model.features), {"_stop": model.stop}) if model.stop else out.withColumn("_stop", F.lit(None).cast("double"))


def correction(model: Residual) -> Column:
    """The final correction of :func:`scored` rows."""
    own = F.col("_gbm" if model.method == "gbm" else "_ridge")
    return own if model.weight is None else _blend(own, F.col("_stop"), model.weight)


def fit(learn: DataFrame, judge: DataFrame, stops: DataFrame | None, features: Sequence[str], rounds: int = ROUNDS, stop_rounds: int = STOP_ROUNDS, least_stops: int = LEAST_STOPS) -> Residual:
    """Learns from ``learn`` and decides on ``judge``; ``told`` says what was found.

    Rows have the features, those of :func:`with_stop_features`, ``residual`` (seconds that our_p50 was early),
    operator_error_sec, our_p10, our_p50, our_p90, sched_arr_epoch and generated_at; ``stops`` has the features
    and ``label_sec``, the final delay.

    Ridge or trees: whichever errs less on ``judge``.  The weight against the model of stops is the best of
    eleven, the smallest of equal ones, all measured in one pass; it is kept only where it errs less than the
    method alone.  The truth is our_p50 and its residual, everything in seconds.  Bands are the quantile of the
    absolute errors of each horizon.  The model may be deployed if it errs less than no correction and its bands
    hold.
    """
    features = list(features)
    forest = bs.fit(learn, features[1:], [F.col("residual")], [bs.Setting(rounds)])[0]
    forest = bs.Forest(forest.base, forest.rate, forest.feature + 1, forest.threshold, forest.leaf)  # the constant comes first
    model = Residual(features, md.ridge(learn, features, "residual"), forest)
    if stops is not None:
        stops = stops.select("label_sec", *features).persist()  # read three times
        if stops.count() >= least_stops:
            s = bs.fit(stops, features[1:], [F.col("label_sec")], [bs.Setting(stop_rounds)])[0]
            model.stop = bs.Forest(s.base, s.rate, s.feature + 1, s.threshold, s.leaf)
        stops.unpersist()
    y = F.col("residual")
    rows = scored(judge, model).persist()
    off = lambda c: F.avg(F.abs(y - c))
    blends = [off(_blend(F.col(m), F.col("_stop"), w)).alias(f"{m}{k}") for m in ("_ridge", "_gbm") for k, w in enumerate(WEIGHTS)] if model.stop else []
    inside = (y >= (F.col("our_p10") - F.col("our_p50")) / 1000) & (y <= (F.col("our_p90") - F.col("our_p50")) / 1000)
    g = rows.agg(F.count("*").alias("n"), off(F.lit(0)).alias("heuristic"), F.avg(F.abs("operator_error_sec")).alias("operator"), off(F.col("_ridge")).alias("ridge"), off(F.col("_gbm")).alias("gbm"), F.avg(inside.cast("double")).alias("covered"), *blends).first()
    if g.gbm is not None and g.gbm < g.ridge:
        model.method = "gbm"
    alone = g[model.method]
    if model.stop and g.n:
        best = min(range(len(WEIGHTS)), key=lambda k: (g[f"_{model.method}{k}"], k))
        if g[f"_{model.method}{best}"] < alone:
            model.weight = WEIGHTS[best]
    rows2 = rows.withColumn("_left", F.abs(y - correction(model))).withColumn("_edge", _horizon())
    seen: dict[int, list[tuple[int, int]]] = {e: [] for e in EDGES}
    for r in rows2.where("_left IS NOT NULL").groupBy("_edge", js_round(F.col("_left")).cast("long").alias("sec")).count().collect():  # whole seconds of four horizons
        seen[r["_edge"]].append((r["sec"], r["count"]))
    for edge, counted in seen.items():
        n = sum(c for _, c in counted)
        at = min(n - 1, int(SHARE * n)) if n >= 50 else int(SHARE * max(n - 1, 0))
        band = USUAL_BAND
        for sec, c in sorted(counted):
            if at < c:
                band = sec
                break
            at -= c
        model.bands[edge] = max(LEAST_BAND, band)
    held = rows2.agg(F.avg("_left").alias("mae"), F.avg((F.col("_left") <= _band(model)).cast("double")).alias("coverage")).first()
    rows.unpersist()
    deploy = bool(g.n) and held.mae < g.heuristic - LEAST_GAIN and held.coverage >= LEAST_COVERAGE
    model.told = {"n": g.n, "method": model.method, "weight": model.weight, "mae_heuristic": g.heuristic, "mae_operator": g.operator, "mae_ridge": g.ridge, "mae_gbm": g.gbm, "mae_model": held.mae, "coverage_heuristic": g.covered, "coverage_model": held.coverage, "deploy": deploy}
    return model


def _band(model: Residual) -> Column:
    out = F.lit(USUAL_BAND)
    for edge, band in model.bands.items():
        out = F.when(_horizon() == edge, band).otherwise(out)
    return out


def applied(rows: DataFrame, model: Residual) -> DataFrame:
    """(prediction_id, p10, p50, p90, correction_sec): the corrected estimates with their bands."""
    s = scored(rows, model)
    return s.select("prediction_id", *md.corrected(F.col("our_p50"), correction(model), _band(model)))
