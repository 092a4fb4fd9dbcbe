"""Typed export of scored predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.functions.semantics import js_round
from viaduct.operators.evaluate import export_horizon


# The features in a prediction's JSON, their columns and types, and the value of a missing one.
FEATURES = (
    ("anchorKind", "f_anchor_kind", "string", None), ("anchorEpoch", "f_anchor_epoch", "long", None), ("remainingSegments", "f_remaining_segments", "int", 0), ("statsCoverage", "f_stats_coverage", "double", 0),
    ("corridorAdjustSec", "f_corridor_adjust_sec", "int", 0), ("operatorWeight", "f_operator_weight", "double", 0), ("independentP50", "f_independent_p50", "long", None), ("originDepDelaySec", "f_origin_dep_delay_sec", "int", None),
    ("trainHistoryDelaySec", "f_train_history_delay_sec", "int", None), ("networkDelaySec", "f_network_delay_sec", "int", None), ("operatorEtaDriftSec", "f_operator_eta_drift_sec", "int", None), ("alertsRun24h", "f_alerts_run_24h", "int", None),
    ("alertsRoute24h", "f_alerts_route_24h", "int", None), ("precipMm", "f_precip_mm", "double", None), ("strikeActive", "f_strike_active", "int", None), ("eventHoursToStart", "f_event_hours_to_start", "double", None), ("holiday", "f_holiday", "int", None),
    ("upstreamStopMaxDelaySec", "f_upstream_stop_max_delay_sec", "int", None), ("upstreamStopDelayedCount", "f_upstream_stop_delayed_count", "int", None), ("routeEncSec", "f_route_enc_sec", "double", None), ("etaAccelSec", "f_eta_accel_sec", "double", None),
)


def feature_number(json: Column, name: str, default: float | None = None) -> Column:
    """A number of a features object; text, booleans, missing keys and broken JSON are null or the default."""
    return _number(F.from_json(json, f"`{name}` DOUBLE")[name], default)


def feature_int(json: Column, name: str) -> Column:
    return js_round(feature_number(json, name)).cast("long")


def _number(value: Column, default: float | None) -> Column:
    value = F.when(F.abs(value) < float("inf"), value)  # neither infinite nor NaN
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def _text(json: Column, key: str, value: Column) -> Column:
    """The text of a feature; numbers, empty text and the like are null.

    A parser reads any scalar as text, so the sign after the key tells: quotes within texts are escaped.
    """
    return F.when(json.rlike(f'"{key}"\\s*:\\s*"') & (value != ""), value)


def features(json: Column) -> list[Column]:
    """The columns of ``FEATURES``, from one parse; a missing or wrongly typed feature is its default, broken JSON lacks all."""
    parsed = F.from_json(json, ", ".join(f"{key} {'STRING' if kind == 'string' else 'DOUBLE'}" for key, _, kind, _ in FEATURES), {"mode": "PERMISSIVE"})  # with an option, the fields are not parsed one by one
    made = []
    for key, column, kind, default in FEATURES:
        value = parsed[key]
        out = _text(json, key, value) if kind == "string" else _number(value, default) if kind == "double" else js_round(_number(value, default)).cast(kind)
        made.append(out.alias(column))
    return made


def export_rows(scored: DataFrame, runs: DataFrame) -> DataFrame:
    """One typed row for each scored prediction with features and a timetable, with its day and route to partition by."""
    scored = scored.where("features_json IS NOT NULL AND sched_arr_epoch IS NOT NULL")
    joined = scored.join(runs.select("run_id", "service_date", "train_number", "route_id", "operator"), "run_id")
    seconds = F.floor((F.col("sched_arr_epoch") - F.col("generated_at")) / 1000).cast("int")
    return joined.select(
        "service_date", "train_number", "operator", F.col("route_id").alias("line"), "run_id", "prediction_id", "stop_id", "model_version", "generated_at", seconds.alias("horizon_sec"), export_horizon(seconds).alias("horizon_bucket"),
        "sched_arr_epoch", "operator_eta_epoch", "our_p10", "our_p50", "our_p90", "confidence", "actual_arr_epoch", F.col("operator_error_sec").cast("int"), F.col("our_error_sec").cast("int"), *features(F.col("features_json")),
    )


def write_export(rows: DataFrame, folder: str, per_file: int = 100_000, by_line: bool = False) -> None:
    """Hive layout by day, and by line within it on request; files of at most ``per_file`` rows.

    Days are brought together in one shuffle, which Spark rebalances: a day larger than a partition should be
    is written by several tasks, small days share one.
    """
    layout = ["service_date", *(["line"] if by_line else [])]
    rows.hint("rebalance", F.col("service_date")).write.mode("overwrite").partitionBy(*layout).option("maxRecordsPerFile", per_file).option("compression", "gzip").parquet(folder)


def _hashed(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with 128 bits of hash in parts that can be summed (_h0 to _h3) and one of ``buckets`` (_b).

    Hashes pass over nulls, so they cover which columns are null as well.
    """
    null = [F.col(c).isNull() for c in rows.columns]
    first, second = F.xxhash64(*rows.columns, *null), F.xxhash64(F.lit(1), *null, *rows.columns[::-1])
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    made = rows.withColumns({"_f": first, "_s": second})
    return made.withColumns({"_h0": low("_f"), "_h1": F.shiftright("_f", 32), "_h2": low("_s"), "_h3": F.shiftright("_s", 32), "_b": F.pmod("_f", F.lit(buckets))}).drop("_f", "_s")


def differences(a: DataFrame, b: DataFrame, buckets: int = 4096) -> DataFrame:
    """Rows that either side has more often than the other, and by how many: none after a true round trip.

    Rows are dealt into ``buckets`` by hash, and the sums of each bucket's hashes are compared, so no row is shuffled
    where both sides agree.  Buckets that differ are compared row by row, in one shuffle of both sides together.
    """
    b = b.select(*a.columns)
    left, right = _hashed(a, buckets), _hashed(b, buckets)
    parts = ["_h0", "_h1", "_h2", "_h3"]
    told = lambda rows, sign: rows.groupBy("_b").agg(F.count("*").alias("_n"), *[F.sum(h).alias(h) for h in parts]).select("_b", *[(F.col(c) * sign).alias(c) for c in ("_n", *parts)])
    sums = told(left, 1).unionByName(told(right, -1)).groupBy("_b").agg(*[F.sum(c).alias(c) for c in ("_n", *parts)])
    odd = [r[0] for r in sums.where(" OR ".join(f"{c} <> 0" for c in ("_n", *parts))).select("_b").collect()]  # at most ``buckets`` numbers
    suspect = lambda rows: rows.where(F.col("_b").isin(odd)).select(*a.columns)
    both = suspect(left).withColumn("more", F.lit(1)).unionByName(suspect(right).withColumn("more", F.lit(-1)))
    counted = both.groupBy(*a.columns).agg(F.sum("more").alias("more")).where("more <> 0")
    return counted.withColumn("side", F.when(F.col("more") > 0, "left").otherwise("right")).withColumn("more", F.abs("more"))
