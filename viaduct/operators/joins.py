"""As-of, range and nearest joins, and the semi and anti joins of the serving views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.semantics import haversine_km


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], tie: str, tolerance: int | None = None) -> DataFrame:
    """Adds the ``values`` of the latest right row of the same keys at or before each left row.

    Of right rows at one instant the largest ``tie`` counts.  Older ones than ``tolerance`` give
    null.  Both sides share one shuffle and one sort by key and time; no pairs are formed.
    """
    carried = F.struct(F.col(right_time).alias("at"), *[F.col(v) for v in values])
    r = right.select(*keys, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), carried.alias("_found"))
    l = left.withColumn("_time", F.col(left_time)).withColumn("_side", F.lit(1))
    until = Window.partitionBy(*keys).orderBy("_time", "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_found", F.last("_found", ignorenulls=True).over(until)).where("_side = 1")
    recent = F.lit(True) if tolerance is None else F.col("_time") - F.col("_found.at") <= tolerance
    return both.select(*left.columns, *[F.when(recent, F.col(f"_found.{v}")).alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, low: int, high: int, how: str = "inner") -> DataFrame:
    """Rows with equal keys and right_time - left_time in [low, high].

    Time is cut into bins as wide as the range, so a left row meets at most three bins and a key
    with many rows is spread over as many tasks as it has bins.  ``how`` is inner or left_semi.
    Column names other than the keys must differ; repeated rows stay repeated.
    """
    width = max(high - low, 1)
    if how == "left_semi":  # right rows are dealt out, so a left row is met once however often it occurs
        l = left.withColumn("_bin", F.floor(F.col(left_time) / width))
        reach = F.sequence(F.floor((F.col(right_time) - high) / width), F.floor((F.col(right_time) - low) / width))
        r = right.where(F.col(right_time).isNotNull()).withColumn("_rbin", F.explode(reach)).withColumnsRenamed({k: f"_r_{k}" for k in keys})
        on = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_bin") == F.col("_rbin"), (F.col(right_time) - F.col(left_time)).between(low, high)]
        return l.join(r, on, how).drop("_bin")
    bins = F.sequence(F.floor((F.col(left_time) + low) / width), F.floor((F.col(left_time) + high) / width))
    l = left.withColumn("_bin", F.explode(bins))
    r = right.withColumn("_rbin", F.floor(F.col(right_time) / width)).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_bin") == F.col("_rbin"), (F.col(right_time) - F.col(left_time)).between(low, high)]
    return l.join(r, on, how).drop("_bin", "_rbin", *[f"_r_{k}" for k in keys])


def nearest_by_name(places: DataFrame, stops: DataFrame, name: str, limit_km: float) -> DataFrame:
    """The nearest stop of the same name key within ``limit_km`` of each place (ties: smaller stop_id)."""
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("stop_lat"), F.col("stop_lon"))
    joined = places.join(stops, name).withColumn("km", km).where(F.col("km") <= limit_km)
    best = joined.groupBy("place_id").agg(F.min(F.struct("km", "stop_id")).alias("b"))
    return best.select("place_id", F.col("b.stop_id").alias("stop_id"), F.col("b.km").alias("km"))


def resolve_runs(wanted: DataFrame, runs: DataFrame, tolerance_ms: int = 600_000) -> DataFrame:
    """run_id of each wanted (date, number, departure): the exact match, else the only one within the tolerance."""
    close = wanted.join(runs, ["service_date", "train_number"]).where(F.abs(F.col("sched_dep_epoch") - F.col("want_dep")) <= tolerance_ms)
    exact = F.min(F.when(F.col("sched_dep_epoch") == F.col("want_dep"), F.col("run_id")))
    found = close.groupBy("want_id").agg(F.coalesce(exact, F.when(F.min("run_id") == F.max("run_id"), F.min("run_id"))).alias("run_id"))
    return wanted.select("want_id").join(found, "want_id", "left")


def upper_median(values: Column) -> Column:
    """The element in the middle of an array, the upper of two."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def recent_median(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows_back: int, least: int) -> Column:
    """Upper median of the last ``rows_back`` values before each row, null if there are fewer than ``least``."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows_back, -1)
    held = F.collect_list(value).over(before)
    return F.when(F.size(held) >= least, upper_median(held))
