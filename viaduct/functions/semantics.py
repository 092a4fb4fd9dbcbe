"""Exact semantics that many operators share: rounding, quantiles, Rome time, geometry, as-of joins, folds."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROME = "Europe/Rome"


def js_round(x: Column) -> Column:
    """Half up towards plus infinity: -0.5 gives 0 and 2.5 gives 3."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null, which ``greatest`` and ``least`` alone would not keep."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def type7(x: Column, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(x, F.lit(q))


def floor_index(x: Column, q: float) -> Column:
    """The element of the sorted values at floor(n * q), the last one at most."""
    xs = F.array_sort(F.collect_list(x))
    at = F.least(F.size(xs) - 1, F.floor(F.size(xs) * F.lit(q)).cast("int")) + 1
    return F.when(F.size(xs) > 0, F.element_at(xs, at))


def upper_median(x: Column) -> Column:
    return floor_index(x, 0.5)


def quantile_list(xs: Column, q: float) -> Column:
    """:func:`floor_index` of an array."""
    s = F.array_sort(xs)
    return F.when(F.size(s) > 0, F.element_at(s, F.least(F.size(s) - 1, F.floor(F.size(s) * F.lit(q)).cast("int")) + 1))


def running_counts(rows: DataFrame, keys: Sequence[str], value: Column, buckets: int = 256) -> DataFrame:
    """(keys, v, n, below, total): for each distinct value how many rows have it, a smaller one, any.

    Equal values are summed first; running sums go over the values of one of ``buckets`` ranges and
    then over the ranges, so no task holds a group's rows, however few groups there are.
    """
    tied = rows.select(*keys, value.alias("v")).where("v IS NOT NULL").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    edges = tied.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    placed = tied.join(edges, same).drop(*[f"_{k}" for k in keys])
    spread = F.col("hi").cast("double") - F.col("lo").cast("double")
    at = F.when(spread > 0, F.floor((F.col("v").cast("double") - F.col("lo").cast("double")) / spread * buckets)).otherwise(0)
    placed = placed.withColumn("_b", F.least(F.lit(buckets - 1), at))
    inside = Window.partitionBy(*keys, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(*keys, "_b").agg(F.sum("n").alias("_m"))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows of a group
    ranges = ranges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("__b"), F.coalesce(F.sum("_m").over(over), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(ranges, same & (F.col("_b") == F.col("__b")))
    return joined.select(*keys, "v", "n", (F.col("_before") + F.col("_within")).alias("below"), "total")


def floor_indices(rows: DataFrame, keys: Sequence[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each share): :func:`floor_index` of few and large groups of whole seconds.

    Equal values are counted first, so what a task sorts is a group's distinct values, as rows, in one
    pass over the input; for values that hardly repeat see :func:`running_counts`.
    """
    tied = rows.select(*keys, value.alias("v")).where("v IS NOT NULL").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    before = F.sum("n").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    counts = tied.select(*keys, "v", "n", F.coalesce(before, F.lit(0)).alias("below"), F.sum("n").over(group).alias("total"))
    at = lambda q: F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(q)))
    hit = lambda q: (F.col("below") <= at(q)) & (at(q) < F.col("below") + F.col("n"))
    return counts.groupBy(*keys).agg(*[F.max(F.when(hit(q), F.col("v"))).alias(name) for name, q in shares.items()])


def quantiles_of(rows: DataFrame, keys: Sequence[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each share): :func:`type7` of few and large groups."""
    counts = running_counts(rows, keys, value.cast("double"))

    def one(q: float) -> Column:
        h = (F.col("total") - 1) * F.lit(q)
        at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col("v")))
        low, high, part = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
        return low + part * (high - low)

    return counts.groupBy(*keys).agg(*[one(q).alias(name) for name, q in shares.items()])


# ---------------------------------------------------------------- time


def ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp, with or without a time zone (the session's is UTC)."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def rome(epoch_ms: Column) -> Column:
    """Wall clock in Rome as a timestamp whose fields read in UTC."""
    return F.from_utc_timestamp(F.timestamp_millis(epoch_ms), ROME)


def rome_ymd(epoch_ms: Column) -> Column:
    return F.date_format(rome(epoch_ms), "yyyy-MM-dd")


def rome_hms(epoch_ms: Column) -> Column:
    return F.date_format(rome(epoch_ms), "HH:mm:ss")


def rome_hour(epoch_ms: Column) -> Column:
    return F.hour(rome(epoch_ms))


def rome_wall_to_epoch(ymd: Column, seconds: Column) -> Column:
    """Epoch seconds of a service day and seconds into it, which may pass 86400.

    A wall time that occurs twice is the later instant.
    """
    wall = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(ymd, "yyyy-MM-dd")) + seconds.cast("long"))
    first = F.to_utc_timestamp(wall, ROME)
    later = F.timestamp_seconds(F.unix_seconds(first) + 3600)
    return F.unix_seconds(F.when(F.from_utc_timestamp(later, ROME) == wall, later).otherwise(first))


def hms_to_seconds(text: Column) -> Column:
    """Seconds of ``HH:MM`` or ``HH:MM:SS`` (hours may pass 23); null for any other length."""
    part = F.split(text, ":")
    number = lambda k: F.coalesce(F.get(part, F.lit(k)).try_cast("int"), F.lit(0))
    return F.when(F.length(text).isin(5, 8), number(0) * 3600 + number(1) * 60 + number(2))


def is_peak(hour: Column) -> Column:
    """Whole hours from 7 to before 9 and from 16 to before 19."""
    return hour.isin(7, 8, 16, 17, 18)


def is_rush(hour: Column) -> Column:
    """Whole hours from 7 to before 9 and from 17 to before 19; an unknown or zero hour counts as noon."""
    return F.coalesce(hour.isin(7, 8, 17, 18), F.lit(False))


# ---------------------------------------------------------------- text


def slug(name: Column) -> Column:
    """Lower-case letters and digits joined by single dashes; ``unnamed`` if none are left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when((s == "") | s.isNull(), "unnamed").otherwise(s)


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def bare_train_number(text: Column) -> Column:
    """What follows the last `` - ``."""
    return F.nullif(F.trim(F.element_at(F.split(text, " - "), -1)), F.lit(""))


def wait_seconds(text: Column) -> Column:
    minutes = F.regexp_extract(F.lower(text), r"^\s*(\d+)\s*min", 1).try_cast("int")
    return F.when(F.lower(text).contains("in arrivo"), 45).otherwise(minutes * 60)


def wait_flag(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("ricalcolo"), "RECALC").when(t.contains("no serv"), "NO_SERVICE")


# ---------------------------------------------------------------- numbers


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0088) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def normal_cdf(x: Column) -> Column:
    """By the five-term rational approximation of the error function."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    # The approximation's coefficients.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def quantile_cdf(t: Column, p10: Column, p50: Column, p90: Column) -> Column:
    """Probability of at most t on the polyline through the three quantiles, from .02 to .98."""
    low = 0.1 + 0.4 * (t - p10) / F.greatest(F.lit(1), p50 - p10)
    high = 0.5 + 0.4 * (t - p50) / F.greatest(F.lit(1), p90 - p50)
    return F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.when(t <= p50, low).otherwise(high)))


def recovery_prediction(delay_sec: Column, sched_arr: Column, p50: Column) -> Column:
    """By how many seconds the delay is expected to shrink until the destination."""
    return js_round(delay_sec - (p50 - sched_arr) / 1000).cast("long")


def recovery_forecast(delay_sec: Column, sched_arr: Column, p10: Column, p50: Column, p90: Column, recover_by_sec: int = 120) -> Column:
    """(prob_recover, expected_delay_sec, recover_by_sec): the probability, to two decimals, that the final delay is
    at least ``recover_by_sec`` below the present one.

    Null where there is nothing to recover, something is unknown or the quantiles are over half an hour apart.
    """
    told = delay_sec.isNotNull() & sched_arr.isNotNull() & (delay_sec > 0) & (p90 - p10 <= 1_800_000)
    probability = js_round(quantile_cdf(sched_arr + (delay_sec - recover_by_sec) * 1000, p10, p50, p90) * 100) / 100
    return F.when(told, F.struct(probability.alias("prob_recover"), js_round((p50 - sched_arr) / 1000).cast("long").alias("expected_delay_sec"), F.lit(recover_by_sec).alias("recover_by_sec")))


# ---------------------------------------------------------------- rows


def latest_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, since: str, value: Column, name: str, tolerance: int | None = None) -> DataFrame:
    """Adds to each left row the value of the latest right row with ``since <= at`` of the same keys.

    Both sides are sorted together once and the latest value is carried along, so a key's rows meet
    in linear time.  Equal instants: a right row counts as earlier.  Beyond ``tolerance``: null.
    """
    tagged = right.select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(since).alias("at"), value.alias("value")).alias("_v"))
    rows = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(tagged.schema["_v"].dataType).alias("_v"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    both = tagged.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).unionByName(rows)
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_f", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    hit = F.col("_f.value") if tolerance is None else F.when(F.col("_f.at") >= F.col("_at") - tolerance, F.col("_f.value"))
    return found.select("_row.*", hit.alias(name))


Step = Callable[[tuple | None, Any], tuple[tuple | None, tuple | None]]


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, out: str) -> DataFrame:
    """Folds each key's rows in their order; ``step`` takes the state (None at first) and a row and gives the new
    state and what to emit, or None.

    Rows are sorted by key and order within partitions and stream through, so neither a key with many
    rows nor many keys with few are held or called for one by one.  ``out`` has long, string and boolean
    columns.
    """
    shape = [part.split() for part in out.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, at, state = namedtuple("Row", columns), None, None
        for batch in batches:
            told = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != values[: len(keys)]:
                    at, state = values[: len(keys)], None
                state, said = step(state, row(*values))
                if said is not None:
                    told.append(said)
            yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], kinds[kind]) for k, (_, kind) in enumerate(shape)], [n for n, _ in shape])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def greedy_gap(df: DataFrame, key: str, ts: str, gap: int) -> DataFrame:
    """Instants kept by a fold: the first of each key, then each at least ``gap`` after the last kept."""

    def step(last: tuple | None, r: Any) -> tuple[tuple | None, tuple | None]:
        return (last, None) if last is not None and r[1] - last[0] < gap else ((r[1],), (r[0], r[1]))

    return fold_sorted(df.where(F.col(ts).isNotNull()).select(key, F.col(ts).cast("long").alias(ts)), [key], [ts], step, f"{key} long, {ts} long")
