"""Segment traversals and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.semantics import floor_indices, is_peak, latest_per, rome_hour, type7, upper_median


def traversals(events: DataFrame) -> DataFrame:
    """One row per run and pair of consecutive stops: when it was entered and left, runtime and delays.

    A pair without both times, one that ends before it starts and one faster than a quarter of the
    timetable (30 s at least) are dropped; a run counts a pair once, the first time.
    """
    w = Window.partitionBy("run_id").orderBy(F.col("stop_sequence").asc_nulls_first(), F.col("sched_arr_epoch").asc_nulls_first(), "stop_id")
    nxt = lambda c: F.lead(c).over(w).alias(f"to_{c}")
    pairs = events.select("*", nxt("stop_id"), nxt("actual_arr_epoch"), nxt("sched_arr_epoch"), nxt("arr_delay_sec"), F.row_number().over(w).alias("pos"))
    entered, left = F.coalesce("actual_dep_epoch", "actual_arr_epoch"), F.col("to_actual_arr_epoch")
    rows = pairs.where(F.col("to_stop_id").isNotNull()).select(
        "run_id", "pos", F.col("stop_id").alias("from_stop_id"), "to_stop_id", F.concat_ws(">", "stop_id", "to_stop_id").alias("segment_id"),
        entered.alias("entered_at"), left.alias("left_at"), F.floor((left - entered) / 1000).cast("long").alias("runtime_sec"),
        F.floor((F.col("to_sched_arr_epoch") - F.col("sched_dep_epoch")) / 1000).cast("long").alias("sched_sec"),
        F.col("dep_delay_sec").cast("long").alias("entry_delay_sec"), F.col("to_arr_delay_sec").cast("long").alias("exit_delay_sec"),
    )
    good = rows.where("left_at > entered_at AND runtime_sec >= greatest(30, coalesce(sched_sec, 0) * 0.25)")
    once = latest_per(good, ["run_id", "segment_id"], F.col("pos"))
    return once.select("segment_id", "run_id", "from_stop_id", "to_stop_id", "entered_at", "left_at", "runtime_sec", "entry_delay_sec", "exit_delay_sec", (F.col("exit_delay_sec") - F.col("entry_delay_sec")).alias("delay_delta_sec"))


def bucketed(t: DataFrame, at: str = "entered_at") -> DataFrame:
    """Each traversal in the bucket of all hours and in that of its own hour in Rome."""
    own = F.when(is_peak(rome_hour(F.col(at))), "peak").otherwise("off")
    return t.withColumn("bucket", F.explode(F.array(F.lit("all"), own)))


def look_back(t: DataFrame, as_of: int, days: int = 90, at: str = "entered_at") -> DataFrame:
    """Traversals of the last ``days`` up to an instant, which statistics are refreshed from."""
    return t.where((F.col(at) >= as_of - days * 86_400_000) & (F.col(at) <= as_of))


def segment_stats(t: DataFrame, least: int = 5) -> DataFrame:
    """Exact quantiles of runtime and delay change for each segment and bucket, all of a column from one aggregate."""
    stats = bucketed(t).groupBy("segment_id", "bucket").agg(F.count("*").alias("n"), F.percentile("runtime_sec", [0.1, 0.5, 0.9]).alias("r"), F.percentile("delay_delta_sec", [0.5, 0.9]).alias("d"))
    q = lambda c, k, name: F.round(F.get(c, F.lit(k)), 6).alias(name)
    return stats.where(F.col("n") >= least).select("segment_id", "bucket", "n", q("r", 0, "p10_runtime"), q("r", 1, "p50_runtime"), q("r", 2, "p90_runtime"), q("d", 0, "p50_delta"), q("d", 1, "p90_delta"))


def historical_pairs(events: DataFrame, dwells: DataFrame) -> DataFrame:
    """Pairs of consecutive stops of imported runs, arrival to arrival.

    Stops without a planned and an actual time are passed over.  A pair counts if the timetable gives
    it up to an hour, it took up to two and at least a quarter of the plan (30 s at least), and the
    delays at both ends lie between -15 minutes and four hours.  The scheduled dwell at the first stop
    is taken off the runtime.
    """
    known = events.where("stop_id IS NOT NULL AND sched_arr_epoch > 0 AND actual_arr_epoch > 0")
    w = Window.partitionBy("run_id").orderBy("stop_sequence", "sched_arr_epoch", "stop_id")
    nxt = lambda c: F.lead(c).over(w).alias(f"to_{c}")
    sec = lambda a, b: F.floor((F.col(b) - F.col(a)) / 1000 + 0.5).cast("long")
    pairs = known.select("run_id", "stop_id", "sched_arr_epoch", "actual_arr_epoch", *map(nxt, ("stop_id", "sched_arr_epoch", "actual_arr_epoch"))).where("to_stop_id IS NOT NULL")
    pairs = pairs.select(
        "run_id", "stop_id", F.concat_ws(">", "stop_id", "to_stop_id").alias("segment_id"), F.col("actual_arr_epoch").alias("entered_at"), sec("actual_arr_epoch", "to_actual_arr_epoch").alias("took"),
        sec("sched_arr_epoch", "to_sched_arr_epoch").alias("planned"), sec("sched_arr_epoch", "actual_arr_epoch").alias("delay"), sec("to_sched_arr_epoch", "to_actual_arr_epoch").alias("to_delay"),
    )
    good = pairs.where("planned > 0 AND planned <= 3600 AND took <= 7200 AND took >= greatest(30, planned * 0.25) AND delay BETWEEN -900 AND 14400 AND to_delay BETWEEN -900 AND 14400")
    runtime = F.greatest(F.lit(30), F.col("took") - F.coalesce("dwell_sec", F.lit(0)))
    return good.join(dwells, "stop_id", "left").select("segment_id", "run_id", "entered_at", runtime.alias("runtime_sec"), (F.col("to_delay") - F.col("delay")).alias("delay_delta_sec"), (F.col("took") - F.col("planned")).alias("excess_sec"))


def segment_priors(pairs: DataFrame, least: int = 5) -> DataFrame:
    """As :func:`segment_stats`, with the median excess over the timetable, of :func:`historical_pairs`."""
    excess = bucketed(pairs).groupBy("segment_id", "bucket").agg(F.round(type7(F.col("excess_sec"), 0.5), 6).alias("p50_excess"))
    return segment_stats(pairs, least).join(excess, ["segment_id", "bucket"])


def pick_stats(wanted: DataFrame, live: DataFrame, prior: DataFrame, widen: float = 1.3) -> DataFrame:
    """Statistics for (segment_id, bucket): live ones of the bucket, then of all hours, then prior ones
    with their upper spread widened."""
    side = lambda df, tag, bucket: df.where(bucket).select("segment_id", *([] if tag.endswith("all") else ["bucket"]), F.struct("n", "p50_runtime", "p90_runtime").alias(tag))
    rows = wanted.join(side(live, "live", F.col("bucket") != "all"), ["segment_id", "bucket"], "left").join(side(live, "live_all", F.col("bucket") == "all"), "segment_id", "left")
    rows = rows.join(side(prior, "prior", F.col("bucket") != "all"), ["segment_id", "bucket"], "left").join(side(prior, "prior_all", F.col("bucket") == "all"), "segment_id", "left")
    old = F.coalesce("prior", "prior_all")
    wide = F.when(old.isNotNull(), F.struct(old["n"].alias("n"), old["p50_runtime"].alias("p50_runtime"), F.round(old["p50_runtime"] + widen * (old["p90_runtime"] - old["p50_runtime"]), 6).alias("p90_runtime")))
    chosen = F.coalesce("live", "live_all", wide)
    source = F.when(F.col("live").isNotNull() | F.col("live_all").isNotNull(), "live").when(old.isNotNull(), "prior")
    return rows.select("segment_id", "bucket", source.alias("source"), chosen["n"].alias("n"), chosen["p50_runtime"].alias("p50_runtime"), chosen["p90_runtime"].alias("p90_runtime"))


def dwell(stop_times: DataFrame, cap: int = 180) -> DataFrame:
    """Upper median of the scheduled dwell at a stop, at most ``cap`` seconds; no dwell and half an hour or more do not count."""
    d = (F.col("departure_sec") - F.col("arrival_sec")).cast("long")
    return stop_times.select("stop_id", d.alias("d")).where("d > 0 AND d < 1800").groupBy("stop_id").agg(F.least(upper_median(F.col("d")), F.lit(cap).cast("long")).alias("dwell_sec"))


def corridor_health(t: DataFrame, as_of: int, window_ms: int = 3_600_000) -> DataFrame:
    """Segments with a notable median or worst delay change in the window up to ``as_of``, the largest medians first."""
    recent = t.where((F.col("entered_at") >= as_of - window_ms) & (F.col("entered_at") <= as_of) & F.col("delay_delta_sec").isNotNull())
    g = recent.groupBy("segment_id").agg(F.count("*").alias("n"), F.max("delay_delta_sec").alias("worst_delta"))
    g = g.join(floor_indices(recent, ["segment_id"], F.col("delay_delta_sec"), {"median_delta": 0.5}), "segment_id").select("segment_id", "n", "median_delta", "worst_delta")
    return g.where((F.abs("median_delta") >= 60) | (F.col("worst_delta") >= 180)).orderBy(F.desc(F.abs("median_delta")), "segment_id")


def corridor_delta(t: DataFrame, as_of: int | None = None, within_ms: int = 10_800_000, last: int = 3) -> DataFrame:
    """Upper median of a segment's last few known delay changes, of the time up to ``as_of`` where that is given."""
    recent = t.where("delay_delta_sec IS NOT NULL")
    recent = recent if as_of is None else recent.where((F.col("entered_at") >= as_of - within_ms) & (F.col("entered_at") <= as_of))
    w = Window.partitionBy("segment_id").orderBy(F.desc("entered_at"), F.desc("run_id"))
    return recent.withColumn("k", F.row_number().over(w)).where(F.col("k") <= last).groupBy("segment_id").agg(upper_median(F.col("delay_delta_sec")).alias("corridor_delta"), F.count("*").alias("n"))


def top_segments(stats: DataFrame, limit: int = 50) -> DataFrame:
    return stats.orderBy(F.desc("n"), "segment_id", "bucket").limit(limit)


def error_metrics(rows: DataFrame, keys: list[str], error: str, *more: Column) -> DataFrame:
    """n, MAE, median, root mean square, 90th and 95th percentile of the absolute error, bias, and ``more`` aggregates.

    The quantiles come from counts of equal errors, as groups are few and large.
    """
    rows = rows.where(F.col(error).isNotNull())
    e, a = F.col(error), F.abs(F.col(error))
    plain = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(a), 4).alias("mae"), F.round(F.sqrt(F.avg((e * e).cast("double"))), 4).alias("rmse"), F.round(F.avg(e), 4).alias("bias"), *more)
    return plain.join(floor_indices(rows, keys, a, {"median_ae": 0.5, "p90_ae": 0.9, "p95_ae": 0.95}), keys)
