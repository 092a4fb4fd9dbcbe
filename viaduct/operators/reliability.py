"""How punctual a train or a stop has been in the last days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.functions.semantics import floor_indices

DAY = 86_400_000
# From how many trips on shares are told, from how many calls on a route is listed, and how
# much a segment's median must cost or win to be named.
LEAST, LISTED, WORST_SEC, RECOVERY_SEC = 20, 10, 30, -15


def _share(part: Column, whole: Column) -> Column:
    """Per cent to one decimal, null below LEAST."""
    return F.when(whole >= LEAST, F.floor(part / whole * 1000 + 0.5) / 10)


def _recent(runs: DataFrame, as_of: int, days: int) -> DataFrame:
    return runs.where(F.col("service_date") >= F.date_format(F.timestamp_millis(F.lit(as_of - days * DAY)), "yyyy-MM-dd"))


def train_reliability(events: DataFrame, runs: DataFrame, traversals: DataFrame, stops: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    """(train_number, completed, on_time_pct, late5_pct, late10_pct, cancelled_pct, median_sec, p90_sec, worst_*, recovery_*).

    Delays are those at the destination of the runs of the last ``days`` service days; a cancelled call counts
    as one trip more.  Of the segments with LEAST traversals since then the one with the largest and the one with
    the smallest median change of delay are named, if those are worth it (ties: the smaller segment).
    """
    recent = _recent(runs, as_of, days).select("run_id", "train_number", "destination_stop_id")
    calls = events.join(recent, "run_id")
    ended = calls.where((F.col("stop_id") == F.col("destination_stop_id")) & F.col("arr_delay_sec").isNotNull())
    late = F.col("arr_delay_sec")
    counts = ended.groupBy("train_number").agg(F.count("*").alias("n"), F.count_if(late < 180).alias("a"), F.count_if(late >= 300).alias("b"), F.count_if(late >= 600).alias("c"))
    gone = calls.where("cancelled = 1").groupBy("train_number").agg(F.count("*").alias("gone"))
    middle = floor_indices(ended, ["train_number"], late, {"median_sec": 0.5, "p90_sec": 0.9})

    seen = traversals.where(F.col("delay_delta_sec").isNotNull() & (F.col("entered_at") >= as_of - days * DAY)).join(runs.select("run_id", "train_number"), "run_id")
    keys = ["train_number", "segment_id", "from_stop_id", "to_stop_id"]
    often = seen.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    medians = floor_indices(seen, keys, F.col("delay_delta_sec"), {"m": 0.5}).join(often, keys)
    what = F.struct("from_stop_id", "to_stop_id", "m", "n")
    ends = medians.groupBy("train_number").agg(F.min_by(what, F.struct(-F.col("m"), "segment_id")).alias("w"), F.min_by(what, F.struct("m", "segment_id")).alias("r"))
    names = stops.groupBy("stop_id").agg(F.min("stop_name").alias("stop_name"))

    def named(df: DataFrame, side: str, end: str) -> DataFrame:
        key = f"{side}_{end}"
        found = names.select(F.col("stop_id").alias(key), F.col("stop_name").alias(f"{key}_name"))
        return df.join(found, key, "left").withColumn(key, F.coalesce(f"{key}_name", key)).drop(f"{key}_name")

    worst = F.when(F.col("w.m") > WORST_SEC, F.col("w"))
    recovery = F.when(F.col("r.m") < RECOVERY_SEC, F.col("r"))
    ends = ends.select("train_number", *[x[f].alias(f"{side}_{name}") for side, x in (("worst", worst), ("recovery", recovery)) for f, name in (("from_stop_id", "from"), ("to_stop_id", "to"), ("m", "sec"), ("n", "n"))])
    for side in ("worst", "recovery"):
        for end in ("from", "to"):
            ends = named(ends, side, end)
    out = counts.join(gone, "train_number", "full").join(middle, "train_number", "left").join(ends, "train_number", "full").fillna(0, ["n", "a", "b", "c", "gone"])
    n = F.col("n")
    shares = [_share(F.col(c), n).alias(name) for c, name in (("a", "on_time_pct"), ("b", "late5_pct"), ("c", "late10_pct"))] + [_share(F.col("gone"), n + F.col("gone")).alias("cancelled_pct")]
    return out.select("train_number", n.alias("completed"), *shares, "median_sec", "p90_sec", *[f"{side}_{x}" for side in ("worst", "recovery") for x in ("from", "to", "sec", "n")])


def stop_reliability(events: DataFrame, runs: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    """(stop_id, route_id, n, on_time_pct, median_sec, p90_sec) of routes with LISTED calls in the last ``days``
    service days; runs without a route take no part."""
    recent = _recent(runs, as_of, days).where("route_id IS NOT NULL").select("run_id", "route_id")
    rows = events.where("arr_delay_sec IS NOT NULL").join(recent, "run_id")
    n = F.col("n")
    counts = rows.groupBy("stop_id", "route_id").agg(F.count("*").alias("n"), F.count_if(F.col("arr_delay_sec") < 180).alias("a")).where(n >= LISTED)
    middle = floor_indices(rows, ["stop_id", "route_id"], F.col("arr_delay_sec"), {"median": 0.5, "p90": 0.9})
    told = lambda c: F.when(n >= LEAST, F.col(c))
    return counts.join(middle, ["stop_id", "route_id"]).select("stop_id", "route_id", "n", _share(F.col("a"), n).alias("on_time_pct"), told("median").alias("median_sec"), told("p90").alias("p90_sec"))
