"""Fusing what several sources say about a run into one state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.operators import trust


def latest_by_source(obs: DataFrame) -> DataFrame:
    """The newest observation of each run and source."""
    newest = F.max_by(F.struct("id", "ts", "delay_seconds", "location_id"), F.struct("ts", "id"))
    return obs.groupBy("run_id", "source").agg(newest.alias("o")).select("run_id", "source", "o.*")


def confidence(sources: Column, age_sec: Column, spread: Column) -> Column:
    """HIGH, MEDIUM or LOW by the number of sources, the age of the freshest and their spread."""
    spread = F.coalesce(spread, F.lit(0))
    return F.when((sources >= 2) & (age_sec < 120) & (spread <= 120), "HIGH").when((sources >= 1) & (age_sec < 600) & (spread <= 600), "MEDIUM").otherwise("LOW")


def fuse(obs: DataFrame, as_of: int) -> DataFrame:
    """One state for each run: freshest delay and location, the sources' spread, age and confidence at ``as_of``."""
    latest = latest_by_source(obs.where(F.col("ts") <= as_of))
    newest = F.max_by(F.struct("source", "delay_seconds", "location_id"), F.struct("ts", "id"))
    state = latest.groupBy("run_id").agg(F.count("*").alias("sources"), F.max("ts").alias("ts"), (F.max("delay_seconds") - F.min("delay_seconds")).alias("spread_sec"), newest.alias("n"))
    age = F.floor((F.lit(as_of) - F.col("ts")) / 1000)
    return state.select("run_id", "sources", F.col("n.source").alias("source"), F.col("n.delay_seconds").alias("delay_seconds"), F.col("n.location_id").alias("location_id"), "spread_sec", age.alias("age_sec"), confidence(F.col("sources"), age, F.col("spread_sec")).alias("confidence"))


def status(any_cancelled: Column, all_arrived: Column, any_passed: Column, code: Column, sched_dep: Column, as_of: int) -> Column:
    """State of a run by its stops and the freshest source's own code, then by the clock.

    Cancelled if any stop or the code says so, arrived if all stops are arrived or cancelled, running
    if any was passed, scheduled by the code; the clock only tells scheduled from running.
    """
    is_ = lambda *codes: F.coalesce(code.isin(*codes), F.lit(False))
    out = F.when(any_cancelled | is_("C", "ST"), "cancelled").when(all_arrived | is_("A"), "arrived").when(any_passed | is_("V"), "running").when(is_("N", "PG"), "scheduled")
    return out.when(sched_dep > as_of, "scheduled").when(sched_dep.isNotNull(), "running").otherwise("unknown")


def stop_facts(events: DataFrame) -> DataFrame:
    """What a run's stops say: (run_id, any_cancelled, all_arrived, any_passed, previous_stop, next_stop, destination_eta, stops).

    The previous stop is the last one with an actual time; the next is the first one without an
    actual arrival that is not cancelled and not planned before the previous stop's arrival.
    """
    at = F.struct(F.coalesce("stop_sequence", F.lit(-1)).alias("seq"), F.coalesce("sched_arr_epoch", F.lit(-1)).alias("arr"), "stop_id")
    passed = F.col("actual_arr_epoch").isNotNull() | F.col("actual_dep_epoch").isNotNull()
    gone = F.coalesce(F.col("cancelled") == 1, F.lit(False))
    w = Window.partitionBy("run_id")
    rows = events.withColumn("_at", at).withColumn("_prev", F.max_by("actual_arr_epoch", F.when(passed, F.col("_at"))).over(w))
    coming = F.col("actual_arr_epoch").isNull() & ~gone & (F.col("sched_arr_epoch").isNull() | (F.col("sched_arr_epoch") >= F.coalesce("_prev", F.lit(0))))
    return rows.groupBy("run_id").agg(
        F.bool_or(gone).alias("any_cancelled"), F.bool_and(F.col("actual_arr_epoch").isNotNull() | gone).alias("all_arrived"), F.bool_or(passed).alias("any_passed"),
        F.max_by("stop_id", F.when(passed, F.col("_at"))).alias("previous_stop"), F.min_by("stop_id", F.when(coming, F.col("_at"))).alias("next_stop"),
        F.max_by("op_pred_arr_epoch", "_at").alias("destination_eta"), F.max_by("sched_arr_epoch", "_at").alias("last_sched_arr"),
        F.count_if(passed).alias("passed_stops"), F.count_if(coming).alias("upcoming_stops"), F.transform(F.array_sort(F.collect_list(F.struct("_at", F.struct("stop_id", "stop_sequence", "sched_arr_epoch", "actual_arr_epoch", "arr_delay_sec", "platform_actual", "cancelled").alias("s")))), lambda x: x["s"]).alias("stops"),
    )


def fuse_runs(runs: DataFrame, events: DataFrame, obs: DataFrame, health: DataFrame, as_of: int, agreement_sec: int = 60) -> DataFrame:
    """One nested state for each run at ``as_of``: status, delay and position with where they come from, stops.

    ``obs`` has run_id, source, ts, id, observed_at, delay_seconds, location_id and status; ``health``
    has source and state.  Delay and position are picked by :func:`viaduct.operators.trust.resolved`, which
    also tells why.
    """
    newest = F.max_by(F.struct("id", "ts", "observed_at", "delay_seconds", "location_id", "status"), F.struct("ts", "id"))
    latest = obs.where(F.col("ts") <= as_of).groupBy("run_id", "source").agg(newest.alias("o")).select("run_id", "source", "o.*").join(F.broadcast(health.select("source", "state")), "source", "left")  # a row for each source
    latest = latest.withColumn("seen", F.coalesce("observed_at", "ts"))
    told = F.struct("source", "seen", "ts", "delay_seconds", "status", F.floor((F.lit(as_of) - F.col("seen")) / 1000 + 0.5).cast("long").alias("age_sec"))
    said = lambda value: trust.candidate(F.col("source"), F.col(value), F.col("seen"), F.col("state"))
    g = latest.groupBy("run_id").agg(
        F.array_sort(F.collect_list(told)).alias("sources"), F.max_by(F.struct("seen", "status"), F.struct("seen", "source")).alias("fresh"), (F.max("delay_seconds") - F.min("delay_seconds")).alias("range"), F.count("delay_seconds").alias("delays"),
        F.collect_list(F.when(F.col("delay_seconds").isNotNull(), said("delay_seconds"))).alias("delay_candidates"), F.collect_list(said("location_id")).alias("position_candidates"),
    )
    g = trust.resolved(trust.resolved(g, "delay_candidates", "current_delay", "delay", agreement_sec), "position_candidates", "position", "position")
    spread = F.when(F.col("delays") >= 2, F.col("range"))
    j = runs.select("run_id", "train_number", "service_date", "sched_dep_epoch", F.col("sched_arr_epoch").alias("_arr")).join(stop_facts(events), "run_id", "left").join(g, "run_id", "left")
    age = F.floor((F.lit(as_of) - F.col("fresh.seen")) / 1000 + 0.5).cast("long")
    no = F.lit(False)
    quality = F.array_compact(F.array(F.when(spread > 300, "SOURCE_CONFLICT"), F.when(age > 600, "STALE_SOURCE")))
    sure = confidence(F.coalesce(F.size("sources"), F.lit(0)), F.coalesce(age, F.lit(1 << 40)), spread)
    return j.select(
        "run_id", F.concat("train_number", F.lit("@"), "service_date").alias("run_code"), F.coalesce("_arr", "last_sched_arr").alias("sched_arr_epoch"),
        status(F.coalesce("any_cancelled", no), F.coalesce("all_arrived", no), F.coalesce("any_passed", no), F.col("fresh.status"), F.col("sched_dep_epoch"), as_of).alias("status"),
        F.col("delay.value").alias("delay_sec"), F.col("delay.source").alias("delay_source"), F.col("delay.trust").alias("delay_trust"), F.col("delay.disagreement").alias("disagreement_sec"), F.col("delay.reason").alias("delay_reason"),
        F.col("position.value").alias("location_id"), F.col("position.source").alias("position_source"), F.col("position.reason").alias("position_reason"),
        spread.alias("spread_sec"), sure.alias("confidence"), F.array_join(quality, ",").alias("quality"), "previous_stop", "next_stop", "destination_eta", "passed_stops", "upcoming_stops", "sources", "stops",
    )
