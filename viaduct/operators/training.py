"""Rows that models learn from: scored predictions, and stops as of their arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.semantics import clamp, js_round

# The furthest horizon, the largest label and the largest delay that are learned from.
MOST_AHEAD_MS, MOST_LABEL_SEC, MOST_DELAY_SEC = 3_600_000, 2700, 1800


def training_rows(rows: DataFrame, base_model: str = "heuristic-v1") -> DataFrame:
    """Scored predictions to learn from, with ``label_sec``: the error of the uncorrected estimate.

    Kept: up to an hour ahead, with the features that every row needs, and an error of up to 45
    minutes.  A corrected row needs its base quantiles; its error is moved back by the correction.
    """
    corrected = F.col("model_version") != base_model
    moved = js_round(F.col("our_error_sec") + (F.col("our_p50") - F.col("base_p50")) / 1000).cast("long")
    rows = rows.where(F.col("model_version").startswith(base_model) & F.col("our_error_sec").isNotNull() & F.col("our_p50").isNotNull() & F.col("remaining_segments").isNotNull() & F.col("stats_coverage").isNotNull())
    rows = rows.where((F.col("sched_arr_epoch") - F.col("generated_at")).between(0, MOST_AHEAD_MS) & (~corrected | (F.col("base_p10").isNotNull() & F.col("base_p50").isNotNull() & F.col("base_p90").isNotNull())))
    rows = rows.withColumn("label_sec", F.when(corrected, moved).otherwise(F.col("our_error_sec")))
    return rows.where(F.abs("label_sec") <= MOST_LABEL_SEC).withColumn("start_p50", F.when(corrected, F.col("base_p50")).otherwise(F.col("our_p50")))


def stop_level(events: DataFrame, runs: DataFrame, since: str) -> DataFrame:
    """:func:`at_stops` of the runs of service days from ``since`` on."""
    r = runs.where(F.col("service_date") >= since).select("run_id", "service_date", "train_number", "origin_stop_id", "destination_stop_id", F.col("sched_arr_epoch").alias("dest_sched"))
    return at_stops(events.join(r, "run_id"))


def at_stops(e: DataFrame) -> DataFrame:
    """A row for each known arrival before a run's destination: what was known there, and the final delay.

    ``e``: stops with their run's train_number, origin_stop_id, destination_stop_id and dest_sched.  Three facts of
    a run (its last sequence, its destination's arrival, its origin's departure delay) are told to all of its
    stops where they are, without a join.
    """
    run = Window.partitionBy("run_id")
    rows = e.withColumns({
        "max_seq": F.max("stop_sequence").over(run), "dest_actual": F.min_by("actual_arr_epoch", F.when(F.col("stop_id") == F.col("destination_stop_id"), F.col("stop_sequence"))).over(run),
        "origin_dep_ms": F.min_by(F.col("actual_dep_epoch") - F.col("sched_dep_epoch"), F.when((F.col("stop_id") == F.col("origin_stop_id")) & F.col("actual_dep_epoch").isNotNull(), F.col("stop_sequence"))).over(run),
    })
    rows = rows.where("actual_arr_epoch IS NOT NULL AND arr_delay_sec IS NOT NULL AND sched_arr_epoch IS NOT NULL AND dest_sched IS NOT NULL AND stop_id <> destination_stop_id")
    rows = rows.where("dest_actual IS NOT NULL AND actual_arr_epoch < dest_actual")
    label = clamp((F.col("dest_actual") - F.col("dest_sched")) / 1000, -float(MOST_LABEL_SEC), float(MOST_LABEL_SEC))
    delay = clamp(F.col("arr_delay_sec").cast("double"), -float(MOST_DELAY_SEC), float(MOST_DELAY_SEC))
    return rows.select(
        "run_id", "stop_sequence", "train_number", F.col("actual_arr_epoch").alias("generated_at"), "dest_sched", (F.col("dest_sched") + delay * 1000).cast("long").alias("p50"), delay.alias("delay_sec"),
        F.greatest(F.lit(1), F.col("max_seq") - F.col("stop_sequence")).alias("remaining_segments"), js_round(F.col("origin_dep_ms") / 1000).cast("long").alias("origin_dep_delay_sec"), label.alias("label_sec"),
    )
