"""Stop events as several sources tell them, merged into one state whatever the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["run_id", "stop_id"]
#: Of the first update: its sequence becomes the event's identity, as sources count stops differently.
FIRST = ["stop_sequence", "sched_arr_epoch", "sched_dep_epoch", "platform_sched"]
#: Of the last update, known or not.
LAST = ["op_pred_arr_epoch", "op_pred_dep_epoch", "actual_dep_epoch", "platform_is_actual", "source"]
#: Of the last update that knows them: these never go back to null.
KNOWN = ["actual_arr_epoch", "platform_actual", "arr_delay_sec", "dep_delay_sec", "cancelled"]


def _stamped(c: str, at: Column) -> Column:
    return F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))).alias(c)


def states(updates: DataFrame) -> DataFrame:
    """Each update (KEYS, service_date, ts, id and the columns above) as a state of its own."""
    at = F.struct("ts", "id")
    first = F.struct(at.alias("at"), F.coalesce("stop_sequence", F.lit(0)).alias("stop_sequence"), *FIRST[1:]).alias("first")
    return updates.select(*KEYS, "service_date", first, F.struct(at.alias("at"), *LAST).alias("last"), *[_stamped(c, at) for c in KNOWN])


def merged(states_: DataFrame) -> DataFrame:
    """One state for each event.

    Every part carries when it was said and the smallest or largest stamp wins, so states may be merged in
    any order and any number of times.
    """
    latest = [F.max(c).alias(c) for c in KNOWN]  # stamps lead, so equal ones do not occur but in repeats
    return states_.groupBy(*KEYS, "service_date").agg(F.min("first").alias("first"), F.max_by("last", "last.at").alias("last"), *latest)


def view(states_: DataFrame) -> DataFrame:
    """The table of stop events that a state stands for."""
    return states_.select(*KEYS, "service_date", *[F.col(f"first.{c}").alias(c) for c in FIRST], *[F.col(f"last.{c}").alias(c) for c in LAST], *[F.col(f"{c}.v").alias(c) for c in KNOWN], F.col("last.at.ts").alias("updated_at"))
