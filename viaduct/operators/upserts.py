"""Merge rules of keyed tables, as folds over rows in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.semantics import latest_per, slug


def last_known(c: str, order: Column) -> Column:
    """The last non-null value: rows without one do not compete."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), order))


def first_known(c: str, order: Column) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), order))


def merge_stop_events(updates: DataFrame, keys: list[str], order: list[str], overwrite: list[str], coalesce: list[str], frozen: list[str]) -> DataFrame:
    """State of each key after all updates: overwritten columns are the last row's, coalesced ones
    never go back to null, frozen ones are the first row's."""
    at = F.struct(*order)
    cols = [F.max_by(c, at).alias(c) for c in overwrite] + [last_known(c, at).alias(c) for c in coalesce] + [F.min_by(c, at).alias(f"first_{c}") for c in frozen]
    return updates.groupBy(*keys).agg(*cols, F.count("*").alias("updates"))


def enrich_runs(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Insert once, then fill nulls: the first known value of every column."""
    at = F.struct(*order)
    return rows.groupBy(key).agg(*[first_known(c, at).alias(c) for c in columns])


def provider_health(fetches: DataFrame) -> DataFrame:
    """Counters and state of each source after all its fetches (source, ts, id, ok).

    The first fetch leaves a source unknown; then five errors in a row pause it, one degrades it.
    """
    at = F.struct("ts", "id")
    last_ok = fetches.groupBy("source").agg(F.max(F.when(F.col("ok"), at)).alias("last_ok"), F.min(at).alias("first"))
    rows = fetches.join(F.broadcast(last_ok), "source")  # a row for each source
    after = (F.col("last_ok").isNull() | (F.struct("ts", "id") > F.col("last_ok"))) & (F.struct("ts", "id") > F.col("first"))
    g = rows.groupBy("source").agg(F.count("*").alias("fetches"), F.count_if(~F.col("ok")).alias("errors"), F.count_if(after).alias("consecutive_errors"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success_at"))
    c = F.col("consecutive_errors")
    return g.withColumn("state", F.when(F.col("fetches") == 1, "UNKNOWN").when(c >= 5, "PAUSED").when(c >= 1, "DEGRADED").otherwise("HEALTHY"))


def classify_location(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("bivio"), "BIVIO").when(n.contains("diramazione") | n.contains("giunzione"), "JUNCTION").otherwise("UNKNOWN_REPORTING_POINT")


def rail_locations(sightings: DataFrame) -> DataFrame:
    """Registry by slug: widened time span, summed count, newest known coordinates, last type.

    A sighting without a type has that of its name; an unknown point never replaces a station.
    """
    at = F.struct("seen_at", "id")
    rows = sightings.withColumn("type", F.coalesce("type", classify_location(F.col("name"))))
    known = F.col("type") != "UNKNOWN_REPORTING_POINT"
    g = rows.groupBy(slug(F.col("name")).alias("key")).agg(
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.count("*").alias("observation_count"),
        last_known("lat", at).alias("lat"), last_known("lon", at).alias("lon"), F.max_by("type", at).alias("last"), F.max_by("type", F.when(known, at)).alias("told"),
    )
    station = (F.col("last") == "UNKNOWN_REPORTING_POINT") & (F.col("told") == "PASSENGER_STATION")
    return g.withColumn("type", F.when(station, F.col("told")).otherwise(F.col("last"))).drop("last", "told")


def last_version(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return latest_per(rows, keys, *order)


def distinct_alerts(alerts: DataFrame, parts: list[str], order: str) -> DataFrame:
    """The first alert of each content hash; a part that is null differs from any text."""
    return alerts.groupBy(F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts]), 256).alias("payload_hash")).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def changed_snapshots(fetches: DataFrame) -> DataFrame:
    """Fetches whose payload differs from the one before of the same source and entity."""
    w = Window.partitionBy("source", "entity_key").orderBy("ts", "id")
    return fetches.withColumn("changed", F.coalesce(F.lag("payload_hash").over(w) != F.col("payload_hash"), F.lit(True)))


def fill_nulls(target: DataFrame, patch: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Takes a column from the patch where the target has none; of several patches of a key the smallest."""
    return target.join(patch.groupBy(*keys).agg(F.min(column).alias("_new")), keys, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; old keys that are not recomputed stay."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def retain(rows: DataFrame, ts: str, now: int, days: int) -> DataFrame:
    return rows.where(F.col(ts) >= now - days * 86_400_000)
