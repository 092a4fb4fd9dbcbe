"""The ingest of snapshots as micro-batches: what changed is flagged, appended and registered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from viaduct.functions.semantics import rome_ymd
from viaduct.operators import quality as q
from viaduct.operators import upserts as up
from viaduct.streaming.live import _none, folded

REGISTRY = "key string, first_seen_at long, last_seen_at long, observation_count long, lat double, lon double, type string"


def append_observations(rows: DataFrame, folder: str) -> None:
    """Appends observations, laid out by service day."""
    dated = rows.withColumn("service_date", rome_ymd(F.col("ts")))
    dated.repartition("service_date").write.mode("append").partitionBy("service_date").parquet(folder)


def files(stream: DataFrame, folder: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Writes a stream as files by service day, exactly once; ``every`` None: what is there now, then stops."""
    dated = stream.withColumn("service_date", rome_ymd(F.col("ts")))
    writer = dated.writeStream.format("parquet").partitionBy("service_date").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def merged_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two states of the registry of places, ``new`` coming after ``old``: spans widen, counts add up, known
    coordinates and types of the later one win, but an unknown point does not replace a station."""
    both = old.withColumn("k", F.lit(0)).unionByName(new.withColumn("k", F.lit(1)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("k"))).alias(c)
    g = both.groupBy("key").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("observation_count").alias("observation_count"), last("lat"), last("lon"), F.max_by("type", "k").alias("type"), F.min_by("type", "k").alias("was"))
    keeps = (F.col("was") == "PASSENGER_STATION") & (F.col("type") == "UNKNOWN_REPORTING_POINT")
    return g.withColumn("type", F.when(keeps, F.col("was")).otherwise(F.col("type"))).drop("was")


#: What is kept of an entity between micro-batches: the content it was last seen with and the last
#: observation that was written.
HELD = "content string, observed_at long, delay_seconds long"
TOLD = "run_id long, id long, source string, ts long, observed_at long, delay_seconds long, location_id string, name string, changed boolean, flags string"
CONTENT = ("delay_seconds", "location_id", "observed_at")


def _content() -> Column:
    """The relevant fields as one text, in which null differs from every value."""
    return F.to_json(F.struct(*CONTENT), {"ignoreNullFields": "false"})


def judged(rows: DataFrame) -> DataFrame:
    """Every snapshot (run_id, id, source, ts, observed_at, delay_seconds, location_id, name) with ``changed``
    and ``flags``.

    A snapshot changed if its relevant fields differ from those of the one before of the same source and
    run; only changed ones become observations.  Flags compare a changed one with the observation before
    of the same source and run, whether its fields are known or not, and are null for the others.  A
    stream keeps both between micro-batches, so any way of cutting it gives the rows of the batch; it
    forgets a run of which a source has said nothing for a day.
    """
    if not rows.isStreaming:
        return _judged_at_once(rows)

    def step(last: tuple | None, r) -> tuple[tuple | None, tuple | None]:
        seen, delay = _none(r.observed_at), _none(r.delay_seconds)
        same = last is not None and last[0] == r.content
        flags = []
        if not same:
            was_seen, was_delay = (None, None) if last is None else (_none(last[1]), _none(last[2]))
            if was_seen is not None and seen is not None and was_seen - seen >= q.OUT_OF_ORDER_MS:
                flags.append("OUT_OF_ORDER")
            if was_delay is not None and delay is not None and abs(delay - was_delay) > q.JUMP_SEC:
                flags.append("DELAY_JUMP")
            if seen is not None and r.ts - seen > q.STALE_MS:
                flags.append("STALE_SOURCE")
        text = lambda v: None if v is None or v != v else v
        said = (_none(r.run_id), int(r.id), r.source, int(r.ts), seen, delay, text(r.location_id), text(r.name), not same, None if same else ",".join(flags))
        return (last if same else (r.content, seen, delay)), said

    keyed = rows.select(F.concat_ws("/", F.col("run_id").cast("string"), "source").alias("key"), "run_id", "id", "source", "ts", "observed_at", "delay_seconds", "location_id", "name", _content().alias("content"))
    return folded(keyed, "key", step, TOLD, HELD)


def _judged_at_once(rows: DataFrame) -> DataFrame:
    entity = Window.partitionBy("source", "run_id").orderBy("ts", "id")
    told = rows.withColumn("_content", _content())
    told = told.withColumn("changed", F.coalesce(F.lag("_content").over(entity) != F.col("_content"), F.lit(True)))
    among = Window.partitionBy("source", "run_id", "changed").orderBy("ts", "id")
    flags = q.flags_against(F.lag("observed_at").over(among), F.lag("delay_seconds").over(among))
    names = [part.split()[0] for part in TOLD.split(", ")]
    return told.withColumn("flags", F.when(F.col("changed"), flags)).select(*names)


def snapshots(stream: DataFrame, folder: str, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
    """Ingests snapshots: writes those that :func:`judged` finds changed, with their flags, and registers places.

    What an entity was last seen with is state of the stream and lives in its checkpoint, so a micro-batch
    that runs again judges its rows as before.  It writes under its own number and leaves a new state of
    the registry of places; running again overwrites both, so each row counts once.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        rows.where("changed").drop("changed").write.mode("overwrite").parquet(f"{folder}/observations/batch={number}")
        seen = up.rail_locations(rows.where("name IS NOT NULL").select("id", "name", F.col("ts").alias("seen_at"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")))
        merged_registry(registry(batch.sparkSession, folder, number - 1), seen).write.mode("overwrite").parquet(f"{folder}/registry/batch={number}")
        rows.unpersist()

    writer = judged(stream).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def registry(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The registry after a micro-batch; empty before the first one."""
    if number < 0:
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).parquet(f"{folder}/registry/batch={number}")
