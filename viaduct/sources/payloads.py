"""Further sources: packed feeds, positional rows, nested waiting messages, packed payloads, fixtures, rain, reports."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables of a timetable feed, how deep payloads are searched, words that tell a disruption.
TABLES = ("stops", "routes", "trips", "stop_times", "calendar_dates")
MOST_DEPTH = 6
DISRUPTED = "disagi|ferm|sosp|lent|ritard|irregol|chius"


def packed_feed(spark: SparkSession, path: str, known: Sequence[str] = ()) -> DataFrame:
    """(sha256, table, row map) of every row of the feeds (zip files) at ``path``; feeds already ``known`` are skipped.

    A feed is unpacked as a stream in one task, a row at a time; its tables are read whole.
    """
    files = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), "content")
    files = files.where(~F.col("sha256").isin(*known)) if known else files

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    for table in TABLES:
                        if f"{table}.txt" not in z.namelist():
                            continue
                        held: list[dict] = []
                        with z.open(f"{table}.txt") as f:
                            for row in csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline="")):
                                held.append({k.strip(): v for k, v in row.items() if k is not None and v is not None})
                                if len(held) == 10_000:
                                    yield made(sha, table, held)
                                    held = []
                        yield made(sha, table, held)

    def made(sha: str, table: str, held: list[dict]) -> pa.RecordBatch:
        maps = pa.array([list(r.items()) for r in held], pa.map_(pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([sha] * len(held), pa.string()), pa.array([table] * len(held), pa.string()), maps], ["sha256", "table", "row"])

    return files.mapInArrow(rows, "sha256 string, table string, row map<string,string>")


def feed_table(rows: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """One table of :func:`packed_feed` with the named columns; what a feed lacks is null."""
    return rows.where(F.col("table") == table).select(*[F.try_element_at("row", F.lit(c)).alias(c) for c in columns])


def feed_days(rows: DataFrame) -> DataFrame:
    """First and last day on which any service is added or removed."""
    date = F.try_element_at("row", F.lit("date"))
    return rows.where("table = 'calendar_dates'").agg(F.min(date).alias("feed_start"), F.max(date).alias("feed_end"))


def positional_times(spark: SparkSession, path: str) -> DataFrame:
    """Stop times by position (trip, arrival, departure, stop, sequence) under any header.

    Lines are split where they lie, so large files are read in parallel.  A stray quote or fewer than
    four fields drop the line; a missing sequence is 0.
    """
    names = ("trip_id", "arrival", "departure", "stop_id", "seq")
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).options(header=True, quote="", mode="PERMISSIVE", enforceSchema=True).csv(path)
    clean = ~F.concat_ws("", *names).contains('"') & F.col("stop_id").isNotNull()
    return rows.where(clean).select("trip_id", F.coalesce(F.col("seq").try_cast("int"), F.lit(0)).alias("stop_sequence"), "stop_id", day_seconds(F.col("arrival")).alias("arrival_sec"), day_seconds(F.col("departure")).alias("departure_sec"))


def day_seconds(text: Column) -> Column:
    """Seconds of ``H:MM:SS`` or ``H:MM``, hours of any length; null if unreadable."""
    part = F.split(F.trim(text), ":")
    number = lambda k: F.get(part, F.lit(k)).try_cast("int")
    return number(0) * 3600 + number(1) * 60 + F.coalesce(number(2), F.lit(0))


def _walk(node, visit, depth: int = 0) -> None:
    if depth > MOST_DEPTH or not isinstance(node, dict | list):
        return
    if isinstance(node, dict):
        visit(node)
    for child in node if isinstance(node, list) else node.values():
        _walk(child, visit, depth + 1)


def _text(node: dict, *names: str) -> str | None:
    return next((node[n] for n in names if isinstance(node.get(n), str)), None)


def _found(raw: pd.Series, pick) -> pd.Series:
    """What ``pick`` finds in each payload's objects, outer ones first; nothing in unreadable payloads."""
    out = []
    for text in raw:
        held: list[dict] = []
        try:
            _walk(json.loads(text) if text else None, lambda node: held.extend(x for x in [pick(node)] if x))
        except ValueError:
            held = []
        out.append(held)
    return pd.Series(out)


def wait_messages(raw: Column) -> Column:
    """array<struct<line, message>> of the waiting messages anywhere in a JSON payload, up to six levels down."""

    def pick(node: dict) -> dict | None:
        message = _text(node, "WaitMessage")
        return None if message is None else {"line": _text(node, "Line", "line", "Code"), "message": message}

    return F.pandas_udf(lambda s: _found(s, pick), "array<struct<line:string,message:string>>")(raw)


def metro_status(raw: Column) -> Column:
    """array<struct<line, direction, status>> of the lines' states anywhere in a JSON payload; see :func:`disrupted`."""

    def pick(node: dict) -> dict | None:
        line, about, status = _text(node, "Line", "line"), _text(node, "Description", "description"), _text(node, "Status", "status")
        return None if line is None or about is None and status is None else {"line": line, "direction": about, "status": about if status is None else status}

    return F.pandas_udf(lambda s: _found(s, pick), "array<struct<line:string,direction:string,status:string>>")(raw)


def disrupted(direction: Column, status: Column) -> Column:
    return F.lower(F.concat_ws(" ", direction, status)).rlike(DISRUPTED)


def packed_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload) of zstd-packed raw payloads, unpacked for another reading."""

    def unpack(raw: pd.Series) -> pd.Series:
        import zstandard

        return pd.Series([zstandard.ZstdDecompressor().stream_reader(io.BytesIO(x)).read().decode("utf-8", "replace") for x in raw])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(path)
    return files.select("path", F.pandas_udf(unpack, "string")("content").alias("payload"))


SCOREBOARD = "events array<struct<id:string,date:string,name:string,competitions:array<struct<competitors:array<struct<homeAway:string,team:struct<displayName:string>>>>>>>"


def fixtures(raw: DataFrame, venues: DataFrame, column: str = "raw") -> DataFrame:
    """Calendar events of matches at known venues, padded before and after.

    ``venues`` (a few rows) has venue, team (a part of the home team's name), before_ms and after_ms.
    Matches without a readable start are left out; a match at a venue counts once.
    """
    e = raw.select(F.explode(F.from_json(column, SCOREBOARD)["events"]).alias("e"))
    home = F.get(F.filter(F.get("e.competitions", F.lit(0))["competitors"], lambda c: c["homeAway"] == "home"), F.lit(0))["team"]["displayName"]
    rows = e.select("e.id", "e.name", F.unix_millis(F.try_to_timestamp("e.date")).alias("start"), F.lower(home).alias("home")).where("start IS NOT NULL")
    v = F.broadcast(venues)  # a few rows
    met = rows.join(v, F.col("home").contains(F.col("team")))
    return met.select(F.col("id").alias("external_id"), F.concat_ws(" — ", "name", "venue").alias("title"), (F.col("start") - F.col("before_ms")).alias("start_epoch"), (F.col("start") + F.col("after_ms")).alias("end_epoch")).distinct()


FORECAST = "hourly struct<time:array<string>,precipitation:array<double>>"


def forecast_rain(raw: DataFrame, hour: str, column: str = "raw") -> DataFrame:
    """One row: mean rain of the points' forecasts for an hour (``yyyy-MM-ddTHH``), to two decimals; null if none has it."""
    h = raw.select(F.from_json(column, FORECAST)["hourly"].alias("h")).select(F.explode(F.arrays_zip("h.time", "h.precipitation")).alias("x"))
    return h.where(F.col("x.time").startswith(hour)).agg(F.round(F.avg("x.precipitation"), 2).alias("rain_mm"))


def gauge_rain(readings: DataFrame, most: int = 12) -> DataFrame:
    """One row: mean of the newest valid reading of up to ``most`` sensors, to two decimals.

    ``readings`` has sensor, ts and value; a negative value stands for no data and hides none before it.
    """
    newest = readings.groupBy("sensor").agg(F.max_by("value", F.when(F.col("value") >= 0, F.col("ts"))).alias("value")).orderBy("sensor").limit(most)
    return newest.agg(F.round(F.avg("value"), 2).alias("rain_mm"))


def rain(gauge: Column, gauge_at: Column, forecast: Column, forecast_at: Column, now: Column) -> Column:
    """The gauges' rain if it is an hour old at most, else the forecast's if it is three, else null."""
    fresh = lambda value, at, ms: F.when(now - at <= ms, value)
    return F.coalesce(fresh(gauge, gauge_at, 3_600_000), fresh(forecast, forecast_at, 10_800_000))


def reports(spark: SparkSession, folder: str, kind: str, most: int = 5) -> DataFrame:
    """(date, markdown) of the newest reports named ``kind-yyyy-MM-dd.md``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{kind}-*.md").load(folder)
    date = F.regexp_extract("path", rf"/{kind}-(\d{{4}}-\d{{2}}-\d{{2}})\.md$", 1)
    return files.select(date.alias("date"), F.decode("content", "UTF-8").alias("markdown")).where("date <> ''").orderBy(F.desc("date")).limit(most)


def digest(raw: bytes) -> str:
    """The sha256 that :func:`packed_feed` knows a feed by."""
    return hashlib.sha256(raw).hexdigest()
