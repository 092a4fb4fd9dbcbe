"""Readings of the providers' raw payloads as columns and frames: JSON snapshots, look-up lines, curated files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions.semantics import hms_to_seconds, rome_wall_to_epoch

HALF_DAY, DAY = 43_200_000, 86_400_000

MIA = "train string, date string, stops array<struct<stop:string,arr:string,delay_min:double,ref:bigint>>"
VT = "numeroTreno string, fermate array<struct<id:string,programmata:string,effettiva:string,ritardo:int,binario:string>>"


def near_epoch(day: Column, hms: Column, ref: Column) -> Column:
    """Epoch ms of a local time on a service day, moved by a day if it is over 12 hours from ``ref``; null if unreadable."""
    naive = rome_wall_to_epoch(day, hms_to_seconds(hms)) * 1000
    return F.when(naive < ref - HALF_DAY, naive + DAY).when(naive > ref + HALF_DAY, naive - DAY).otherwise(naive)


def placeholder_null(text: Column) -> Column:
    """Null for blank, ``--`` and ``0``."""
    return F.when(~F.trim(text).isin("", "--", "0"), text)


def epoch_ms(text: Column) -> Column:
    """Epoch ms of a number in seconds or milliseconds; null if it is neither."""
    n = text.try_cast("double")
    return F.when(n > 1e12, n).when(n > 1e9, n * 1000).cast("long")


def mia_stops(raw: DataFrame, column: str = "raw") -> DataFrame:
    """One row per stop of each snapshot; delays in seconds, local times as instants.  Unreadable payloads give no row."""
    j = raw.select(F.from_json(column, MIA).alias("j")).select("j.train", "j.date", F.posexplode("j.stops").alias("pos", "s"))
    return j.select("train", "pos", F.col("s.stop").alias("stop_id"), near_epoch(F.col("date"), F.col("s.arr"), F.col("s.ref")).alias("arr_epoch"), F.floor(F.col("s.delay_min") * 60 + 0.5).alias("delay_sec"))


def vt_stops(raw: DataFrame, column: str = "raw") -> DataFrame:
    """One row per stop of each snapshot; the operator's estimate is the real time, else the planned one and the delay."""
    j = raw.select(F.from_json(column, VT).alias("j")).select(F.col("j.numeroTreno").alias("train"), F.posexplode("j.fermate").alias("pos", "s"))
    planned, real = epoch_ms(F.col("s.programmata")), epoch_ms(F.col("s.effettiva"))
    return j.select("train", "pos", F.col("s.id").alias("stop_id"), planned.alias("sched_epoch"), F.coalesce(real, planned + F.col("s.ritardo").cast("long") * 1000).alias("eta_epoch"), placeholder_null(F.col("s.binario")).alias("platform"))


def autocomplete(lines: DataFrame, column: str = "line") -> DataFrame:
    """(label, number, origin, departure) of lines ``label|number-origin-epoch``; others are left out."""
    part = lambda k: F.regexp_extract(column, r"^\s*([^|]*)\|(.+)-([^-]+)-([^-]+?)\s*$", k)
    rows = lines.select(part(1).alias("label"), part(2).alias("train_number"), part(3).alias("origin"), epoch_ms(part(4)).alias("departure"))
    return rows.where("departure IS NOT NULL AND train_number <> '' AND origin <> ''")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Historical runs, one JSON object a line; broken lines and other kinds of train are left out."""
    return spark.read.schema("type string, train string, stops array<struct<node:bigint,arr:bigint,dep:bigint>>").option("mode", "DROPMALFORMED").json(path).where(F.col("type").isin("REG", "MET"))


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (node, name, lat, lon); rows without finite coordinates are left out."""
    rows = spark.read.schema("node string, name string, lat string, lon string").option("sep", "\t").csv(path)
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    return rows.select("node", "name", lat.alias("lat"), lon.alias("lon")).where((F.abs("lat") <= 90) & (F.abs("lon") <= 180))


def strikes(spark: SparkSession, path: str) -> DataFrame:
    """Curated strikes from JSON files; an end that is not after its start is left out."""
    return spark.read.schema("title string, start bigint, stop bigint").option("multiLine", True).json(path).where("stop > start")


def feed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of an unpacked timetable feed: quoted fields may hold line ends and doubled quotes; blank rows are left out."""
    rows = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False).csv(f"{folder}/{name}.txt")
    named = rows.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in rows.columns})
    return named.dropna("all")


def metro_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The second timetable feed: stops, routes, trips, stop_times in seconds and calendar dates.

    Trips are known by their id alone.  Times may pass midnight; rows of stop_times with a quote or fewer than
    four fields are malformed and left out.  Days come from calendar.txt where there is one, overwritten by
    calendar_dates.txt, a missing type there being 1.
    """
    from pyspark.errors import AnalysisException

    from viaduct.operators.schedule import calendar_table

    def read(name: str, columns: dict[str, str]) -> DataFrame:
        rows = feed(spark, folder, name)
        return rows.select(*[(F.col(c).try_cast(kind) if c in rows.columns else F.lit(None).cast(kind)).alias(c) for c, kind in columns.items()])

    def optional(name: str, columns: dict[str, str]) -> DataFrame:
        try:
            return read(name, columns)
        except AnalysisException:
            return spark.createDataFrame([], ", ".join(f"{c} {kind}" for c, kind in columns.items()))

    lines = spark.read.text(f"{folder}/stop_times.txt").where(~F.col("value").contains('"'))
    cells = F.split(F.regexp_replace("value", "\r$", ""), ",")
    times = lines.where((F.size(cells) >= 4) & ~F.col("value").startswith("trip_id") & ~F.col("value").startswith("\ufefftrip_id"))
    cell = lambda k: F.get(cells, F.lit(k))
    stop_times = times.select(cell(0).alias("trip_id"), F.coalesce(cell(4).try_cast("int"), F.lit(0)).alias("stop_sequence"), cell(3).alias("stop_id"), hms_to_seconds(F.trim(cell(1))).alias("arrival_sec"), hms_to_seconds(F.trim(cell(2))).alias("departure_sec"))
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    weekly = optional("calendar", {"service_id": "string", "start_date": "string", "end_date": "string"} | dict.fromkeys(days, "int"))
    as_date = lambda c: F.to_date(F.try_to_timestamp(F.col(c), F.lit("yyyyMMdd"))).alias(c)
    weekly = weekly.select("service_id", as_date("start_date"), as_date("end_date"), *[F.col(d).alias(d[:3]) for d in days])
    exceptions = optional("calendar_dates", {"service_id": "string", "date": "string", "exception_type": "int"}).select("service_id", as_date("date"), F.coalesce("exception_type", F.lit(1)).alias("exception_type"))
    return {
        "stops": read("stops", {"stop_id": "string", "stop_name": "string", "stop_lat": "double", "stop_lon": "double"}),
        "routes": read("routes", {"route_id": "string", "route_short_name": "string", "route_long_name": "string", "route_type": "int"}),
        "trips": read("trips", {"trip_id": "string", "route_id": "string", "service_id": "string"}),
        "stop_times": stop_times,
        "calendar_dates": calendar_table(weekly, exceptions),
    }
