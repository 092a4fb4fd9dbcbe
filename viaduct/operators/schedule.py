"""Timetable operators: trip summaries, versions, departures, legs, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.functions.semantics import bare_train_number, latest_per, rome_wall_to_epoch


def trip_summaries(times: DataFrame) -> DataFrame:
    return times.groupBy("trip_id").agg(
        F.min_by("stop_id", "stop_sequence").alias("first_stop_id"), F.max_by("stop_id", "stop_sequence").alias("last_stop_id"), F.count("*").alias("stop_count"),
        F.min_by("departure_sec", "stop_sequence").alias("dep_sec"), F.max_by("arrival_sec", "stop_sequence").alias("arr_sec"),
    )


def validity(text: Column) -> tuple[Column, Column]:
    """(from, to) of ``number-YYYY-MM-DD-YYYY-MM-DD``; null if it does not end so."""
    pattern = r"(\d{4}-\d{2}-\d{2})-(\d{4}-\d{2}-\d{2})$"
    return tuple(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in (1, 2))


def running(trips: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trips with each day on which the calendar adds their service; other exceptions do not run."""
    return trips.join(calendar.where("exception_type = 1").select("service_id", "date"), "service_id")


def active_trips(summaries: DataFrame, trips: DataFrame, date: str) -> DataFrame:
    """Rail trips of a day, one version for each train number: those whose validity covers the day
    first, then the latest validity, then the smallest trip id."""
    start, end = validity(F.col("validity"))
    day = F.concat_ws("-", F.lit(date[:4]), F.lit(date[4:6]), F.lit(date[6:]))
    rows = trips.where((F.col("date") == date) & (F.col("route_type") == 2)).select("trip_id", "route_id", bare_train_number(F.col("trip_short_name")).alias("train_number"), start.alias("valid_from"), F.coalesce((start <= day) & (day <= end), F.lit(False)).alias("covers"))
    joined = rows.join(summaries, "trip_id")
    best = latest_per(joined, ["train_number"], F.desc("covers"), F.col("valid_from").desc_nulls_last(), F.col("trip_id"))
    return best.select("train_number", "trip_id", "route_id", "first_stop_id", "last_stop_id", "stop_count", "dep_sec", "arr_sec")


def stop_departures(times: DataFrame, trips: DataFrame, summaries: DataFrame, stops: DataFrame, date: str, since: int, until: int, limit: int) -> DataFrame:
    """The next rail departures of every stop on a day, without terminating trains, ``limit`` for each
    stop before train numbers are made unique."""
    day = trips.where((F.col("date") == date) & (F.col("route_type") == 2)).select("trip_id", "route_id", bare_train_number(F.col("trip_short_name")).alias("train_number"))
    rows = times.where(F.col("departure_sec").between(since, until)).join(day, "trip_id").join(summaries.select("trip_id", "stop_count", "last_stop_id"), "trip_id").where("stop_sequence < stop_count")
    rows = rows.join(stops.select(F.col("stop_id").alias("last_stop_id"), F.col("stop_name").alias("headsign")), "last_stop_id", "left")
    first = rows.withColumn("k", F.row_number().over(_at("stop_id", "departure_sec", "trip_id"))).where(F.col("k") <= limit)
    return latest_per(first, ["stop_id", "train_number"], F.col("k")).select("stop_id", "train_number", "trip_id", "route_id", "departure_sec", "headsign")


def _at(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def legs(times: DataFrame, trips: DataFrame, origins: list[str], date: str) -> DataFrame:
    """All later stops reachable without a change from the given stops on a day."""
    day = trips.where(F.col("date") == date).select("trip_id")
    a = times.where(F.col("stop_id").isin(origins)).join(day, "trip_id").select("trip_id", F.col("stop_id").alias("from_stop_id"), F.col("stop_sequence").alias("from_seq"), "departure_sec")
    b = times.select("trip_id", F.col("stop_id").alias("to_stop_id"), F.col("stop_sequence").alias("to_seq"), "arrival_sec")
    return a.join(b, "trip_id").where("to_seq > from_seq").select("trip_id", "from_stop_id", "to_stop_id", "from_seq", "to_seq", "departure_sec", "arrival_sec")


def terminus_board(times: DataFrame, stops: DataFrame, since: int, until: int) -> DataFrame:
    """Departures with the name of the trip's last stop, which is found once for each trip."""
    last = times.groupBy("trip_id").agg(F.max_by("stop_id", "stop_sequence").alias("last_stop_id"))
    rows = times.where(F.col("departure_sec").between(since, until)).join(last, "trip_id")
    return rows.join(stops.select(F.col("stop_id").alias("last_stop_id"), F.col("stop_name").alias("headsign")), "last_stop_id", "left").select("stop_id", "trip_id", "stop_sequence", "departure_sec", "headsign")


def station_volume(times: DataFrame, trips: DataFrame, stops: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Distinct departing rail trips of each named station in a range of days."""
    days = trips.where(F.col("date").between(date_from, date_to) & (F.col("route_type") == 2)).select("trip_id")
    rows = times.join(days, "trip_id").join(stops.select("stop_id", "stop_name"), "stop_id")
    return rows.groupBy("stop_id", "stop_name").agg(F.count_distinct("trip_id").alias("departures"))


def expand_calendar(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, date): a row for each active day of the weekly calendar, then exceptions on top
    (type 1 adds a day, type 2 removes it)."""
    day = F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("date")
    flags = F.array("mon", "tue", "wed", "thu", "fri", "sat", "sun")
    base = calendar.select("service_id", flags.alias("flags"), day).where(F.get("flags", F.weekday("date")) == 1).select("service_id", "date")
    removed = exceptions.where("exception_type = 2").select("service_id", "date")
    added = exceptions.where("exception_type = 1").select("service_id", "date")
    return base.join(removed, ["service_id", "date"], "left_anti").unionByName(added).distinct()


def calendar_table(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, date, exception_type) of one feed: type 1 on each active day of its weekly calendar, overwritten by
    its exceptions, so both feeds' calendars read alike.

    Of several exceptions of a day the one with the largest ``row`` counts where they are numbered, else the
    largest type; calendars without both ends are left out.
    """
    day = F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("date")
    known = calendar.where("start_date IS NOT NULL AND end_date IS NOT NULL AND start_date <= end_date")
    base = known.select("service_id", F.array("mon", "tue", "wed", "thu", "fri", "sat", "sun").alias("flags"), day).where(F.get("flags", F.weekday("date")) == 1)
    order = F.struct(F.lit(1), *(["row"] if "row" in exceptions.columns else []), "exception_type").alias("o")
    both = base.select("service_id", "date", F.lit(1).alias("exception_type"), F.lit(0).alias("k")).unionByName(exceptions.groupBy("service_id", "date").agg(F.max_by("exception_type", order).cast("int").alias("exception_type")).withColumn("k", F.lit(1)))
    return both.groupBy("service_id", "date").agg(F.max_by("exception_type", "k").alias("exception_type"))


def discover(runs: DataFrame, now: int, ahead: int = 5_400_000, grace: int = 900_000, cap: int = 200) -> DataFrame:
    """Runs that have left or leave soon and have not been over for long, nearest departure first."""
    rows = runs.where((F.col("sched_dep_epoch") <= now + ahead) & (F.col("sched_arr_epoch") + grace >= now))
    return rows.orderBy(F.abs(F.col("sched_dep_epoch") - now), "run_id").limit(cap).select("run_id", "train_number", "sched_dep_epoch", "sched_arr_epoch")


def discover_trips(active: DataFrame, today: str, now: int, ahead_min: int = 90, grace_min: int = 15, cap: int = 200) -> DataFrame:
    """Trips (service_date, train_number, trip_id, dep_sec, arr_sec) of today's and yesterday's timetable that have left
    or leave soon and have not been over for long, at most ``cap`` of them.

    Of a train's trips of a day the first that fits counts; today's nearest departures come first, then
    yesterday's.  ``active`` has the rail trips of both days; their seconds may pass midnight.
    """
    since = F.floor((F.lit(now) - rome_wall_to_epoch(F.col("service_date"), F.lit(0)) * 1000) / 1000)
    fits = active.where("dep_sec IS NOT NULL AND train_number IS NOT NULL").where((F.col("dep_sec") <= since + ahead_min * 60) & (F.col("arr_sec").isNull() | (since <= F.col("arr_sec") + grace_min * 60)))
    first = latest_per(fits, ["service_date", "train_number"], F.col("dep_sec"), F.col("trip_id"))
    out = first.withColumn("sched_dep_epoch", rome_wall_to_epoch(F.col("service_date"), F.col("dep_sec")) * 1000).withColumn("sched_arr_epoch", rome_wall_to_epoch(F.col("service_date"), F.col("arr_sec")) * 1000)
    near = F.when(F.col("service_date") == today, F.abs(F.col("sched_dep_epoch") - now))
    return out.orderBy(near.asc_nulls_last(), "service_date", "train_number").limit(cap).select("service_date", "train_number", "trip_id", "sched_dep_epoch", "sched_arr_epoch")


def poll_interval(watched: Column, status: Column, dep: Column, arr: Column, now: Column, grace_ms: int = 900_000) -> Column:
    """Seconds between polls of a run: the nearer its departure the fewer; null once it is over."""
    over = (now > arr + grace_ms) | F.coalesce(status.isin("arrived", "cancelled"), F.lit(False))
    ahead = (dep - now) / 60_000
    return F.when(watched, 25).when(over, None).when(ahead > 60, 300).when(ahead > 30, 120).when(ahead > 10, 60).otherwise(30).cast("int")


def holidays(years: DataFrame) -> DataFrame:
    """Public holidays of each ``year``: fixed ones, Easter and the Monday after it."""
    y = F.col("year")
    idiv = lambda a, k: F.floor(a / k)
    a, b, c = y % 19, idiv(y, 100), y % 100
    d, e = idiv(b, 4), b % 4
    g = idiv(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = idiv(c, 4), c % 4
    el = (32 + 2 * e + 2 * i - h - k) % 7
    m = idiv(a + 11 * h + 19 * el, 433)
    month = idiv(h + el - 7 * m + 90, 25)
    easter = F.make_date(y.cast("int"), month.cast("int"), ((h + el - 7 * m + 33 * month + 19) % 32).cast("int"))
    # The days and their names.
    fixed = [(1, 1, "New Year"), (1, 6, "Epiphany"), (4, 25, "Liberation Day"), (5, 1, "Labour Day"), (6, 2, "Republic Day"), (8, 15, "Ferragosto"), (11, 1, "All Saints"), (12, 8, "Immaculate Conception"), (12, 25, "Christmas"), (12, 26, "St Stephen")]
    days = [F.struct(F.make_date(y.cast("int"), F.lit(mm), F.lit(dd)).alias("date"), F.lit(name).alias("name")) for mm, dd, name in fixed]
    days += [F.struct(easter.alias("date"), F.lit("Easter").alias("name")), F.struct(F.date_add(easter, 1).alias("date"), F.lit("Easter Monday").alias("name"))]
    return years.select(F.explode(F.array(*days)).alias("d")).select("d.date", "d.name")
