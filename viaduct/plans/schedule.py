"""Timetable, upsert, set and scalar-function queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from viaduct.functions import semantics as sem
from viaduct.operators import export as ex
from viaduct.operators import schedule as sc
from viaduct.operators import stop_events as se
from viaduct.operators import upserts as up
from viaduct.plans.segments import AS_OF
from viaduct.sources import bindings as b
from viaduct.sources.bindings import oracle

#: An instant at which some of the bound runs are about to leave.
POLL_AT = 837_835_440_000
#: Four in the morning of 2 January 1996 in Rome.
FOUR, NEXT_DAY = 820_551_600_000, "19960102"
DAY, DAY_FROM, DAY_TO = "19960101", "19950101", "19961231"


def calendar(s, d):
    """Weekly calendars by service (one for each nation) and their exceptions."""
    n = b.table(s, d, "nation")
    k = F.col("n_nationkey").cast("int")
    flags = [((F.shiftright(k, i % 5) + i) % 2).cast("int").alias(day) for i, day in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"))]
    cal = n.select(F.concat(F.lit("V"), k.cast("string")).alias("service_id"), F.date_add(F.lit("2024-01-01").cast("date"), k).alias("start_date"), F.date_add(F.lit("2024-02-01").cast("date"), k * 2).alias("end_date"), *flags)
    exc = n.select(F.concat(F.lit("V"), k.cast("string")).alias("service_id"), F.explode(F.array(F.struct(F.date_add(F.lit("2024-01-20").cast("date"), k % 5).alias("date"), F.lit(2).alias("t")), F.struct(F.date_add(F.lit("2024-03-01").cast("date"), k).alias("date"), F.lit(1).alias("t")))).alias("x"))
    return cal, exc.select("service_id", "x.date", F.col("x.t").alias("exception_type"))


def calendar_dates(s):
    """A week of service days: each of the bound services runs on two of three."""
    k, n = F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("n")
    rows = s.range(50).select(k, n).withColumn("date", F.date_format(F.date_add(F.to_date(F.lit(DAY), "yyyyMMdd"), F.col("n")), "yyyyMMdd"))
    return rows.select(F.concat(F.lit("V"), k.cast("string")).alias("service_id"), "date", F.when((k + F.col("n")) % 3 != 0, 1).otherwise(2).alias("exception_type"))


def on_calendar(s, d):
    """Trips with the days on which the calendar has them run."""
    return sc.running(b.gtfs_trips(s, d).drop("date"), calendar_dates(s))


def discovered(s, d):
    """What is on the rails at four in the morning of the second day, of both days' timetables; runs count for ten hours
    after their end, as the bound ones end in the evening."""
    summaries, trips = sc.trip_summaries(b.gtfs_stop_times(s, d)), on_calendar(s, d)
    days = [sc.active_trips(summaries, trips, day).withColumn("service_date", F.lit(f"{day[:4]}-{day[4:6]}-{day[6:]}")) for day in (DAY, NEXT_DAY)]
    return sc.discover_trips(days[0].unionByName(days[1]), "1996-01-02", FOUR, grace_min=600)


def null_safe_match(s, d):
    """Runs of one train and day that agree on a trip which either side may lack."""
    trip = F.when(F.col("run_id") % 2 == 0, F.col("gtfs_trip_id"))
    a, x = b.runs(s, d).withColumn("trip", trip).alias("a"), b.runs(s, d).withColumn("trip", trip).alias("x")
    return a.join(x, F.expr("a.train_number = x.train_number AND a.service_date = x.service_date AND a.trip <=> x.trip")).select("a.run_id", "a.gtfs_trip_id", F.col("x.run_id").alias("with_run"))


def poll_intervals(s, d):
    r = b.runs(s, d).withColumn("status", F.get(F.array(F.lit("running"), F.lit("arrived"), F.lit("cancelled"), F.lit(None)), (F.col("run_id") % 4).cast("int")))
    now = F.lit(POLL_AT) + (F.col("run_id") % 7) * 600_000
    return r.select("run_id", sc.poll_interval(F.col("run_id") % 50 == 0, F.col("status"), F.col("sched_dep_epoch"), F.col("sched_arr_epoch"), now).alias("interval_sec"))


def updates(s, d):
    o = b.observations(s, d)
    return o.withColumn("crowding", F.when(F.col("id") % 3 == 0, (F.col("id") % 5).cast("int"))).withColumn("stop_id", F.concat(F.lit("S"), F.lpad((F.substring("location_id", 2, 5).cast("int") % 7).cast("string"), 5, "0")))


def fetches(s, d):
    o = b.observations(s, d)
    return o.select("source", F.col("run_id").alias("entity_key"), "ts", "id", F.col("delay_seconds").isNotNull().alias("ok"), F.md5(F.coalesce((F.col("delay_seconds") % 3).cast("string"), F.lit("-"))).alias("payload_hash"))


def told_stops(s, d):
    """Three updates of each call from two sources, with other sequences and with what they do not know missing."""
    j, run = F.col("j"), F.col("run_id")
    e = b.stop_events(s, d).withColumn("j", F.explode(F.array(*map(F.lit, range(3)))))
    at = F.col("sched_arr_epoch") - 600_000 + (run * 7 + F.col("stop_sequence") * 3 + j * 5) % 11 * 60_000
    some = lambda c, k: F.when((run + F.col("stop_sequence") + j) % k != 0, F.col(c)).alias(c)
    return e.select(
        "run_id", "stop_id", F.date_format(F.timestamp_millis(F.col("sched_arr_epoch") - F.col("stop_sequence") * 600_000), "yyyy-MM-dd").alias("service_date"), at.alias("ts"), (run * 100 + F.col("stop_sequence") * 10 + j).alias("id"), F.when(run % 6 != j, F.col("stop_sequence") + j).alias("stop_sequence"),
        (F.col("sched_arr_epoch") + j * 1000).alias("sched_arr_epoch"), some("sched_dep_epoch", 4), F.when(j > 0, F.lit("9")).alias("platform_sched"), F.when(j != 1, F.col("sched_arr_epoch") + j * 60_000).alias("op_pred_arr_epoch"), F.when(j == 1, F.col("sched_dep_epoch")).alias("op_pred_dep_epoch"),
        some("actual_dep_epoch", 3), F.when(j == 2, 1).when(j == 1, 0).alias("platform_is_actual"), F.when(j == 1, "viaggiatreno").otherwise("mia").alias("source"), some("actual_arr_epoch", 2), some("platform_actual", 3), some("arr_delay_sec", 5), some("dep_delay_sec", 2), some("cancelled", 3),
    )


def recovery(s, d):
    """Whether trains recover two minutes; every ninth has no delay, every seventh a wide forecast."""
    run = F.col("run_id")
    p = b.scored(s, d).withColumn("late", F.when(run % 9 != 0, run * 53 % 900 - 100)).withColumn("p90", F.col("our_p90") + F.when(run % 7 == 0, 1_500_000).otherwise(0))
    told = p.withColumn("f", sem.recovery_forecast(F.col("late"), F.col("sched_arr_epoch"), F.col("our_p10"), F.col("our_p50"), F.col("p90")))
    return told.select("prediction_id", sem.recovery_prediction(F.col("late"), F.col("sched_arr_epoch"), F.col("our_p50")).alias("expected_gain_sec"), "f.prob_recover", "f.expected_delay_sec")


def sightings(s, d):
    st = b.table(s, d, "part")
    k = F.col("p_partkey")
    return st.select(k.alias("id"), F.concat(F.lit(" Bivio/PC "), (k % 300).cast("string"), F.when(k % 4 == 0, "--").otherwise("")).alias("name"), (k * 1000).alias("seen_at"), F.when(k % 3 == 0, 45.0 + (k % 50) / 100).alias("lat"), F.when(k % 3 == 0, 9.0 + (k % 70) / 100).alias("lon"), F.when(k % 5 == 0, "BIVIO").when(k % 2 == 0, "PASSENGER_STATION").otherwise("UNKNOWN").alias("type"))


def features(s, d):
    e = b.table(s, d, "events")
    return e.select("event_id", ex.feature_int(F.col("props"), "k").alias("k"), ex.feature_number(F.col("props"), "nope", 0.0).alias("nope"))


def with_features(s, d):
    """Scored predictions with a confidence and features; every seventh run's anchor and delay have the wrong types, every 41st's are broken."""
    p = b.scored(s, d)
    run = F.col("run_id")
    number = lambda i: F.when((run + i) % 5 != 0, (run * (i + 3) % 97) / 4.0 + F.when(F.lit(ex.FEATURES[i][2] == "long"), F.col("generated_at")).otherwise(0))
    cells = [number(i).alias(key) for i, (key, _, kind, _) in enumerate(ex.FEATURES) if kind != "string"]
    kind = F.when(run % 3 == 0, "actual_dep").when(run % 3 == 1, "").alias("anchorKind")
    made = F.when(run % 41 == 0, '{"anchorKind": ').when(run % 7 == 0, '{"anchorKind": 5, "originDepDelaySec": "12", "holiday": true, "networkDelaySec": -2.5}').otherwise(F.to_json(F.struct(kind, *cells)))
    return p.withColumn("confidence", (run % 11) / 10.0).withColumn("features_json", F.when(run % 43 != 0, made))


def exported(s, d):
    return ex.export_rows(with_features(s, d), b.run_facts(s, d))


def export_round_trip(s, d):
    """Writes the export in Hive layout, reads it back and returns what differs: no rows."""
    from viaduct.sources.landing import scratch

    rows = exported(s, d)
    folder = scratch(s, "export")
    ex.write_export(rows, folder)
    return ex.differences(rows, s.read.schema(rows.schema).parquet(folder))


def instants(s, d):
    """Instants around both clock changes of 2024 and of the orders."""
    o = b.table(s, d, "orders").select((sem.ms(F.col("o_orderdate")) + (F.col("o_orderkey") % 1440) * 60000).alias("epoch_ms"), F.col("o_orderkey").alias("k"))
    edge = s.range(0, 96).select((F.lit(1711843200000) + F.col("id") * 900000).alias("epoch_ms"), (-F.col("id") - 1).alias("k"))
    edge2 = s.range(0, 96).select((F.lit(1729980000000) + F.col("id") * 900000).alias("epoch_ms"), (-F.col("id") - 1001).alias("k"))
    return o.unionByName(edge).unionByName(edge2)


def numbers(s, d):
    return b.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", (F.col("l_quantity") - 25).alias("x"))


QUERIES = {
    "a01_trip_summaries": lambda s, d: sc.trip_summaries(b.gtfs_stop_times(s, d)),
    "j01_active_trips": lambda s, d: sc.active_trips(sc.trip_summaries(b.gtfs_stop_times(s, d)), on_calendar(s, d), DAY),
    "j02_stop_departures": lambda s, d: sc.stop_departures(b.gtfs_stop_times(s, d), on_calendar(s, d), sc.trip_summaries(b.gtfs_stop_times(s, d)), b.stops(s, d), DAY, 30000, 36000, 20),
    "j03_legs": lambda s, d: sc.legs(b.gtfs_stop_times(s, d), on_calendar(s, d), ["S00001", "S00002", "S00003"], DAY),
    "j04_terminus_board": lambda s, d: sc.terminus_board(b.gtfs_stop_times(s, d), b.stops(s, d), 30000, 33000),
    "j05_station_volume": lambda s, d: sc.station_volume(b.gtfs_stop_times(s, d), b.gtfs_trips(s, d), b.stops(s, d), DAY_FROM, DAY_TO),
    "p07_service_day": lambda s, d: on_calendar(s, d).where(F.col("date") == DAY).select("trip_id", "service_id"),
    "src03_validity": lambda s, d: b.gtfs_trips(s, d).select("trip_id", *[c.alias(n) for c, n in zip(sc.validity(F.col("validity")), ("valid_from", "valid_to"), strict=True)]),
    "src04_feed_calendar": lambda s, d: sc.calendar_table(*calendar(s, d)).select("service_id", F.date_format("date", "yyyyMMdd").alias("date"), "exception_type"),
    "src04_calendar": lambda s, d: sc.expand_calendar(*calendar(s, d)).select("service_id", F.date_format("date", "yyyyMMdd").alias("date")),
    "src18_holidays": lambda s, d: sc.holidays(b.table(s, d, "orders").select(F.year("o_orderdate").cast("long").alias("year")).distinct()).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "name"),
    "p05_stop_search": lambda s, d: b.stops(s, d).where(F.col("stop_name").ilike("%r#0000000%1%")).orderBy("stop_name").limit(20).select("stop_id", "stop_name"),
    "p06_null_safe_match": lambda s, d: null_safe_match(s, d),
    "p06_null_safe_match_whole": lambda s, d: b.runs(s, d).alias("a").join(b.runs(s, d).select("run_id", F.when(F.col("run_id") % 4 != 0, F.col("gtfs_trip_id")).alias("gtfs_trip_id")).alias("x"), F.expr("a.gtfs_trip_id <=> x.gtfs_trip_id AND a.run_id = x.run_id")).select("a.run_id", "a.gtfs_trip_id"),
    "p08_platform_sanity": lambda s, d: b.stop_events(s, d).select("run_id", "stop_sequence", F.concat("platform_actual", F.when(F.col("run_id") % 3 == 0, "bis").otherwise("")).alias("p")).select("run_id", "stop_sequence", F.when(F.col("p").try_cast("int").between(1, 30), F.col("p")).alias("platform")),
    "p09_bare_train_number": lambda s, d: b.gtfs_trips(s, d).select("trip_id", sem.bare_train_number(F.col("trip_short_name")).alias("train_number")),
    "p16_poll_interval": lambda s, d: poll_intervals(s, d),
    "p17_discover_trips": discovered,
    "p17_discover": lambda s, d: sc.discover(b.runs(s, d), POLL_AT),
    "a33_feed_range": lambda s, d: b.gtfs_trips(s, d).agg(F.min("date").alias("feed_start"), F.max("date").alias("feed_end")),
    "j24_consecutive_stops": lambda s, d: (lambda t: t.alias("a").join(t.alias("x"), F.expr("a.trip_id = x.trip_id AND x.stop_sequence = a.stop_sequence + 1")).groupBy(F.col("a.stop_id").alias("from_stop_id"), F.col("x.stop_id").alias("to_stop_id")).agg(F.count("*").alias("n")))(b.gtfs_stop_times(s, d)),
    "u01_stop_event_merge": lambda s, d: se.view(se.merged(se.states(told_stops(s, d)))),
    "u01_observation_merge": lambda s, d: up.merge_stop_events(updates(s, d), ["run_id", "stop_id"], ["ts", "id"], ["source", "observed_at"], ["delay_seconds", "crowding"], ["ts"]),
    "u02_run_enrichment": lambda s, d: up.enrich_runs(updates(s, d), "run_id", ["ts", "id"], ["delay_seconds", "crowding", "observed_at"]),
    "u03_provider_health": lambda s, d: up.provider_health(fetches(s, d)),
    "u04_rail_locations": lambda s, d: up.rail_locations(sightings(s, d)),
    "u05_last_version": lambda s, d: up.last_version(b.observations(s, d), ["run_id", "source"], F.desc("ts"), F.desc("id")).select("run_id", "source", "id", "ts", "delay_seconds"),
    "u06_alert_dedup": lambda s, d: up.distinct_alerts(b.table(s, d, "documents"), ["source", "text"], "doc_id"),
    "u07_calendar_upsert": lambda s, d: up.merge_stop_events(b.observations(s, d), ["source", "location_id"], ["id"], ["ts", "delay_seconds"], [], ["ts"]),
    "u08_stats_upsert": lambda s, d: (lambda t: up.upsert(t.where("l_linenumber <= 3").groupBy("l_partkey").agg(F.count("*").alias("n"), F.lit("old").alias("version")), t.where("l_linenumber > 4").groupBy("l_partkey").agg(F.count("*").alias("n"), F.lit("new").alias("version")), ["l_partkey"]))(b.table(s, d, "lineitem")),
    "u09_first_mapping": lambda s, d: up.last_version(b.observations(s, d), ["source", "location_id"], F.col("ts"), F.col("id")).select("source", "location_id", "run_id"),
    "u10_fill_crowding": lambda s, d: up.fill_nulls(updates(s, d).select("run_id", "ts", "source", "id", "crowding"), updates(s, d).where("id % 2 = 0").select("run_id", "ts", "source", F.lit(9).alias("crowding")), ["run_id", "ts", "source"], "crowding").select("id", "crowding"),
    "snk02_changed_snapshots": lambda s, d: up.changed_snapshots(fetches(s, d)).select("id", "changed"),
    "snk04_backfill_types": lambda s, d: b.stop_events(s, d).select("run_id", "stop_id", F.coalesce("stop_sequence", F.lit(0)).alias("stop_sequence"), F.timestamp_millis("sched_arr_epoch").cast("timestamp_ntz").alias("sched_arr")),
    "snk05_export": exported,
    "snk07_round_trip": export_round_trip,
    "snk08_retention": lambda s, d: up.retain(b.stop_events(s, d), "sched_arr_epoch", AS_OF, 365).groupBy("stop_id").agg(F.count("*").alias("n")),
    "p01_features": features,
    "w21_newest_n": lambda s, d: up.last_version(b.observations(s, d), ["source", "location_id"], F.desc("ts"), F.desc("id")).orderBy(F.desc("ts"), F.desc("id")).limit(20).select("id", "ts"),
    "s01_union_keys": lambda s, d: b.stop_events(s, d).select("stop_id").union(b.stops(s, d).select("stop_id")).distinct(),
    "s01_union_keys_whole": lambda s, d: b.stop_events(s, d).select("stop_id").union(b.stops(s, d).select("stop_id")).distinct(),
    "s03_union_networks": lambda s, d: b.stops(s, d).select("stop_id", "stop_name", F.lit("rail").alias("network")).unionByName(b.table(s, d, "customer").select(F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("stop_id"), F.col("c_name").alias("stop_name"), F.lit("metro").alias("network"))),
    "s03_union_networks_whole": lambda s, d: b.stops(s, d).select("stop_id", "stop_name", F.lit("rail").alias("network")).unionByName(b.table(s, d, "customer").select(F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("stop_id"), F.col("c_name").alias("stop_name"), F.lit("metro").alias("network"))),
    "s05_unmapped_stops": lambda s, d: b.stop_events(s, d).join(b.stops(s, d), "stop_id", "left_anti").select("stop_id").distinct(),
    "s06_distinct_pairs": lambda s, d: b.stop_events(s, d).select("stop_id", "platform_actual").dropDuplicates(),
    "fn_rome_time": lambda s, d: instants(s, d).select("k", sem.rome_ymd(F.col("epoch_ms")).alias("ymd"), sem.rome_hms(F.col("epoch_ms")).alias("hms"), sem.is_peak(sem.rome_hour(F.col("epoch_ms"))).alias("peak")),
    "fn_rome_wall": lambda s, d: b.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), sem.rome_wall_to_epoch(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), F.col("o_orderkey") % 400 * 300).alias("epoch")),
    "fn_js_round": lambda s, d: numbers(s, d).groupBy(sem.js_round(F.col("x") / 2).cast("long").alias("r")).count().withColumnRenamed("count", "n"),
    "fn_slug": lambda s, d: sightings(s, d).select("id", sem.slug(F.col("name")).alias("slug"), sem.name_key(F.col("name")).alias("key")),
    "fn_run_key": lambda s, d: b.runs(s, d).select("run_id", F.concat_ws("|", "operator", "service_date", "train_number", F.coalesce("gtfs_trip_id", F.lit("?")), F.lpad(F.floor(F.col("sched_dep_epoch") / 1000 % 86400).cast("string"), 6, "0")).alias("run_key")),
    "fn_wait_message": lambda s, d: b.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 == 0, "in arrivo").when(F.col("o_orderkey") % 4 == 1, F.concat((F.col("o_orderkey") % 30).cast("string"), F.lit(" min"))).when(F.col("o_orderkey") % 4 == 2, "ricalcolo").otherwise("no serv.").alias("m")).select("k", sem.wait_seconds(F.col("m")).alias("seconds"), sem.wait_flag(F.col("m")).alias("flag")),
    "fn_hms_seconds": lambda s, d: b.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"), F.when(F.col("o_orderkey") % 3 == 0, ":05").when(F.col("o_orderkey") % 3 == 1, "").otherwise("x")).alias("t")).select("k", sem.hms_to_seconds(F.col("t")).cast("long").alias("seconds")),
    "fn_normal_cdf": lambda s, d: numbers(s, d).select((F.col("x") / 8).alias("x")).distinct().select("x", F.round(sem.normal_cdf(F.col("x")), 6).alias("p")),
    "fn_recovery": recovery,
    "fn_quantile_cdf": lambda s, d: b.scored(s, d).select("prediction_id", F.round(sem.quantile_cdf(F.col("actual_arr_epoch"), F.col("our_p10"), F.col("our_p50"), F.col("our_p90")), 6).alias("p")),
}

SUM = """summ AS (SELECT trip_id, arg_min(stop_id, stop_sequence) AS first_stop_id, arg_max(stop_id, stop_sequence) AS last_stop_id, count(*) AS stop_count, arg_min(departure_sec, stop_sequence) AS dep_sec, arg_max(arrival_sec, stop_sequence) AS arr_sec FROM times GROUP BY trip_id)"""
NUM = "nullif(trim(string_split(trip_short_name, ' - ')[-1]), '')"
UPD = "upd AS (SELECT *, CASE WHEN id % 3 = 0 THEN CAST(id % 5 AS INT) END AS crowding, 'S' || lpad(CAST(CAST(substr(location_id, 2) AS INT) % 7 AS VARCHAR), 5, '0') AS stop_id FROM obs)"
FETCH = "fe AS (SELECT source, run_id AS entity_key, ts, id, delay_seconds IS NOT NULL AS ok, md5(coalesce(CAST(delay_seconds % 3 AS VARCHAR), '-')) AS payload_hash FROM obs)"
TOLD_STOPS = """t0 AS (SELECT se.*, j, run_id + stop_sequence + j AS k FROM se, range(3) t(j)),
td AS (SELECT run_id, stop_id, strftime(make_timestamp((sched_arr_epoch - stop_sequence * 600000) * 1000), '%Y-%m-%d') AS service_date, sched_arr_epoch - 600000 + (run_id * 7 + stop_sequence * 3 + j * 5) % 11 * 60000 AS ts, run_id * 100 + stop_sequence * 10 + j AS id, CASE WHEN run_id % 6 <> j THEN CAST(stop_sequence + j AS INT) END AS stop_sequence,
  sched_arr_epoch + j * 1000 AS sched_arr_epoch, CASE WHEN k % 4 <> 0 THEN sched_dep_epoch END AS sched_dep_epoch, CASE WHEN j > 0 THEN '9' END AS platform_sched, CASE WHEN j <> 1 THEN sched_arr_epoch + j * 60000 END AS op_pred_arr_epoch, CASE WHEN j = 1 THEN sched_dep_epoch END AS op_pred_dep_epoch,
  CASE WHEN k % 3 <> 0 THEN actual_dep_epoch END AS actual_dep_epoch, CASE j WHEN 2 THEN 1 WHEN 1 THEN 0 END AS platform_is_actual, CASE WHEN j = 1 THEN 'viaggiatreno' ELSE 'mia' END AS source, CASE WHEN k % 2 <> 0 THEN actual_arr_epoch END AS actual_arr_epoch, CASE WHEN k % 3 <> 0 THEN platform_actual END AS platform_actual,
  CASE WHEN k % 5 <> 0 THEN arr_delay_sec END AS arr_delay_sec, CASE WHEN k % 2 <> 0 THEN dep_delay_sec END AS dep_delay_sec, CASE WHEN k % 3 <> 0 THEN cancelled END AS cancelled FROM t0)"""
SIGHT = """si AS (SELECT p_partkey AS id, ' Bivio/PC ' || (p_partkey % 300) || CASE WHEN p_partkey % 4 = 0 THEN '--' ELSE '' END AS name, p_partkey * 1000 AS seen_at, CASE WHEN p_partkey % 3 = 0 THEN CAST(45.0 AS DOUBLE) + (p_partkey % 50) / 100.0 END AS lat,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(9.0 AS DOUBLE) + (p_partkey % 70) / 100.0 END AS lon, CASE WHEN p_partkey % 5 = 0 THEN 'BIVIO' WHEN p_partkey % 2 = 0 THEN 'PASSENGER_STATION' ELSE 'UNKNOWN' END AS type FROM part)"""
SLUG = "CASE WHEN {s} = '' THEN 'unnamed' ELSE {s} END".format(s="regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
SECS = "(sched_arr_epoch - generated_at) // 1000"


def _cell(i: int, column: str, kind: str, default: int | None) -> str:
    base = "generated_at + " if kind == "long" else ""
    value = f"CASE WHEN run_id % 41 <> 0 AND run_id % 7 <> 0 AND (run_id + {i}) % 5 <> 0 THEN {base}(run_id * {i + 3} % 97) / 4.0 END"
    if column == "f_network_delay_sec":
        value = f"CASE WHEN run_id % 41 <> 0 AND run_id % 7 = 0 THEN -2.5 ELSE {value} END"
    value = value if default is None else f"coalesce({value}, {default})"
    return f"CAST({value} AS DOUBLE) AS {column}" if kind == "double" else f"CAST(floor({value} + 0.5) AS {'BIGINT' if kind == 'long' else 'INTEGER'}) AS {column}"


EXPORTED = f"""exported AS (SELECT service_date, train_number, operator, route_id AS line, run_id, prediction_id, s.stop_id, model_version, generated_at, CAST({SECS.replace('sched', 's.sched')} AS INTEGER) AS horizon_sec,
  CASE WHEN {SECS.replace('sched', 's.sched')} <= 300 THEN '0-5m' WHEN {SECS.replace('sched', 's.sched')} <= 900 THEN '5-15m' WHEN {SECS.replace('sched', 's.sched')} <= 1800 THEN '15-30m' WHEN {SECS.replace('sched', 's.sched')} <= 3600 THEN '30-60m' ELSE '60m+' END AS horizon_bucket,
  s.sched_arr_epoch, operator_eta_epoch, our_p10, our_p50, our_p90, CAST(run_id % 11 / 10.0 AS DOUBLE) AS confidence, actual_arr_epoch, CAST(operator_error_sec AS INTEGER) AS operator_error_sec, CAST(our_error_sec AS INTEGER) AS our_error_sec,
  CASE WHEN run_id % 41 <> 0 AND run_id % 7 <> 0 AND run_id % 3 = 0 THEN 'actual_dep' END AS f_anchor_kind, {', '.join(_cell(i, column, kind, default) for i, (_, column, kind, default) in enumerate(ex.FEATURES) if kind != 'string')}
  FROM scored s JOIN runs USING (run_id) WHERE run_id % 43 <> 0)"""

ON_DAY = f"""cal AS (SELECT 'V' || k AS service_id, strftime(strptime('{DAY}', '%Y%m%d') + to_days(CAST(n AS INT)), '%Y%m%d') AS date, CASE WHEN (k + n) % 3 <> 0 THEN 1 ELSE 2 END AS exception_type FROM range(50) a(k), range(7) c(n)),
ontrips AS (SELECT t.* FROM trips t JOIN cal c ON c.service_id = t.service_id AND c.date = '{DAY}' AND c.exception_type = 1)"""

ORACLE_SQL = {
    "p07_service_day": oracle("trips", f"WITH {ON_DAY} SELECT trip_id, service_id FROM ontrips"),
    "a01_trip_summaries": oracle("se times", f"WITH {SUM} SELECT * FROM summ"),
    "j01_active_trips": oracle("se trips times", f"WITH {ON_DAY}, {SUM}, a AS (SELECT {NUM} AS train_number, trip_id, route_id, regexp_extract(validity, '(\\d{{4}}-\\d{{2}}-\\d{{2}})-(\\d{{4}}-\\d{{2}}-\\d{{2}})$', 1) AS f, regexp_extract(validity, '(\\d{{4}}-\\d{{2}}-\\d{{2}})-(\\d{{4}}-\\d{{2}}-\\d{{2}})$', 2) AS t FROM ontrips WHERE route_type = 2) SELECT train_number, trip_id, route_id, first_stop_id, last_stop_id, stop_count, dep_sec, arr_sec FROM a JOIN summ USING (trip_id) QUALIFY row_number() OVER (PARTITION BY train_number ORDER BY (f <= '1996-01-01' AND '1996-01-01' <= t) DESC, f DESC, trip_id) = 1"),
    "j02_stop_departures": oracle("se trips times stops", f"WITH {ON_DAY}, {SUM}, a AS (SELECT t.stop_id, {NUM} AS train_number, trip_id, route_id, departure_sec, stop_name AS headsign, row_number() OVER (PARTITION BY t.stop_id ORDER BY departure_sec, trip_id) AS k FROM times t JOIN ontrips USING (trip_id) JOIN summ USING (trip_id) LEFT JOIN stops s ON s.stop_id = last_stop_id WHERE route_type = 2 AND departure_sec BETWEEN 30000 AND 36000 AND stop_sequence < stop_count) SELECT stop_id, train_number, trip_id, route_id, departure_sec, headsign FROM a WHERE k <= 20 QUALIFY row_number() OVER (PARTITION BY stop_id, train_number ORDER BY k) = 1"),
    "j03_legs": oracle("se trips times", f"WITH {ON_DAY} SELECT a.trip_id, a.stop_id AS from_stop_id, x.stop_id AS to_stop_id, a.stop_sequence AS from_seq, x.stop_sequence AS to_seq, a.departure_sec, x.arrival_sec FROM times a JOIN ontrips USING (trip_id) JOIN times x ON x.trip_id = a.trip_id AND x.stop_sequence > a.stop_sequence WHERE a.stop_id IN ('S00001', 'S00002', 'S00003')"),
    "j04_terminus_board": oracle("se times stops", f"WITH {SUM} SELECT t.stop_id, trip_id, stop_sequence, departure_sec, stop_name AS headsign FROM times t JOIN summ USING (trip_id) LEFT JOIN stops s ON s.stop_id = last_stop_id WHERE departure_sec BETWEEN 30000 AND 33000"),
    "j05_station_volume": oracle("se trips times stops", f"SELECT stop_id, stop_name, count(DISTINCT trip_id) AS departures FROM times JOIN trips USING (trip_id) JOIN stops USING (stop_id) WHERE route_type = 2 AND date BETWEEN '{DAY_FROM}' AND '{DAY_TO}' GROUP BY 1, 2"),
    "src03_validity": oracle("trips", "SELECT trip_id, substr(validity, 3, 10) AS valid_from, substr(validity, 14, 10) AS valid_to FROM trips"),
    "src04_feed_calendar": """WITH cal AS (SELECT 'V' || n_nationkey AS service_id, CAST(n_nationkey AS INT) AS k FROM nation), days AS (
      SELECT service_id, k, CAST(unnest(generate_series(DATE '2024-01-01' + k, DATE '2024-02-01' + k * 2, INTERVAL 1 DAY)) AS DATE) AS d FROM cal
    ), x AS (SELECT service_id, DATE '2024-01-20' + k % 5 AS d, 2 AS t FROM cal UNION ALL SELECT service_id, DATE '2024-03-01' + k, 1 FROM cal), base AS (SELECT service_id, d, 1 AS t FROM days WHERE ((k >> ((isodow(d) - 1) % 5)) + isodow(d) - 1) % 2 = 1)
    SELECT service_id, strftime(d, '%Y%m%d') AS date, t AS exception_type FROM (FROM x UNION ALL FROM base WHERE (service_id, d) NOT IN (SELECT (service_id, d) FROM x))""",
    "src04_calendar": """WITH cal AS (SELECT 'V' || n_nationkey AS service_id, CAST(n_nationkey AS INT) AS k FROM nation), days AS (
      SELECT service_id, k, CAST(unnest(generate_series(DATE '2024-01-01' + k, DATE '2024-02-01' + k * 2, INTERVAL 1 DAY)) AS DATE) AS d FROM cal
    ), base AS (SELECT service_id, d FROM days WHERE ((k >> ((isodow(d) - 1) % 5)) + isodow(d) - 1) % 2 = 1 AND d <> DATE '2024-01-20' + k % 5)
    SELECT service_id, strftime(d, '%Y%m%d') AS date FROM base UNION SELECT service_id, strftime(DATE '2024-03-01' + k, '%Y%m%d') FROM cal""",
    "src18_holidays": """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders), e0 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), e1 AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM e0),
      e2 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e1), e3 AS (SELECT *, (a + 11 * h + 19 * l) // 433 AS m FROM e2), e4 AS (SELECT *, (h + l - 7 * m + 90) // 25 AS mo FROM e3),
      e AS (SELECT y, make_date(y, mo, (h + l - 7 * m + 33 * mo + 19) % 32) AS d FROM e4)
      SELECT strftime(make_date(y, mm, dd), '%Y-%m-%d') AS date, name FROM y, (VALUES (1, 1, 'New Year'), (1, 6, 'Epiphany'), (4, 25, 'Liberation Day'), (5, 1, 'Labour Day'), (6, 2, 'Republic Day'), (8, 15, 'Ferragosto'), (11, 1, 'All Saints'), (12, 8, 'Immaculate Conception'), (12, 25, 'Christmas'), (12, 26, 'St Stephen')) f(mm, dd, name)
      UNION ALL SELECT strftime(d, '%Y-%m-%d'), 'Easter' FROM e UNION ALL SELECT strftime(d + 1, '%Y-%m-%d'), 'Easter Monday' FROM e""",
    "p05_stop_search": oracle("stops", "SELECT stop_id, stop_name FROM stops WHERE stop_name ILIKE '%r#0000000%1%' ORDER BY stop_name LIMIT 20"),
    "p06_null_safe_match": oracle("se ends runs", "SELECT a.run_id, a.gtfs_trip_id, x.run_id AS with_run FROM runs a JOIN runs x ON a.train_number = x.train_number AND a.service_date = x.service_date AND CASE WHEN a.run_id % 2 = 0 THEN a.gtfs_trip_id END IS NOT DISTINCT FROM CASE WHEN x.run_id % 2 = 0 THEN x.gtfs_trip_id END"),
    "p06_null_safe_match_whole": oracle("se ends runs", "SELECT a.run_id, a.gtfs_trip_id FROM runs a JOIN runs x ON a.run_id = x.run_id AND a.gtfs_trip_id IS NOT DISTINCT FROM CASE WHEN x.run_id % 4 <> 0 THEN x.gtfs_trip_id END"),
    "p08_platform_sanity": oracle("se", "WITH p AS (SELECT run_id, stop_sequence, platform_actual || CASE WHEN run_id % 3 = 0 THEN 'bis' ELSE '' END AS p FROM se) SELECT run_id, stop_sequence, CASE WHEN TRY_CAST(p AS INT) BETWEEN 1 AND 30 THEN p END AS platform FROM p"),
    "p09_bare_train_number": oracle("trips", f"SELECT trip_id, {NUM} AS train_number FROM trips"),
    "p16_poll_interval": oracle("se ends runs", f"""WITH r AS (SELECT run_id, run_id % 50 = 0 AS watched, ['running', 'arrived', 'cancelled', NULL][run_id % 4 + 1] AS status, sched_dep_epoch AS dep, sched_arr_epoch AS arr, {POLL_AT} + (run_id % 7) * 600000 AS now FROM runs)
      SELECT run_id, CASE WHEN watched THEN 25 WHEN now > arr + 900000 OR coalesce(status IN ('arrived', 'cancelled'), false) THEN NULL WHEN now >= dep THEN 30 WHEN dep - now > 3600000 THEN 300 WHEN dep - now > 1800000 THEN 120 WHEN dep - now > 600000 THEN 60 ELSE 30 END AS interval_sec FROM r"""),
    "p17_discover_trips": oracle("se trips times", f"WITH {ON_DAY.replace(f'c.date = {chr(39)}{DAY}{chr(39)}', f'c.date IN ({chr(39)}{DAY}{chr(39)}, {chr(39)}{NEXT_DAY}{chr(39)})').replace('SELECT t.* FROM trips', 'SELECT t.* EXCLUDE (date), c.date FROM trips')}, {SUM}, a AS (SELECT date, {NUM} AS train_number, trip_id, regexp_extract(validity, '(\\d{{4}}-\\d{{2}}-\\d{{2}})-(\\d{{4}}-\\d{{2}}-\\d{{2}})$', 1) AS f, regexp_extract(validity, '(\\d{{4}}-\\d{{2}}-\\d{{2}})-(\\d{{4}}-\\d{{2}}-\\d{{2}})$', 2) AS t FROM ontrips WHERE route_type = 2), v AS (SELECT date, train_number, trip_id, dep_sec, arr_sec, CASE WHEN date = '{DAY}' THEN 100800 ELSE 14400 END AS since FROM a JOIN summ USING (trip_id) QUALIFY row_number() OVER (PARTITION BY date, train_number ORDER BY (f <= strftime(strptime(date, '%Y%m%d'), '%Y-%m-%d') AND strftime(strptime(date, '%Y%m%d'), '%Y-%m-%d') <= t) DESC, f DESC, trip_id) = 1), w AS (SELECT *, {FOUR} - since * 1000 + dep_sec * 1000 AS sched_dep_epoch, {FOUR} - since * 1000 + arr_sec * 1000 AS sched_arr_epoch FROM v WHERE dep_sec <= since + 5400 AND since <= arr_sec + 36000) SELECT strftime(strptime(date, '%Y%m%d'), '%Y-%m-%d') AS service_date, train_number, trip_id, sched_dep_epoch, sched_arr_epoch FROM w ORDER BY CASE WHEN date = '{NEXT_DAY}' THEN abs(sched_dep_epoch - {FOUR}) END NULLS LAST, date, train_number LIMIT 200"),
    "p17_discover": oracle("se ends runs", f"SELECT run_id, train_number, sched_dep_epoch, sched_arr_epoch FROM runs WHERE sched_dep_epoch <= {POLL_AT + 5400000} AND sched_arr_epoch + 900000 >= {POLL_AT} ORDER BY abs(sched_dep_epoch - {POLL_AT}), run_id LIMIT 200"),
    "a33_feed_range": oracle("trips", "SELECT min(date) AS feed_start, max(date) AS feed_end FROM trips"),
    "j24_consecutive_stops": oracle("se times", "SELECT a.stop_id AS from_stop_id, x.stop_id AS to_stop_id, count(*) AS n FROM times a JOIN times x ON x.trip_id = a.trip_id AND x.stop_sequence = a.stop_sequence + 1 GROUP BY 1, 2"),
    "u01_stop_event_merge": oracle("se", f"WITH {TOLD_STOPS} SELECT run_id, stop_id, service_date, arg_min_null(coalesce(stop_sequence, 0), (ts, id)) AS stop_sequence, " + ", ".join(f"arg_min_null({c}, (ts, id)) AS {c}" for c in se.FIRST[1:]) + ", " + ", ".join(f"arg_max_null({c}, (ts, id)) AS {c}" for c in se.LAST) + ", " + ", ".join(f"arg_max({c}, (ts, id)) AS {c}" for c in se.KNOWN) + ", max(ts) AS updated_at FROM td GROUP BY 1, 2, 3"),
    "u01_observation_merge": oracle("obs", f"WITH {UPD} SELECT run_id, stop_id, arg_max_null(source, (ts, id)) AS source, arg_max_null(observed_at, (ts, id)) AS observed_at, arg_max(delay_seconds, (ts, id)) AS delay_seconds, arg_max(crowding, (ts, id)) AS crowding, min(ts) AS first_ts, count(*) AS updates FROM upd GROUP BY 1, 2"),
    "u02_run_enrichment": oracle("obs", f"WITH {UPD} SELECT run_id, arg_min(delay_seconds, (ts, id)) AS delay_seconds, arg_min(crowding, (ts, id)) AS crowding, arg_min(observed_at, (ts, id)) AS observed_at FROM upd GROUP BY 1"),
    "u03_provider_health": oracle("obs", f"WITH {FETCH}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, id) AS k FROM fe), l AS (SELECT source, coalesce(max(k) FILTER (ok), 0) AS lk FROM k GROUP BY 1), g AS (SELECT source, count(*) AS fetches, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (k > lk AND k > 1) AS consecutive_errors, max(ts) FILTER (ok) AS last_success_at FROM k JOIN l USING (source) GROUP BY 1) SELECT *, CASE WHEN fetches = 1 THEN 'UNKNOWN' WHEN consecutive_errors >= 5 THEN 'PAUSED' WHEN consecutive_errors >= 1 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state FROM g"),
    "u04_rail_locations": f"WITH {SIGHT} SELECT {SLUG} AS key, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, count(*) AS observation_count, arg_max(lat, seen_at) AS lat, arg_max(lon, seen_at) AS lon, CASE WHEN arg_max(ty, seen_at) = 'UNKNOWN_REPORTING_POINT' AND arg_max(ty, seen_at) FILTER (ty <> 'UNKNOWN_REPORTING_POINT') = 'PASSENGER_STATION' THEN 'PASSENGER_STATION' ELSE arg_max(ty, seen_at) END AS type FROM (SELECT *, coalesce(type, CASE WHEN lower(name) LIKE '%bivio%' THEN 'BIVIO' WHEN lower(name) LIKE '%diramazione%' OR lower(name) LIKE '%giunzione%' THEN 'JUNCTION' ELSE 'UNKNOWN_REPORTING_POINT' END) AS ty FROM si) si GROUP BY 1",
    "u05_last_version": oracle("obs", "SELECT run_id, source, id, ts, delay_seconds FROM obs QUALIFY row_number() OVER (PARTITION BY run_id, source ORDER BY ts DESC, id DESC) = 1"),
    "u06_alert_dedup": "SELECT sha256(coalesce('=' || source, '-') || '|' || coalesce('=' || text, '-')) AS payload_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "u07_calendar_upsert": oracle("obs", "SELECT source, location_id, arg_max_null(ts, id) AS ts, arg_max_null(delay_seconds, id) AS delay_seconds, arg_min_null(ts, id) AS first_ts, count(*) AS updates FROM obs GROUP BY 1, 2"),
    "u08_stats_upsert": "WITH o AS (SELECT l_partkey, count(*) AS n, 'old' AS version FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), n AS (SELECT l_partkey, count(*) AS n, 'new' AS version FROM lineitem WHERE l_linenumber > 4 GROUP BY 1) SELECT * FROM n UNION ALL SELECT * FROM o WHERE l_partkey NOT IN (SELECT l_partkey FROM n)",
    "u09_first_mapping": oracle("obs", "SELECT source, location_id, run_id FROM obs QUALIFY row_number() OVER (PARTITION BY source, location_id ORDER BY ts, id) = 1"),
    "u10_fill_crowding": oracle("obs", f"WITH {UPD} SELECT id, coalesce(crowding, CASE WHEN id % 2 = 0 THEN 9 END) AS crowding FROM upd"),
    "snk02_changed_snapshots": oracle("obs", f"WITH {FETCH} SELECT id, coalesce(lag(payload_hash) OVER (PARTITION BY source, entity_key ORDER BY ts, id) <> payload_hash, true) AS changed FROM fe"),
    "snk04_backfill_types": oracle("se", "SELECT run_id, stop_id, coalesce(stop_sequence, 0) AS stop_sequence, make_timestamp(sched_arr_epoch * 1000) AS sched_arr FROM se"),
    "snk05_export": oracle("se ends runs pred scored", f"WITH {EXPORTED} SELECT * FROM exported"),
    "snk08_retention": oracle("se", f"SELECT stop_id, count(*) AS n FROM se WHERE sched_arr_epoch >= {AS_OF - 365 * 86400000} GROUP BY 1"),
    "p01_features": "SELECT event_id, CAST(floor(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.5) AS BIGINT) AS k, CAST(0.0 AS DOUBLE) AS nope FROM events",
    "w21_newest_n": oracle("obs", "WITH k AS (SELECT id, ts FROM obs QUALIFY row_number() OVER (PARTITION BY source, location_id ORDER BY ts DESC, id DESC) = 1) SELECT id, ts FROM k ORDER BY ts DESC, id DESC LIMIT 20"),
    "s01_union_keys": oracle("se stops", "SELECT stop_id FROM se UNION SELECT stop_id FROM stops"),
    "s01_union_keys_whole": oracle("se stops", "SELECT stop_id FROM se UNION SELECT stop_id FROM stops"),
    "s03_union_networks": oracle("stops", "SELECT stop_id, stop_name, 'rail' AS network FROM stops UNION ALL SELECT 'A' || c_custkey, c_name, 'metro' FROM customer"),
    "s03_union_networks_whole": oracle("stops", "SELECT stop_id, stop_name, 'rail' AS network FROM stops UNION ALL SELECT 'A' || c_custkey, c_name, 'metro' FROM customer"),
    "s05_unmapped_stops": oracle("se stops", "SELECT DISTINCT stop_id FROM se WHERE stop_id NOT IN (SELECT stop_id FROM stops)"),
    "s06_distinct_pairs": oracle("se", "SELECT DISTINCT stop_id, platform_actual FROM se"),
    "fn_rome_time": """WITH i AS (SELECT epoch_us(o_orderdate) // 1000 + (o_orderkey % 1440) * 60000 AS e, o_orderkey AS k FROM orders UNION ALL SELECT 1711843200000 + i * 900000, -i - 1 FROM range(96) t(i) UNION ALL SELECT 1729980000000 + i * 900000, -i - 1001 FROM range(96) t(i)),
      r AS (SELECT k, timezone('Europe/Rome', make_timestamptz(e * 1000)) AS t FROM i) SELECT k, strftime(t, '%Y-%m-%d') AS ymd, strftime(t, '%H:%M:%S') AS hms, hour(t) IN (7, 8, 16, 17, 18) AS peak FROM r""",
    "fn_rome_wall": "SELECT o_orderkey AS id, CAST(epoch(timezone('Europe/Rome', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_seconds(o_orderkey % 400 * 300))) AS BIGINT) AS epoch FROM orders",
    "fn_js_round": "SELECT CAST(floor((l_quantity - 25) / 2 + 0.5) AS BIGINT) AS r, count(*) AS n FROM lineitem GROUP BY 1",
    "fn_slug": f"WITH {SIGHT} SELECT id, {SLUG} AS slug, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM si",
    "fn_run_key": oracle("se ends runs", "SELECT run_id, concat_ws('|', operator, service_date, train_number, coalesce(gtfs_trip_id, '?'), lpad(CAST(sched_dep_epoch // 1000 % 86400 AS VARCHAR), 6, '0')) AS run_key FROM runs"),
    "fn_wait_message": "SELECT o_orderkey AS k, CAST(CASE o_orderkey % 4 WHEN 0 THEN 45 WHEN 1 THEN (o_orderkey % 30) * 60 END AS INT) AS seconds, CASE o_orderkey % 4 WHEN 2 THEN 'RECALC' WHEN 3 THEN 'NO_SERVICE' END AS flag FROM orders",
    "fn_hms_seconds": "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + 5 WHEN 1 THEN (o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 END AS seconds FROM orders",
    "fn_normal_cdf": "WITH x AS (SELECT DISTINCT (l_quantity - 25) / 8 AS x FROM lineitem), t AS (SELECT x, abs(x) / sqrt(2.0) AS z, 1 / (1 + 0.3275911 * abs(x) / sqrt(2.0)) AS t FROM x) SELECT x, round(0.5 * (1 + sign(x) * (1 - (0.254829592 * t - 0.284496736 * t * t + 1.421413741 * t * t * t - 1.453152027 * t * t * t * t + 1.061405429 * t * t * t * t * t) * exp(-z * z))), 6) AS p FROM t",
    "fn_recovery": oracle("se ends pred scored", """WITH d AS (SELECT *, CASE WHEN run_id % 9 <> 0 THEN (run_id * 53) % 900 - 100 END AS late, our_p90 + CASE WHEN run_id % 7 = 0 THEN 1500000 ELSE 0 END AS p90 FROM scored), t AS (SELECT *, late > 0 AND p90 - our_p10 <= 1800000 AS told, sched_arr_epoch + (late - 120) * 1000 AS x FROM d)
      SELECT prediction_id, CAST(floor(late - (our_p50 - sched_arr_epoch) / 1000 + 0.5) AS BIGINT) AS expected_gain_sec, CASE WHEN told THEN floor(greatest(0.02, least(0.98, CASE WHEN x <= our_p50 THEN 0.1 + 0.4 * (x - our_p10) / greatest(1, our_p50 - our_p10) ELSE 0.5 + 0.4 * (x - our_p50) / greatest(1, p90 - our_p50) END)) * 100 + 0.5) / 100 END AS prob_recover,
      CASE WHEN told THEN CAST(floor((our_p50 - sched_arr_epoch) / 1000 + 0.5) AS BIGINT) END AS expected_delay_sec FROM t"""),
    "fn_quantile_cdf": oracle("se ends pred scored", "SELECT prediction_id, round(greatest(0.02, least(0.98, CASE WHEN actual_arr_epoch <= our_p50 THEN 0.1 + 0.4 * (actual_arr_epoch - our_p10) / greatest(1, our_p50 - our_p10) ELSE 0.5 + 0.4 * (actual_arr_epoch - our_p50) / greatest(1, our_p90 - our_p50) END)), 6) AS p FROM scored"),
}
ORACLE_SQL["snk07_round_trip"] = f"SELECT *, CAST(1 AS BIGINT) AS more, 'left' AS side FROM ({ORACLE_SQL['snk05_export']}) WHERE false"
