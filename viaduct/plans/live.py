"""Queries of fused states, metro passages, training rows, orderings and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from viaduct.functions import text as tx
from viaduct.operators import fusion as fu
from viaduct.operators import metro as me
from viaduct.operators import serving as sv
from viaduct.operators import training as tr
from viaduct.plans.joins import NOW
from viaduct.plans.segments import SEG, traversals
from viaduct.sources import bindings as b
from viaduct.sources.bindings import oracle

DAY = 86_400_000
#: The timetable's years moved on to those of the observations.
LATER = 820_000_000_000
CODES = ("N", "V", "A", "C", "PG", "ST")


# ---------------------------------------------------------------- metro


def messages(s, d):
    """Waiting times at twenty stops of four lines within a day, in frames of half a minute."""
    o = b.observations(s, d)
    k = F.col("id")
    at = F.floor(F.col("ts") % DAY / 30_000) * 30_000
    return o.select(F.concat(F.lit("M"), (F.col("run_id") % 20).cast("string")).alias("stop_id"), at.cast("long").alias("fetched_at"), F.when(k % 13 != 0, F.concat(F.lit("L"), (k % 4).cast("string"))).alias("line"), k.alias("seq"), F.when(k % 11 != 0, (k * 37 % 200).cast("long")).alias("eta_sec"))


def metro_board(s, d):
    """The boards of all metro stops at noon; some departures have no line."""
    t, run = b.gtfs_stop_times(s, d), F.substring("trip_id", 2, 20).cast("long")
    deps = t.select(F.concat(F.lit("M"), (F.substring("stop_id", 2, 5).cast("int") % 20).cast("string")).alias("stop_id"), F.when(run % 9 != 0, F.concat(F.lit("L"), (run % 5).cast("string"))).alias("line"), F.concat_ws("/", "trip_id", F.col("stop_sequence").cast("string")).alias("trip_id"), (F.col("departure_sec") % 86_400).alias("departure_sec"))
    return me.board(deps, messages(s, d), DAY // 2, 43_200)


def adjacent(s):
    return s.range(20).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("stop_id"), F.concat(F.lit("M"), ((F.col("id") + 1) % 20).cast("string")).alias("to_stop"))


def passages(s, d):
    return me.passages(messages(s, d))


# ---------------------------------------------------------------- states


def shifted(s, d):
    """Stop events in the years of the observations; what is still to come has no actual times."""
    e = b.stop_events(s, d)
    for c in ("sched_arr_epoch", "sched_dep_epoch", "actual_arr_epoch", "actual_dep_epoch"):
        e = e.withColumn(c, F.col(c) + LATER)
    for c in ("actual_arr_epoch", "actual_dep_epoch"):
        e = e.withColumn(c, F.when(F.col(c) <= NOW, F.col(c)))
    return e.withColumn("op_pred_arr_epoch", F.when(F.col("run_id") % 6 != 0, F.col("sched_arr_epoch") + F.col("run_id") % 5 * 60_000))


def told(s, d):
    codes = F.array(*map(F.lit, CODES))
    return b.observations(s, d).withColumn("status", F.get(codes, (F.col("id") % 9).cast("int")))


def states(s, d):
    runs = b.runs(s, d).select("run_id", "train_number", "service_date", (F.col("sched_dep_epoch") + LATER).alias("sched_dep_epoch"), F.when(F.col("run_id") % 10 != 0, F.col("sched_arr_epoch") + LATER).alias("sched_arr_epoch"))
    health = s.createDataFrame([("mia", "HEALTHY"), ("viaggiatreno", "DEGRADED")], "source string, state string")
    return fu.fuse_runs(runs, shifted(s, d), told(s, d), health, NOW)


def printed_states(s, d):
    lines = F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["source"], F.coalesce(x["delay_seconds"].cast("string"), F.lit("-")), x["age_sec"].cast("string"))), " ")
    return states(s, d).withColumn("sources", F.coalesce(lines, F.lit(""))).withColumn("stops", F.coalesce(F.array_join(F.transform("stops", lambda x: x["stop_id"]), " "), F.lit("")))


def areas(s, d):
    known = b.runs(s, d).select("run_id", F.lit("running").alias("status"), F.when(F.col("run_id") % 4 == 0, F.col("origin_stop_id")).when(F.col("run_id") % 4 == 1, F.col("destination_stop_id")).alias("location_id"), F.when(F.col("run_id") % 7 != 0, F.lit(NOW) - F.col("run_id") * 10).alias("seen_at"))
    return sv.likely_area(known, shifted(s, d), b.stops(s, d), NOW).select("run_id", "from_stop_id", "to_stop_id", F.round("from_lat", 6).alias("from_lat"), F.round("to_lat", 6).alias("to_lat"), "age_sec")


# ---------------------------------------------------------------- the rest


def learnable(s, d):
    r = F.col("run_id")
    rows = b.scored(s, d).withColumn("base_p50", F.when(r % 5 != 0, F.col("our_p50") - r % 7 * 1000)).withColumn("base_p10", F.col("base_p50") - 1).withColumn("base_p90", F.col("base_p50") + 1)
    rows = rows.withColumn("remaining_segments", F.when(r % 11 != 0, 3)).withColumn("stats_coverage", F.when(r % 13 != 0, 0.5))
    return tr.training_rows(rows).select("prediction_id", "label_sec", "start_p50")


def platform_scores(s, d):
    e = b.stop_events(s, d).groupBy("stop_id", F.col("platform_actual").alias("platform")).agg(F.count("*").alias("n"))
    best = sv.top_platforms(e.withColumn("score", F.col("n") / 4.0), ["stop_id"], "score", "platform")
    return best.select("stop_id", F.posexplode("platforms").alias("pos", "x")).select("stop_id", "pos", "x.platform", F.round("x.p", 3).alias("p"))


def boarding(s, d):
    r = b.runs(s, d)
    status = F.get(F.array(*map(F.lit, ("running", "arrived", "cancelled", "scheduled"))), (F.col("run_id") % 4).cast("int"))
    now = F.lit(820_454_400_000)
    return r.select("run_id", sv.boardable(status, F.when(F.col("run_id") % 5 == 0, F.col("sched_dep_epoch")), F.col("sched_dep_epoch"), F.when(F.col("run_id") % 3 != 0, F.col("run_id") % 7 * 60), now).alias("boardable"))


def texts(s, d):
    k = F.col("id")
    name = F.concat(F.lit("Città  d'Àlba/"), (k * 7919).cast("string"), F.when(k % 3 == 0, " ~Bivio~ è").when(k % 3 == 1, " Giunzione S.Giovanni").otherwise(""))
    seconds = k * 997 - 50_000
    return b.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id")).select(
        "id", tx.normalized_name(name).alias("normalized"), tx.safe_name(name, 20).alias("safe"), tx.partition_value(F.when(k % 10 != 0, name)).alias("partition"), tx.fnv1a(name, 64).cast("long").alias("hash"),
        tx.seconds_to_hms(seconds).alias("hms"), tx.minutes_text(seconds).alias("minutes"), tx.delay_text(F.when(k % 7 != 0, seconds)).alias("delay"), tx.departure_text(F.lit(NOW) + k * 40_000 - 600_000, NOW).alias("departure"), tx.percent_text(k % 7, k % 5).alias("percent"),
    )


def dates(s, d):
    o = b.table(s, d, "orders").select("o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("ymd"))
    k = F.col("o_orderkey")
    return o.select("o_orderkey", tx.plus_days(F.col("ymd"), (k % 800 - 400)).alias("moved"), tx.feed_date(F.col("ymd")).alias("feed"), tx.from_feed_date(tx.feed_date(F.col("ymd"))).alias("back"), tx.previous_service_date(F.col("ymd")).alias("previous"), tx.seconds_into_day(k * 997, k * 500).alias("into_day"))


def arrays(s, d):
    """Lists and maps of a source's places: distinct in order of appearance, in chunks of four, and counted."""
    o = b.observations(s, d)
    g = o.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "location_id"))), lambda x: x["location_id"]).alias("all"))
    once = F.array_distinct("all")
    chunks = F.transform(F.sequence(F.lit(1), F.size(once), F.lit(4)), lambda a: F.slice(once, a, F.lit(4)))
    counts = F.map_from_entries(F.transform(once, lambda x: F.struct(x, F.size(F.filter("all", lambda y: y == x)))))
    return g.where("size(all) > 0").select("run_id", F.array_join(once, ",").alias("places"), F.size(chunks).alias("chunks"), F.array_join(F.get(chunks, F.lit(0)), ",").alias("first_chunk"), F.array_max(F.map_values(counts)).alias("most"), F.try_element_at(counts, F.get(once, F.lit(0))).alias("first_count"))


QUERIES = {
    "j30_metro_board": metro_board,
    "w15_passages": passages,
    "j27_linked_passages": lambda s, d: me.linked(passages(s, d), adjacent(s)),
    "j27_chained_passages": lambda s, d: me.chained(passages(s, d), adjacent(s)),
    "a31_latent_study": lambda s, d: me.study(passages(s, d), adjacent(s)),
    "f02_run_state": printed_states,
    "f03_status": lambda s, d: states(s, d).select("run_id", "status"),
    "w10_previous_next": lambda s, d: fu.stop_facts(shifted(s, d)).select("run_id", "previous_stop", "next_stop", "passed_stops", "upcoming_stops", "destination_eta"),
    "f06_likely_area": areas,
    "j08_stop_level": lambda s, d: tr.stop_level(b.stop_events(s, d), b.runs(s, d), "1996-01-01"),
    "p13_training_rows": learnable,
    "p10_shown_line": lambda s, d: b.table(s, d, "part").select("p_partkey", me.shown_line(F.substring("p_name", 1, 3).cast("string")).alias("short"), me.shown_line(F.concat(F.col("p_brand"), F.when(F.col("p_partkey") % 4 == 0, "(x)").otherwise(""))).alias("line")),
    "p18_boardable": boarding,
    "t02_registry_order": lambda s, d: traversals(s, d).groupBy(F.col("from_stop_id").alias("key")).agg(F.count("*").alias("observation_count")).orderBy(F.desc("observation_count"), "key").limit(25),
    "t03_nulls_last": lambda s, d: b.stop_events(s, d).orderBy(F.col("actual_arr_epoch").isNull(), "actual_arr_epoch", "run_id", "stop_sequence").limit(40).select("run_id", "stop_sequence", "actual_arr_epoch"),
    "t07_top_platforms": platform_scores,
    "s02_union_runs": lambda s, d: b.observations(s, d).select("run_id").union(b.stop_events(s, d).select("run_id")).distinct(),
    "fn_text": texts,
    "fn_dates": dates,
    "fn_arrays_maps": arrays,
}

MSG = f"""msg AS (SELECT 'M' || (run_id % 20) AS stop_id, ts % {DAY} // 30000 * 30000 AS fetched_at, CASE WHEN id % 13 <> 0 THEN 'L' || (id % 4) END AS line, id AS seq, CASE WHEN id % 11 <> 0 THEN id * 37 % 200 END AS eta_sec FROM obs),
nx AS (SELECT stop_id, fetched_at, lead(fetched_at) OVER (PARTITION BY stop_id ORDER BY fetched_at) AS next_at FROM (SELECT DISTINCT stop_id, fetched_at FROM msg)),
sn AS (SELECT stop_id, fetched_at, line, arg_max_null(eta_sec, seq) AS eta FROM msg WHERE line IS NOT NULL GROUP BY ALL),
ps AS (SELECT s.stop_id, s.line, n.next_at AS passed_at FROM sn s JOIN nx n USING (stop_id, fetched_at) WHERE eta <= 90 AND next_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sn x WHERE x.stop_id = s.stop_id AND x.line = s.line AND x.fetched_at = n.next_at)),
ad AS (SELECT 'M' || i AS stop_id, 'M' || ((i + 1) % 20) AS to_stop FROM range(20) t(i)),
li AS (SELECT p.* FROM ps p JOIN ad USING (stop_id) WHERE EXISTS (SELECT 1 FROM ps q WHERE q.line = p.line AND q.stop_id = to_stop AND q.passed_at - p.passed_at BETWEEN 1 AND 1200000)),
ch AS (SELECT p.* FROM ps p JOIN ad USING (stop_id) WHERE EXISTS (SELECT 1 FROM li q WHERE q.line = p.line AND q.stop_id = to_stop AND q.passed_at - p.passed_at BETWEEN 1 AND 1200000))"""
SHIFT = f"""sh AS (SELECT run_id, stop_sequence, stop_id, sched_arr_epoch + {LATER} AS sa, sched_dep_epoch + {LATER} AS sd, CASE WHEN actual_arr_epoch + {LATER} <= {NOW} THEN actual_arr_epoch + {LATER} END AS aa, CASE WHEN actual_dep_epoch + {LATER} <= {NOW} THEN actual_dep_epoch + {LATER} END AS ade,
  cancelled, CASE WHEN run_id % 6 <> 0 THEN sched_arr_epoch + {LATER} + run_id % 5 * 60000 END AS op FROM se)"""
FACTS = """sp AS (SELECT *, aa IS NOT NULL OR ade IS NOT NULL AS passed, arg_max_null(aa, stop_sequence) FILTER (aa IS NOT NULL OR ade IS NOT NULL) OVER (PARTITION BY run_id) AS pa FROM sh),
sf AS (SELECT run_id, bool_or(cancelled = 1) AS gone, bool_and(aa IS NOT NULL OR cancelled IS NOT NULL) AS arrived, bool_or(passed) AS moved, arg_max(stop_id, stop_sequence) FILTER (passed) AS previous_stop,
  arg_min(stop_id, stop_sequence) FILTER (aa IS NULL AND cancelled IS NULL AND sa >= coalesce(pa, 0)) AS next_stop, count(*) FILTER (passed) AS passed_stops, count(*) FILTER (aa IS NULL AND cancelled IS NULL AND sa >= coalesce(pa, 0)) AS upcoming_stops,
  arg_max_null(op, stop_sequence) AS destination_eta, max(sa) AS last_sa, string_agg(stop_id, ' ' ORDER BY stop_sequence) AS stops FROM sp GROUP BY run_id)"""
STATES = f"""lt0 AS (SELECT *, ['N', 'V', 'A', 'C', 'PG', 'ST'][id % 9 + 1] AS status, CASE source WHEN 'mia' THEN 2 WHEN 'viaggiatreno' THEN 2 ELSE 1 END AS level, coalesce(observed_at, ts) AS seen FROM obs WHERE ts <= {NOW} QUALIFY row_number() OVER (PARTITION BY run_id, source ORDER BY ts DESC, id DESC) = 1),
lt AS (SELECT *, CAST(floor(({NOW} - seen) / 1000.0 + 0.5) AS BIGINT) AS age_sec FROM lt0),
dr AS (SELECT *, ['LOW', 'MEDIUM', 'HIGH'][level] AS lv, delay_seconds AS value, row_number() OVER (PARTITION BY run_id ORDER BY level DESC, seen DESC, source) AS k, row_number() OVER (PARTITION BY run_id ORDER BY seen DESC, source) AS kf, bool_or(source = 'viaggiatreno') OVER (PARTITION BY run_id) AS lost FROM lt WHERE delay_seconds IS NOT NULL),
d3 AS (SELECT a.run_id, a.lost, a AS a, z AS z, f AS f, f.source <> a.source AND f.seen > a.seen AND abs(f.value - a.value) <= 60 AS swap FROM dr a LEFT JOIN dr z ON z.run_id = a.run_id AND z.k = 2 JOIN dr f ON f.run_id = a.run_id AND f.kf = 1 WHERE a.k = 1),
d4 AS (SELECT *, CASE WHEN swap THEN f ELSE a END AS pick, abs(CASE WHEN swap THEN f.value - a.value ELSE a.value - z.value END) AS apart FROM d3),
dp AS (SELECT run_id, pick, apart, CASE WHEN swap THEN f.source || ' fresher and agrees with ' || a.source || ' within 60s (delta ' || abs(f.value - a.value) || 's); freshness decides (current_delay)' WHEN z.source IS NULL THEN a.source || ': sole candidate (current_delay, trust ' || a.lv || ')'
    WHEN a.level > z.level THEN a.source || ':' || a.lv || ' beats ' || z.source || ':' || z.lv || ' (current_delay trust table)' ELSE a.source || ' and ' || z.source || ' equal trust ' || a.lv || ', fresher by ' || CAST(floor((a.seen - z.seen) / 1000 + 0.5) AS BIGINT) || 's; fresher wins (current_delay)' END
  || CASE WHEN apart IS NOT NULL THEN '; disagreement ' || apart || 's' ELSE '' END || CASE WHEN lost THEN '; degraded viaggiatreno HIGH->MEDIUM (DEGRADED)' ELSE '' END AS delay_reason FROM d4),
lg AS (SELECT run_id, count(*) AS n, arg_max_null(status, (seen, source)) AS code, {NOW} AS now, CAST(floor(({NOW} - max(seen)) / 1000.0 + 0.5) AS BIGINT) AS age, CASE WHEN count(delay_seconds) >= 2 THEN max(delay_seconds) - min(delay_seconds) END AS spread,
  list(location_id ORDER BY seen DESC, source)[1] AS location_id, list(source ORDER BY seen DESC, source)[1] AS position_source, string_agg(source || '@' || seen, ' vs ' ORDER BY seen DESC, source) AS ages, string_agg(source || ':' || coalesce(CAST(delay_seconds AS VARCHAR), '-') || ':' || age_sec, ' ' ORDER BY source) AS sources FROM lt GROUP BY run_id),
st AS (SELECT r.run_id, train_number || '@' || service_date AS run_code, CASE WHEN r.run_id % 10 <> 0 THEN sched_arr_epoch + {LATER} ELSE last_sa END AS sched_arr_epoch,
  CASE WHEN gone OR code IN ('C', 'ST') THEN 'cancelled' WHEN arrived OR code = 'A' THEN 'arrived' WHEN moved OR code = 'V' THEN 'running' WHEN code IN ('N', 'PG') THEN 'scheduled' WHEN sched_dep_epoch + {LATER} > {NOW} THEN 'scheduled' ELSE 'running' END AS status,
  pick.value AS delay_sec, pick.source AS delay_source, pick.lv AS delay_trust, apart AS disagreement_sec, delay_reason, location_id, position_source, position_source || ' wins: freshest infrastructure observation (' || ages || ')' AS position_reason, spread AS spread_sec,
  CASE WHEN n >= 2 AND age < 120 AND coalesce(spread, 0) <= 120 THEN 'HIGH' WHEN n >= 1 AND age < 600 AND coalesce(spread, 0) <= 600 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  concat_ws(',', CASE WHEN spread > 300 THEN 'SOURCE_CONFLICT' END, CASE WHEN age > 600 THEN 'STALE_SOURCE' END) AS quality, previous_stop, next_stop, destination_eta, passed_stops, upcoming_stops, coalesce(sources, '') AS sources, stops
  FROM runs r LEFT JOIN sf USING (run_id) LEFT JOIN lg USING (run_id) LEFT JOIN dp USING (run_id))"""

BOARD = f"""fr AS (SELECT stop_id, fetched_at, row_number() OVER (PARTITION BY stop_id ORDER BY fetched_at DESC) AS k FROM (SELECT DISTINCT stop_id, fetched_at FROM msg WHERE fetched_at <= {DAY // 2})),
lv AS (SELECT stop_id, line, eta_sec, fetched_at AS told_at FROM msg JOIN fr USING (stop_id, fetched_at) WHERE line IS NOT NULL AND k <= 3 QUALIFY row_number() OVER (PARTITION BY stop_id, line ORDER BY k, seq) = 1),
dp AS (SELECT 'M' || (CAST(substr(stop_id, 2) AS INT) % 20) AS stop_id, CASE WHEN CAST(substr(trip_id, 2) AS BIGINT) % 9 <> 0 THEN 'L' || (CAST(substr(trip_id, 2) AS BIGINT) % 5) END AS line, trip_id || '/' || stop_sequence AS trip_id, departure_sec % 86400 AS departure_sec FROM times),
sh AS (SELECT * FROM dp WHERE departure_sec BETWEEN 42900 AND 48600 QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY departure_sec, trip_id) <= 40)
SELECT stop_id, line, trip_id, departure_sec - 43200 AS scheduled_in_sec, eta_sec AS live_eta_sec, told_at FROM sh LEFT JOIN lv USING (stop_id, line)"""

ORACLE_SQL = {
    "j30_metro_board": oracle("se times obs", f"WITH {MSG}, {BOARD}"),
    "w15_passages": oracle("obs", f"WITH {MSG} SELECT * FROM ps"),
    "j27_linked_passages": oracle("obs", f"WITH {MSG} SELECT * FROM li"),
    "j27_chained_passages": oracle("obs", f"WITH {MSG} SELECT * FROM ch"),
    "a31_latent_study": oracle("obs", f"""WITH {MSG}, co AS (SELECT passed_at - lag(passed_at) OVER (PARTITION BY stop_id, line ORDER BY passed_at) AS gap FROM ps),
      n AS (SELECT (SELECT count(*) FROM ps) AS passages, (SELECT count(*) FROM li) AS a, (SELECT count(*) FROM ch) AS b, (SELECT count(*) FROM co WHERE gap < 90000) AS c),
      p AS (SELECT passages, floor(a / greatest(1, passages) * 1000 + 0.5) / 10 AS link2_pct, floor(b / greatest(1, passages) * 1000 + 0.5) / 10 AS link3_pct, floor(c / greatest(1, passages) * 1000 + 0.5) / 10 AS collision_pct FROM n) SELECT *, link3_pct >= 70 AND collision_pct < 20 AS go FROM p"""),
    "f02_run_state": oracle("se ends runs obs", f"WITH {SHIFT}, {FACTS}, {STATES} SELECT * FROM st"),
    "f03_status": oracle("se ends runs obs", f"WITH {SHIFT}, {FACTS}, {STATES} SELECT run_id, status FROM st"),
    "w10_previous_next": oracle("se", f"WITH {SHIFT}, {FACTS} SELECT run_id, previous_stop, next_stop, passed_stops, upcoming_stops, destination_eta FROM sf"),
    "f06_likely_area": oracle("se ends runs stops", f"""WITH {SHIFT}, lb AS (SELECT *, lag(stop_id) OVER (PARTITION BY run_id ORDER BY stop_sequence) AS before FROM sh),
      nx AS (SELECT * FROM lb WHERE aa IS NULL AND ade IS NULL AND cancelled IS NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY stop_sequence) = 1),
      k AS (SELECT r.run_id, CASE run_id % 4 WHEN 0 THEN origin_stop_id WHEN 1 THEN destination_stop_id END AS loc, r.run_id * 10 AS age, n.stop_id AS to_stop_id, n.before FROM runs r JOIN nx n USING (run_id) WHERE r.run_id % 7 <> 0),
      j AS (SELECT k.*, CASE WHEN a.stop_id IS NOT NULL AND a.stop_id <> to_stop_id THEN a.stop_id ELSE z.stop_id END AS from_stop_id, CASE WHEN a.stop_id IS NOT NULL AND a.stop_id <> to_stop_id THEN a.stop_lat ELSE z.stop_lat END AS from_lat FROM k LEFT JOIN stops a ON a.stop_id = loc LEFT JOIN stops z ON z.stop_id = before)
      SELECT run_id, from_stop_id, to_stop_id, round(from_lat, 6) AS from_lat, round(t.stop_lat, 6) AS to_lat, CAST(floor(age / 1000.0 + 0.5) AS BIGINT) AS age_sec FROM j LEFT JOIN stops t ON t.stop_id = to_stop_id WHERE from_stop_id <> to_stop_id"""),
    "j08_stop_level": oracle("se ends runs", """WITH f AS (SELECT e.run_id, max(e.stop_sequence) AS mx, arg_min_null(actual_arr_epoch, stop_sequence) FILTER (stop_id = destination_stop_id) AS da, arg_min(actual_dep_epoch - e.sched_dep_epoch, stop_sequence) FILTER (stop_id = origin_stop_id AND actual_dep_epoch IS NOT NULL) AS od FROM se e JOIN runs r USING (run_id) GROUP BY 1)
      SELECT e.run_id, e.stop_sequence, train_number, actual_arr_epoch AS generated_at, r.sched_arr_epoch AS dest_sched, CAST(r.sched_arr_epoch + greatest(-1800, least(1800, arr_delay_sec)) * 1000 AS BIGINT) AS p50, CAST(greatest(-1800, least(1800, arr_delay_sec)) AS DOUBLE) AS delay_sec, greatest(1, mx - e.stop_sequence) AS remaining_segments,
        CAST(floor(od / 1000.0 + 0.5) AS BIGINT) AS origin_dep_delay_sec, greatest(-2700.0, least(2700.0, (da - r.sched_arr_epoch) / 1000.0)) AS label_sec
      FROM se e JOIN runs r USING (run_id) JOIN f USING (run_id) WHERE actual_arr_epoch IS NOT NULL AND stop_id <> destination_stop_id AND da IS NOT NULL AND actual_arr_epoch < da AND service_date >= '1996-01-01'"""),
    "p13_training_rows": oracle("se ends pred scored", """WITH x AS (SELECT *, model_version <> 'heuristic-v1' AS c, CASE WHEN run_id % 5 <> 0 THEN our_p50 - run_id % 7 * 1000 END AS b FROM scored WHERE run_id % 11 <> 0 AND run_id % 13 <> 0 AND sched_arr_epoch - generated_at BETWEEN 0 AND 3600000),
      l AS (SELECT prediction_id, CASE WHEN c THEN CAST(floor(our_error_sec + (our_p50 - b) / 1000.0 + 0.5) AS BIGINT) ELSE our_error_sec END AS label_sec, CASE WHEN c THEN b ELSE our_p50 END AS start_p50 FROM x WHERE NOT c OR b IS NOT NULL) SELECT * FROM l WHERE abs(label_sec) <= 2700"""),
    "p10_shown_line": "SELECT p_partkey, substr(p_name, 1, 3) AS short, CASE WHEN length(p_brand) <= 8 AND p_partkey % 4 <> 0 THEN p_brand END AS line FROM part",
    "p18_boardable": oracle("se ends runs", "SELECT run_id, run_id % 4 IN (0, 3) AND run_id % 5 <> 0 AND sched_dep_epoch + CASE WHEN run_id % 3 <> 0 THEN run_id % 7 * 60000 ELSE 0 END >= 820454370000 AS boardable FROM runs"),
    "t02_registry_order": oracle("se", f"WITH {SEG} SELECT from_stop_id AS key, count(*) AS observation_count FROM seg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"),
    "t03_nulls_last": oracle("se", "SELECT run_id, stop_sequence, actual_arr_epoch FROM se ORDER BY actual_arr_epoch IS NULL, actual_arr_epoch, run_id, stop_sequence LIMIT 40"),
    "t07_top_platforms": oracle("se", """WITH n AS (SELECT stop_id, platform_actual AS platform, exp(count(*) / CAST(4.0 AS DOUBLE)) AS e FROM se GROUP BY ALL), p AS (SELECT stop_id, platform, floor(e / sum(e) OVER (PARTITION BY stop_id) * 1000 + 0.5) / 1000 AS p FROM n)
      SELECT stop_id, CAST(row_number() OVER w - 1 AS INT) AS pos, platform, round(p, 3) AS p FROM p WHERE p >= 0.1 WINDOW w AS (PARTITION BY stop_id ORDER BY p DESC, platform) QUALIFY row_number() OVER w <= 3"""),
    "s02_union_runs": oracle("obs se", "SELECT run_id FROM obs UNION SELECT run_id FROM se"),
    "fn_dates": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, strftime(d + CAST(o_orderkey % 800 - 400 AS INT), '%Y-%m-%d') AS moved, strftime(d, '%Y%m%d') AS feed, strftime(d, '%Y-%m-%d') AS back, strftime(d - 1, '%Y-%m-%d') AS previous, CAST(floor(o_orderkey * 497 / 1000.0) AS BIGINT) AS into_day FROM o""",
    "fn_text": f"""WITH RECURSIVE t AS (SELECT id, 'Città  d''Àlba/' || (id * 7919) || CASE id % 3 WHEN 0 THEN ' ~Bivio~ è' WHEN 1 THEN ' Giunzione S.Giovanni' ELSE '' END AS name, id * 997 - 50000 AS s, CAST(ceil((id * 40000 - 600000) / 60000.0) AS BIGINT) AS m FROM (SELECT CAST(p_partkey AS BIGINT) AS id FROM part) r),
      h(id, k, v) AS (SELECT id, 0, CAST(2166136261 AS BIGINT) FROM t UNION ALL SELECT h.id, k + 1, (xor(v, CAST(unicode(substr(name, k + 1, 1)) AS BIGINT)) * 16777619) & 4294967295 FROM h JOIN t USING (id) WHERE k < length(name)),
      f AS (SELECT id, abs(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END) % 64 AS hash FROM h JOIN t USING (id) WHERE k = length(name))
      SELECT id, trim(regexp_replace(upper(strip_accents(name)), '[^A-Z0-9]+', ' ', 'g')) AS normalized, substr(regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g'), 1, 20) AS safe, CASE WHEN id % 10 = 0 THEN '_null_' ELSE substr(regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g'), 1, 64) END AS partition, hash,
        CASE WHEN s < 0 THEN '-' ELSE '' END || CASE WHEN abs(s) < 36000 THEN '0' ELSE '' END || abs(s) // 3600 || ':' || lpad(CAST(abs(s) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(s) % 60 AS VARCHAR), 2, '0') AS hms,
        CASE WHEN s < 0 THEN '-' ELSE '' END || abs(s) // 60 || 'm' || lpad(CAST(abs(s) % 60 AS VARCHAR), 2, '0') || 's' AS minutes,
        CASE WHEN id % 7 = 0 THEN 'Timetable' WHEN abs(s) < 60 THEN 'On time' ELSE CAST(floor(abs(s) / 60.0 + 0.5) AS BIGINT) || CASE WHEN s > 0 THEN ' min late' ELSE ' min early' END END AS delay,
        CASE WHEN m < 0 THEN 'Departed' WHEN m = 0 THEN 'Due now' WHEN m < 60 THEN 'In ' || m || ' min' ELSE 'In ' || m // 60 || ' hr' || CASE WHEN m % 60 = 0 THEN '' ELSE ' ' || m % 60 || ' min' END END AS departure,
        CASE WHEN id % 5 > 0 THEN CAST(floor(100 * (id % 7) / (id % 5) + 0.5) AS BIGINT) || '%' ELSE '—' END AS percent FROM t JOIN f USING (id)""",
    "fn_arrays_maps": oracle("obs", """WITH p AS (SELECT run_id, location_id, min((ts, id)) AS first, count(*) AS n FROM obs WHERE location_id IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first) AS k FROM p)
      SELECT run_id, string_agg(location_id, ',' ORDER BY k) AS places, CAST(ceil(count(*) / 4.0) AS INT) AS chunks, string_agg(location_id, ',' ORDER BY k) FILTER (k <= 4) AS first_chunk, CAST(max(n) AS INT) AS most, CAST(max(n) FILTER (k = 1) AS INT) AS first_count FROM r GROUP BY run_id"""),
}
