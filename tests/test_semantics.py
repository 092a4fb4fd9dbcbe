"""Values worked out by hand for rules that are easily misread."""

from pyspark.sql import functions as F

from viaduct.functions import semantics as sem
from viaduct.operators import evaluate, fusion, joins, metro, quality, schedule, segments, upserts


def test_peak_and_rush_hours(spark):
    rows = spark.range(24).select("id", sem.is_peak(F.col("id")).alias("p"), sem.is_rush(F.col("id")).alias("r")).collect()
    assert {r.id for r in rows if r.p} == {7, 8, 16, 17, 18} and {r.id for r in rows if r.r} == {7, 8, 17, 18}


def test_quantiles_of_large_groups(spark):
    values = [(k % 2, (k * k) % 97) for k in range(500)] + [(3, 5), (None, 1), (None, 9)]
    df = spark.createDataFrame(values, "g int, x int")
    got = {r.g: (r.a, r.b) for r in sem.floor_indices(df, ["g"], F.col("x"), {"a": 0.5, "b": 0.95}).collect()}
    for g in (0, 1, 3, None):
        xs = sorted(x for k, x in values if k == g)
        assert got[g] == tuple(xs[min(len(xs) - 1, int(len(xs) * q))] for q in (0.5, 0.95))
    exact = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("x", 0.3).alias("m")).collect()}
    assert {r.g: round(r.m, 9) for r in sem.quantiles_of(df, ["g"], F.col("x"), {"m": 0.3}).collect()} == {g: round(m, 9) for g, m in exact.items()}


def test_time_split_counts_rows(spark):
    df = spark.createDataFrame([(1, 1), (2, 5), (2, 4), (2, 3), (9, 2)], "at long, id long")
    assert {(r.at, r.id) for r in evaluate.time_split(df, ["at", "id"], 0.6).where("is_train").collect()} == {(1, 1), (2, 3), (2, 4)}


def test_dwell_leaves_out_nothing_and_half_hours(spark):
    df = spark.createDataFrame([("A", 0, d) for d in (0, 30, 50, 90, 1800, -5)] + [("B", 0, 900)], "stop_id string, arrival_sec int, departure_sec int")
    assert {r.stop_id: r.dwell_sec for r in segments.dwell(df).collect()} == {"A": 50, "B": 180}


def test_historical_pairs_keep_their_bounds(spark):
    m = 60_000
    stop = lambda run, k, plan, real: (run, k, "ABCD"[k], plan * m + 10**9, None if real is None else real * m + 10**9)
    rows = [stop(1, 0, 0, 1), stop(1, 1, 10, None), stop(1, 2, 20, 24), stop(2, 0, 0, 0), stop(2, 1, 61, 61), stop(3, 0, 0, 0), stop(3, 1, 20, 4), stop(4, 0, 0, -16), stop(4, 1, 20, 4)]
    df = spark.createDataFrame(rows, "run_id long, stop_sequence int, stop_id string, sched_arr_epoch long, actual_arr_epoch long")
    dwells = spark.createDataFrame([("A", 100)], "stop_id string, dwell_sec long")
    assert [tuple(r) for r in segments.historical_pairs(df, dwells).select("segment_id", "run_id", "runtime_sec", "delay_delta_sec", "excess_sec").collect()] == [("A>C", 1, 23 * 60 - 100, 180, 180)]


def test_registry_keeps_stations(spark):
    rows = [(1, "X", 1, 45.0, 9.0, "PASSENGER_STATION"), (2, "X", 2, None, 9.5, None), (3, "Bivio Y", 1, None, None, None), (4, "Bivio Y", 5, 44.0, None, "PASSENGER_STATION"), (5, "Giunzione Z", 1, 1.0, 1.0, "BIVIO"), (6, "Giunzione Z", 2, 2.0, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, seen_at long, lat double, lon double, type string")
    got = {r.key: (r.type, r.lat, r.lon, r.observation_count) for r in upserts.rail_locations(df).collect()}
    assert got == {"x": ("PASSENGER_STATION", 45.0, 9.5, 2), "bivio-y": ("PASSENGER_STATION", 44.0, None, 2), "giunzione-z": ("JUNCTION", 2.0, 1.0, 2)}


def test_status_follows_stops_then_codes_then_the_clock(spark):
    cases = [((True, True, True, "A", 5), "cancelled"), ((False, True, True, "V", 5), "arrived"), ((False, False, True, "N", 50), "running"), ((False, False, False, "PG", 5), "scheduled"), ((False, False, False, None, 50), "scheduled"), ((False, False, False, None, 5), "running"), ((False, False, False, None, None), "unknown"), ((False, False, False, "ST", 5), "cancelled")]
    df = spark.createDataFrame([v for v, _ in cases], "c boolean, a boolean, p boolean, code string, dep long").coalesce(1)
    assert [r.s for r in df.select(fusion.status(F.col("c"), F.col("a"), F.col("p"), F.col("code"), F.col("dep"), 10).alias("s")).collect()] == [s for _, s in cases]


def test_positions_go_back_against_any_source(spark):
    rows = [(1, 7, "mia", 1, 1, None, "S00005", 5), (2, 7, "vt", 2, 2, None, "S00003", 3), (3, 7, "vt", 3, 3, None, "S00006", 6)]
    df = spark.createDataFrame(rows, "id long, run_id long, source string, ts long, observed_at long, delay_seconds int, location_id string, seq int")
    known = spark.createDataFrame([(7,)], "run_id long")
    stops = spark.createDataFrame([("S00003",), ("S00005",), ("S00006",)], "stop_id string")
    assert {r.id: r.flags for r in quality.observation_flags(df, known, stops, ["mia", "vt"]).collect()} == {1: [], 2: ["BACKWARDS_TELEPORT"], 3: []}


def test_poll_cadence(spark):
    m = 60_000
    cases = [(True, "arrived", 0, 0, 25), (False, "running", -m, 90 * m, 30), (False, None, 61 * m, 90 * m, 300), (False, None, 31 * m, 90 * m, 120), (False, None, 11 * m, 90 * m, 60), (False, None, 10 * m, 90 * m, 30), (False, "cancelled", m, 90 * m, None), (False, None, -90 * m, -16 * m, None)]
    df = spark.createDataFrame([c[:4] for c in cases], "w boolean, s string, dep long, arr long").coalesce(1)
    assert [r.i for r in df.select(schedule.poll_interval(F.col("w"), F.col("s"), F.col("dep"), F.col("arr"), F.lit(0)).alias("i")).collect()] == [c[4] for c in cases]


def test_semi_range_join_keeps_repeats(spark):
    left = spark.createDataFrame([("a", 10), ("a", 10), ("a", 50), ("b", 10)], "k string, t long")
    right = spark.createDataFrame([("a", 12), ("a", 15), ("a", 18)], "k string, u long")
    assert sorted(tuple(r) for r in joins.range_join(left, right, ["k"], "t", "u", 1, 9, "left_semi").collect()) == [("a", 10), ("a", 10)]
    assert joins.range_join(left, right, ["k"], "t", "u", 1, 9).count() == 6


def test_passages_need_a_near_line_that_vanishes(spark):
    s = 30_000
    rows = [("A", 0, "1", 1, 80), ("A", 0, "2", 2, 200), ("A", s, "2", 3, 60), ("A", 2 * s, "2", 4, 50), ("A", 3 * s, None, 5, None), ("B", 5 * s, None, 1, None), ("B", 4 * s, "2", 1, 30)]
    df = spark.createDataFrame(rows, "stop_id string, fetched_at long, line string, seq long, eta_sec long")
    p = metro.passages(df)
    assert sorted(tuple(r) for r in p.collect()) == [("A", "1", s), ("A", "2", 3 * s), ("B", "2", 5 * s)]
    adjacent = spark.createDataFrame([("A", "B")], "stop_id string, to_stop string")
    assert [tuple(r) for r in metro.linked(p, adjacent).collect()] == [("A", "2", 3 * s)]
