"""Trust between sources and reliability views, by hand."""

from pyspark.sql import functions as F
from viaduct.operators import reliability as rl
from viaduct.operators import trust as tr

SHAPE = "id long, c array<struct<source: string, value: double, observed_at: long, state: string, confidence: double>>"


def said(spark, *cases):
    return spark.createDataFrame([(k, [(s, None if v is None else float(v), at, state, conf) for s, v, at, state, conf in case]) for k, case in enumerate(cases)], SHAPE)


def picked(spark, field, agreement, *cases):
    rows = tr.resolved(said(spark, *cases), "c", field, "p", agreement).collect()
    return {r.id: r.p and (r.p.source, r.p.trust, r.p.value, r.p.runner_up, r.p.disagreement) for r in rows}, {r.id: r.p and r.p.reason for r in rows}


def c(source, value, at, state=None, confidence=None):
    return source, value, at, state, confidence


def test_delay_of_three_sources(spark):
    got, why = picked(
        spark, "current_delay", 60,
        [c("viaggiatreno", 100, 1000), c("mia", 130, 2000), c("gtfsrt", 140, 9000)],  # the freshest of all agrees, though it is the least trusted
        [c("viaggiatreno", 100, 1000), c("mia", 130, 2000), c("gtfsrt", 900, 9000)],  # the freshest disagrees; the runner-up's agreement does not count
        [c("viaggiatreno", 100, 9000), c("mia", 400, 2000), c("gtfsrt", 900, 1000)],
        [c("viaggiatreno", 100, 1000, "DEGRADED"), c("mia", 400, 2000)],
        [c("viaggiatreno", 100, 1000, "PAUSED"), c("mia", 400, 500, "HEALTHY")],
        [c("mia", 5, None), c("mia", 5, 10)], [], [c("gtfsrt", 1, 100), c("other", 500, 100)],
    )
    assert got == {
        0: ("gtfsrt", "LOW", 140.0, "viaggiatreno", 40), 1: ("viaggiatreno", "HIGH", 100.0, "mia", 30), 2: ("viaggiatreno", "HIGH", 100.0, "mia", 300), 3: ("mia", "MEDIUM", 400.0, "viaggiatreno", 300),
        4: ("mia", "MEDIUM", 400.0, "viaggiatreno", 300), 5: ("mia", "MEDIUM", 5.0, None, None), 6: None, 7: ("gtfsrt", "LOW", 1.0, "other", 499),
    }
    assert why[0] == "gtfsrt fresher and agrees with viaggiatreno within 60s (delta 40s); freshness decides (current_delay); disagreement 40s"
    assert why[2] == "viaggiatreno:HIGH beats mia:MEDIUM (current_delay trust table); disagreement 300s"
    assert why[3] == "mia and viaggiatreno equal trust MEDIUM, fresher by 1s; fresher wins (current_delay); disagreement 300s; degraded viaggiatreno HIGH->MEDIUM (DEGRADED)"
    assert why[4].endswith("degraded viaggiatreno HIGH->LOW (PAUSED)") and why[5] == "mia: sole candidate (current_delay, trust MEDIUM)"


def test_position_is_the_freshest_of_those_who_see_the_tracks(spark):
    got, why = picked(
        spark, "position", 0,
        [c("ours", 1, 9000), c("mia", 2, 5000), c("viaggiatreno", 3, 6000)], [c("ours", 1, 9000), c("fans", 2, 9500)], [c("viaggiatreno", 1, 500), c("mia", 2, 500), c("gtfsrt", 3, None)],
    )
    assert [got[k][0] for k in range(3)] == ["viaggiatreno", "fans", "mia"] and got[0][1] is None
    assert why[2].startswith("mia wins: freshest infrastructure observation (mia@500 vs viaggiatreno@500 vs gtfsrt@?)")


def test_a_model_counts_by_its_confidence(spark):
    cases = [[c("ours", 1, 10, None, p), c("mia", 2, 20)] for p in (0.75, 0.74, 0.49, None)] + [[c("ours", 1, 30, None, 0.5), c("mia", 2, 20)]]
    got, _ = picked(spark, "future_eta", 0, *cases)
    assert [got[k][0] for k in range(5)] == ["ours", "mia", "mia", "mia", "ours"]


def test_reliability_of_a_train(spark):
    day = rl.DAY
    runs = spark.createDataFrame([(k, "9", "1970-02-%02d" % (1 + k % 27) if k < 24 else "1970-01-01", "Z") for k in range(30)], "run_id long, train_number string, service_date string, destination_stop_id string")
    events = spark.createDataFrame([(k, "Z", 60 * k, None) for k in range(30)] + [(k, "Y", 5, 1) for k in range(3)], "run_id long, stop_id string, arr_delay_sec int, cancelled int")
    ways = [("A>B", "A", "B", 31), ("C>D", "C", "D", -16), ("B>C", "B", "C", 90)]
    traversals = spark.createDataFrame([(k, s, a, z, late + (k % 3 - 1), 40 * day) for s, a, z, late in ways for k in range(19 if s == "B>C" else 21)], "run_id long, segment_id string, from_stop_id string, to_stop_id string, delay_delta_sec long, entered_at long")
    stops = spark.createDataFrame([("A", "Alfa")], "stop_id string, stop_name string")
    got = rl.train_reliability(events, runs, traversals, stops, 60 * day).collect()
    assert len(got) == 1 and got[0].asDict() == {
        "train_number": "9", "completed": 24, "on_time_pct": 12.5, "late5_pct": 79.2, "late10_pct": 58.3, "cancelled_pct": 11.1, "median_sec": 720, "p90_sec": 1260,
        "worst_from": "Alfa", "worst_to": "B", "worst_sec": 31, "worst_n": 21, "recovery_from": "C", "recovery_to": "D", "recovery_sec": -16, "recovery_n": 21,
    }
    calls = events.withColumn("stop_id", F.lit("Z"))
    routes = runs.withColumn("route_id", F.when(F.col("run_id") != 5, "R"))
    row = rl.stop_reliability(calls, routes, 60 * day).first()
    assert (row.n, row.on_time_pct, row.median_sec) == (26, 23.1, 660)
