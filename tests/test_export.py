"""The typed export: cells of well-formed, wrongly typed, missing and broken features."""

from pyspark.sql import functions as F

from viaduct.operators import export as ex

JSON = [
    (1, '{"anchorKind": "actual_dep", "anchorEpoch": 1700000000000.5, "remainingSegments": 4, "statsCoverage": 0.75, "precipMm": 1.5, "originDepDelaySec": -2.5, "independentP50": 1700000000123, "extra": [1]}'),
    (2, '{"anchorKind": 5, "remainingSegments": "4", "precipMm": true, "holiday": null, "strikeActive": {"a": 1}, "networkDelaySec": 7}'),
    (3, '{"anchorKind": ""}'),
    (4, '{"anchorKind": '),
    (5, "[]"),
    (6, None),
    (7, ""),
    (8, '{"precipMm": NaN, "routeEncSec": "Infinity", "etaAccelSec": 1e3}'),
]
ZERO = {"f_remaining_segments": 0, "f_stats_coverage": 0.0, "f_corridor_adjust_sec": 0, "f_operator_weight": 0.0}


def test_features_of_odd_json(spark):
    rows = spark.createDataFrame(JSON, "id int, j string")
    got = {r["id"]: {k: v for k, v in r.asDict().items() if v is not None and k != "id"} for r in rows.select("id", *ex.features(F.col("j"))).collect()}
    assert got[1] == ZERO | {"f_anchor_kind": "actual_dep", "f_anchor_epoch": 1700000000001, "f_remaining_segments": 4, "f_stats_coverage": 0.75, "f_precip_mm": 1.5, "f_origin_dep_delay_sec": -2, "f_independent_p50": 1700000000123}
    assert got[2] == ZERO | {"f_network_delay_sec": 7}
    assert got[3] == got[4] == got[5] == got[6] == got[7] == ZERO
    assert got[8] == ZERO | {"f_eta_accel_sec": 1000.0}


def test_single_numbers_of_odd_json(spark):
    rows = spark.createDataFrame([(1, '{"k": 2.5}'), (2, '{"k": "2.5"}'), (3, '{"k": true}'), (4, "{"), (5, None), (6, '{"k": -0.5}')], "id int, j string")
    got = rows.select("id", ex.feature_number(F.col("j"), "k", 9).alias("n"), ex.feature_int(F.col("j"), "k").alias("i")).orderBy("id").collect()
    assert [(r["n"], r["i"]) for r in got] == [(2.5, 3), (9, None), (9, None), (9, None), (9, None), (-0.5, 0)]


def test_columns_and_rows_of_the_export(spark):
    runs = spark.createDataFrame([(1, "1996-01-01", "12", "R1", "alpha", "x")], "run_id long, service_date string, train_number string, route_id string, operator string, confidence_of_run string")
    shape = "prediction_id long, run_id long, stop_id string, model_version string, generated_at long, sched_arr_epoch long, operator_eta_epoch long, our_p10 long, our_p50 long, our_p90 long, confidence double, actual_arr_epoch long, operator_error_sec long, our_error_sec long, features_json string"
    full = [7, 1, "S1", "v", 1000, 301_999, None, 1, 2, 3, 0.5, 302_000, None, 300, "{}"]
    rows = [tuple(full), tuple([8, *full[1:14], None]), tuple([9, *full[1:5], None, *full[6:]]), tuple([10, 2, *full[2:]])]
    out = ex.export_rows(spark.createDataFrame(rows, shape), runs)
    assert len(out.columns) == len(set(out.columns)) == 41
    (row,) = out.collect()  # without features, without a timetable and without a run there is no row
    assert (row["prediction_id"], row["horizon_sec"], row["horizon_bucket"], row["line"]) == (7, 300, "0-5m", "R1")


def test_features_are_parsed_once(spark):
    rows = spark.createDataFrame(JSON, "id int, j string").select("id", *ex.features(F.col("j")))
    schemas = rows._jdf.queryExecution().optimizedPlan().toString().split("from_json(StructField(")[1:]
    assert schemas and all("etaAccelSec" in x and "anchorKind" in x for x in schemas)  # one and the same parse, shared by all columns
