"""Tables by service day: merges in any order of arrival, retirement of whole days; recovery forecasts by hand."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from tests.oracle import SMALL
from viaduct.functions import semantics as sem
from viaduct.operators import stop_events as se
from viaduct.sources import bindings as b
from viaduct.sources import landing, tables

SHAPE = "run_id long, stop_id string, service_date string, ts long, id long, stop_sequence int, sched_arr_epoch long, sched_dep_epoch long, platform_sched string, op_pred_arr_epoch long, op_pred_dep_epoch long, actual_arr_epoch long, actual_dep_epoch long, arr_delay_sec int, dep_delay_sec int, platform_actual string, platform_is_actual int, cancelled int, source string"


def said(run, stop, day, ts, **known):
    names = [p.split()[0] for p in SHAPE.split(", ")]
    base = {"run_id": run, "stop_id": stop, "service_date": day, "ts": ts, "id": ts}
    return tuple((base | known).get(n) for n in names)


PARTS = [
    [said(1, "A", "2024-01-01", 10, stop_sequence=4, sched_arr_epoch=100, source="mia", op_pred_arr_epoch=7), said(2, "A", "2024-01-02", 5, source="vt", cancelled=1)],
    [said(1, "A", "2024-01-01", 20, stop_sequence=9, sched_arr_epoch=999, actual_arr_epoch=105, actual_dep_epoch=110, arr_delay_sec=5, platform_actual="3", source="vt", platform_is_actual=1)],
    [said(1, "A", "2024-01-01", 30, stop_sequence=4, source="mia", dep_delay_sec=9, cancelled=0), said(2, "A", "2024-01-02", 4, stop_sequence=2, source="mia")],
]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_any_order_of_arrival_gives_one_state(spark, tmp_path, order):
    path = str(tmp_path / "events")
    for k in (*order, order[0]):  # a part that comes again changes nothing
        tables.merge_days(path, se.states(spark.createDataFrame(PARTS[k], SHAPE)), se.merged)
    got = {r.run_id: r.asDict() for r in se.view(spark.read.parquet(path).withColumn("service_date", F.col("service_date").cast("string"))).collect()}
    assert len(got) == 2
    one = got[1]
    assert (one["stop_sequence"], one["sched_arr_epoch"]) == (4, 100)  # the first writer's
    assert (one["actual_arr_epoch"], one["platform_actual"], one["arr_delay_sec"], one["dep_delay_sec"], one["cancelled"]) == (105, "3", 5, 9, 0)  # never back to null
    assert (one["actual_dep_epoch"], one["op_pred_arr_epoch"], one["platform_is_actual"], one["source"], one["updated_at"]) == (None, None, None, "mia", 30)  # the last writer's
    assert (got[2]["stop_sequence"], got[2]["cancelled"], got[2]["source"]) == (2, 1, "vt")


def test_only_touched_days_are_written(spark, tmp_path):
    path = str(tmp_path / "events")
    assert tables.merge_days(path, se.states(spark.createDataFrame(PARTS[0], SHAPE)), se.merged) == ["2024-01-01", "2024-01-02"]
    day = f"{path}/service_date=2024-01-02"
    before = sorted(os.listdir(day))
    assert tables.merge_days(path, se.states(spark.createDataFrame(PARTS[1], SHAPE)), se.merged) == ["2024-01-01"]
    assert sorted(os.listdir(day)) == before and tables.days(spark, path) == ["2024-01-01", "2024-01-02"]


def test_retirement_deletes_days_and_keeps_some_tables_for_ever(spark, tmp_path):
    path = str(tmp_path / "events")
    tables.merge_days(path, se.states(spark.createDataFrame(PARTS[0], SHAPE)), se.merged)
    assert tables.retire(spark, "predictions", path, "2030-01-01") == [] and len(tables.days(spark, path)) == 2
    assert tables.retire(spark, "train_stop_events", path, "2024-01-02") == ["2024-01-01"] and tables.days(spark, path) == ["2024-01-02"]
    assert [r.run_id for r in spark.read.parquet(path).collect()] == [2]
    assert tables.retire(spark, "train_stop_events", str(tmp_path / "none"), "2024-01-02") == []


def test_a_cluster_must_name_its_shared_folder():
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        landing.scratch(Cluster, "x")


def test_recovery(spark):
    m = 60_000
    rows = [(600, 0, 2 * m, 5 * m, 9 * m), (0, 0, 2 * m, 5 * m, 9 * m), (600, None, 2 * m, 5 * m, 9 * m), (None, 0, 2 * m, 5 * m, 9 * m), (600, 0, 0, 5 * m, 31 * m), (600, 0, 1 * m, 5 * m, 31 * m), (60, 0, 2 * m, 5 * m, 9 * m)]
    df = spark.createDataFrame(rows, "late int, sched long, p10 long, p50 long, p90 long")
    got = df.select(sem.recovery_forecast(*map(F.col, ("late", "sched", "p10", "p50", "p90"))).alias("f"), sem.recovery_prediction(F.col("late"), F.col("sched"), F.col("p50")).alias("g")).collect()
    assert [r.f and (r.f.prob_recover, r.f.expected_delay_sec, r.f.recover_by_sec) for r in got] == [(0.8, 300, 120), None, None, None, None, (0.55, 300, 120), (0.02, 300, 120)]
    assert [r.g for r in got] == [300, -300, None, None, 300, 300, -240]


def test_stop_events_are_cut_into_partitions_of_bounded_size(spark):
    lines = b.table(spark, SMALL, "lineitem")
    assert b.parts(lines, rows=100) == -(-lines.count() // 100)
    assert b.parts(lines) == b.stop_events(spark, SMALL).rdd.getNumPartitions()
