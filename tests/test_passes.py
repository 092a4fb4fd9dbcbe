"""Passes that fits make over their rows: none sorts or joins what it can count or carry along."""

import gc

import numpy as np
import pytest

from tests.oracle import SMALL
from viaduct.operators import evaluate as ev
from viaduct.operators import training as tr
from viaduct.plans import models as plans
from viaduct.plans.registry import QUERIES
from viaduct.sources import bindings as b


@pytest.mark.parametrize("ranges", [2, 7, 1 << 14])
def test_the_edge_is_where_the_share_is_reached(spark, ranges):
    rng = np.random.default_rng(8)
    at = [int(v) for v in rng.integers(-(10**12), 10**12, 200)] + [5] * 40
    rows = spark.createDataFrame([(v,) for v in at] + [(None,)] * 9, "at long")
    for share in (0.0, 0.001, 0.5, 0.8, 1.0):
        left = int(len(at) * share)
        edge = sorted(at)[left - 1] if left else None
        assert ev._edge(rows, "at", share, ranges) == (edge, left - sum(v < edge for v in at) if left else None)
    assert ev._edge(rows.where("at IS NULL"), "at", 0.8) == (None, None)


def test_halves_sort_no_rows(spark, monkeypatch):
    monkeypatch.setattr(ev, "running_counts", None)
    early, late = ev.halves(spark.range(100).withColumnRenamed("id", "at"), ["at"])
    assert (early.count(), late.count()) == (80, 20)


def test_stops_meet_their_run_once(spark):
    """A run's facts need no join with its own stops; those that are left are with orders and customers."""
    _, stops = plans.stacking(spark, SMALL)
    assert stops._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3
    t = tr.stop_level(b.stop_events(spark, SMALL), b.runs(spark, SMALL), "1992-01-01")
    assert sorted(r[0] for r in stops.select("label_sec").collect()) == sorted(r[0] for r in t.select("label_sec").collect())


def test_context_holds_its_stops_while_its_table_is_used(spark):
    held = spark.sparkContext._jsc.getPersistentRDDs
    before = held().size()
    table = QUERIES["m14_feature_context"](spark, SMALL)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") >= 8 and plan.count("lineitem.parquet") <= plan.count("InMemoryRelation")
    assert table.count() > 0 and held().size() > before
    del table
    gc.collect()
    assert held().size() == before


def test_served_rows_are_those_that_were_fitted(spark, monkeypatch):
    asked, stacking = [], plans.stacking
    monkeypatch.setattr(plans, "stacking", lambda s, d: asked.append(d) or stacking(s, d))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    table = QUERIES["m09_stack_served"](spark, SMALL)
    assert len(asked) == 1 and table.count() == stacking(spark, SMALL)[0].count()
    del table
    gc.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
