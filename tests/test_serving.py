"""Serving views against brute force."""

import math
import random

import pytest

from viaduct.operators import serving as sv


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return round(2 * 6371.0088 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)), 6)


def most_joined(df) -> int:
    """The most rows that a join of the finished query gave."""
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name.endswith("JoinExec"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return max(found)


def frames(spark, places, stops):
    return spark.createDataFrame(places, "place_id long, lat double, lon double"), spark.createDataFrame(stops, "stop_id string, stop_lat double, stop_lon double")


@pytest.mark.parametrize("spread", [1.5, 0.2, 0.004])
def test_nearest_equals_brute_force(spark, spread):
    rng = random.Random(7)
    spot = lambda: (45 + rng.choice((1, 0.01)) * rng.uniform(-spread, spread), 9 + rng.choice((1, 0.01)) * rng.uniform(-spread, spread))
    stops = [(f"S{k:03}", *spot()) for k in range(150)]
    stops += [(f"R{k}", *stops[k][1:]) for k in range(20)] + [("N", None, 9.0)]
    places = [(k, *spot()) for k in range(200)] + [(900 + k, *stops[k][1:]) for k in range(20)] + [(990, None, 9.0), (991, -33.9, -70.6)]
    want = {}
    for k, lat, lon in places:
        found = [(km(lat, lon, y, x), s) for s, y, x in stops if y is not None and lat is not None]
        if found and min(found)[0] <= 5:
            want[k] = min(found)
    got = {r.place_id: (r.km, r.stop_id) for r in sv.nearest_within(*frames(spark, places, stops), 5.0).collect()}
    assert {k: s for k, (_, s) in got.items()} == {k: s for k, (_, s) in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 1e-5 for k in want)


@pytest.mark.parametrize("repeated", [True, False])
def test_nearest_forms_no_square_of_pairs(spark, repeated):
    rng = random.Random(8)
    n = 1500
    spot = lambda k: (45 + k % 5 / 1000, 9 + k % 7 / 1000) if repeated else (45 + rng.uniform(0, 0.03), 9 + rng.uniform(0, 0.03))
    found = sv.nearest_within(*frames(spark, [(k, *spot(k)) for k in range(n)], [(f"S{k}", *spot(k)) for k in range(n)]), 5.0)
    assert len(found.collect()) == n
    assert most_joined(found) < 40 * n
