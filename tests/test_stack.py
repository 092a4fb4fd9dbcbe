"""The residual model's choices against numpy, on a small table."""

import numpy as np
import pytest

from pyspark.sql import functions as F
from viaduct.operators import boosting as bs
from viaduct.operators import models as md
from viaduct.operators import stack as st

NAMES = ["bias", "a", "b"]


def table(spark, n, seed, bent):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n).round(2), rng.normal(size=n).round(2)
    y = np.where(a > 0, 120.0, -80.0) if bent else 60 * a - 30 * b
    y = (y + rng.normal(size=n) * 5).round(1)
    horizon = rng.integers(0, 4000, n)
    x = np.stack([np.ones(n), a, b], axis=1)
    late = rng.integers(-200, 600, n)  # the delay that our estimate tells, in seconds
    at = np.stack([np.ones(n), (late + y) / 100 + rng.normal(size=n) / 10, b], axis=1).round(2)  # a state that tells the final delay
    rows = [(k, float(y[k]), 5.0, int(late[k]) * 1000 - 60_000, int(late[k]) * 1000, int(late[k]) * 1000 + 60_000, 0, -int(horizon[k]) * 1000, *map(float, x[k]), *map(float, at[k])) for k in range(n)]
    shape = "prediction_id long, residual double, operator_error_sec double, our_p10 long, our_p50 long, our_p90 long, sched_arr_epoch long, generated_at long, bias double, a double, b double, at_stop_bias double, at_stop_a double, at_stop_b double"
    stops = spark.createDataFrame([(float(late[k] + y[k]), *map(float, at[k])) for k in range(n)], "label_sec double, bias double, a double, b double")
    return spark.createDataFrame(rows, shape), stops, x, at, y, late.astype(float), horizon


@pytest.mark.parametrize(("bent", "with_stops"), [(True, False), (False, False), (False, True), (True, True)])
def test_choices_equal_numpy(spark, bent, with_stops):
    learn, stops, x, at, y, late, _ = table(spark, 500, 1, bent)
    judge, _, jx, jat, jy, jlate, jh = table(spark, 400, 2, bent)
    model = st.fit(learn, judge, stops if with_stops else None, NAMES, 30, 30, 100)
    forest = bs.fit(learn, NAMES[1:], [F.col("residual")], [bs.Setting(30)])[0]
    w = np.linalg.solve(x.T @ x + np.eye(3), x.T @ y)
    parts = {"ridge": jx @ w, "gbm": forest.predict(jx[:, 1:])}
    mae = {k: np.abs(jy - v).mean() for k, v in parts.items()}
    method = min(mae, key=mae.get)
    own, weight = parts[method], None
    if with_stops:
        stop = bs.fit(stops, NAMES[1:], [F.col("label_sec")], [bs.Setting(30)])[0].predict(jat[:, 1:])
        tried = [np.abs(jy - (k / 10 * own + (1 - k / 10) * (stop - jlate))).mean() for k in range(11)]
        if min(tried) < mae[method]:
            weight = int(np.argmin(tried)) / 10
            own = weight * own + (1 - weight) * (stop - jlate)
    assert (model.method, model.weight) == (method, weight)
    edge = np.select([jh <= e for e in st.EDGES], st.EDGES, st.EDGES[-1])
    for e in st.EDGES:
        left = np.sort(np.floor(np.abs(jy - own)[edge == e] + 0.5))
        k = int(0.9 * len(left)) if len(left) >= 50 else int(0.9 * max(len(left) - 1, 0))
        assert model.bands[e] == max(60, int(left[k]))
    assert model.told["mae_model"] == pytest.approx(np.abs(jy - own).mean()) and model.told["n"] == 400
    band = np.array([model.bands[int(e)] for e in edge])
    assert model.told["coverage_model"] == pytest.approx((np.abs(jy - own) <= band).mean())
    assert model.told["deploy"] == (np.abs(jy - own).mean() < np.abs(jy).mean() - 0.5 and (np.abs(jy - own) <= band).mean() >= 0.75)
    got = {r.prediction_id: r for r in st.applied(judge, model).collect()}
    for k in (0, 7, 399):
        assert got[k].p50 == pytest.approx(jlate[k] * 1000 + own[k] * 1000, abs=1) and got[k].p90 - got[k].p50 == pytest.approx(band[k] * 1000, abs=1)
        assert got[k].correction_sec == np.floor(own[k] + 0.5)


def test_stop_features_stand_for_the_operator(spark):
    rows = spark.createDataFrame([(1, 100.0, 50.0, 3_600_000, 0), (2, None, 50.0, 3_600_000, 0)], "prediction_id long, operator_delay double, our_delay double, sched_arr_epoch long, generated_at long")
    got = {r.prediction_id: r.at_stop_ourDelay for r in st.with_stop_features(rows, ["ourDelay"]).collect()}
    scale = next(scale for name, _, _, scale, _ in md.BOUNDED if name == "ourDelay")
    assert got == {1: 100 / scale, 2: 50 / scale}


def test_stop_features_need_no_join(spark):
    rows = spark.createDataFrame([(1, 10_000, 4_000, 60.0, 600.0), (2, 10_000, 4_000, None, 600.0)], "prediction_id long, sched_arr_epoch long, generated_at long, operator_delay double, our_delay double")
    told = st.with_stop_features(rows, ["ourDelay", "independentDelay"])
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.our_delay, r.at_stop_ourDelay, r.at_stop_independentDelay) for r in told.orderBy("prediction_id").collect()] == [(600.0, 0.1, 0.1), (600.0, 1.0, 1.0)]
