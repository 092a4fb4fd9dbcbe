"""Learned models against numpy, file sources against small files."""

import inspect

import numpy as np
import pytest

from pyspark.sql import functions as F
from viaduct.operators import boosting as bs
from viaduct.operators import models as md
from viaduct.operators import platforms as pf
from viaduct.plans.models import QUERIES
from viaduct.sources import providers as pv


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    rows = [(1.0, float(a), float(3 + 2 * a + e)) for a, e in zip(x, rng.normal(size=400), strict=True)]
    return spark.createDataFrame(rows, "bias double, x double, y double"), np.array(rows)


def test_ridge_is_the_closed_form(line):
    df, rows = line
    x, y = rows[:, :2], rows[:, 2]
    want = np.linalg.solve(x.T @ x + np.eye(2), x.T @ y)
    assert list(md.ridge(df, ["bias", "x"], "y").values()) == pytest.approx(list(want))


def test_ridge_of_nothing(line):
    df, _ = line
    assert md.ridge(df.where("x > 1e9"), ["bias", "x"], "y") == {"bias": 0.0, "x": 0.0}


def test_pinball_takes_the_same_steps_as_numpy(line):
    df, rows = line
    x, y = rows[:, :2], rows[:, 2]
    w = np.array([np.quantile(y, 0.9), 0.0])
    loss = lambda v: np.mean(np.maximum(0.9 * (y - x @ v), -0.1 * (y - x @ v)))
    start = loss(w)
    for _ in range(15):
        w = w + 0.5 * (np.where(y > x @ w, 0.9, -0.1)[:, None] * x).mean(axis=0)
    got = md.pinball(df.persist(), ["bias", "x"], "y", 0.9, epochs=15, rate=0.5)
    assert list(got.values()) == pytest.approx(list(w))
    assert loss(w) < start


def plain_booster(x, y, edges, rounds, rate, depth, least):
    """The booster row by row, by its definition; returns the predictions for ``x``."""

    def tree(rows, rest, level):
        mean = rest[rows].mean() if len(rows) else 0.0
        best = (1e-9, None)
        if level < depth:
            for f in range(x.shape[1]):
                for cut in edges[f]:
                    left = rows[x[rows, f] <= cut]
                    right = rows[x[rows, f] > cut]
                    if min(len(left), len(right)) >= least:
                        gain = rest[left].sum() ** 2 / len(left) + rest[right].sum() ** 2 / len(right) - rest[rows].sum() ** 2 / len(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
        if best[1] is None:
            return [(rows, mean)]
        return tree(best[1][0], rest, level + 1) + tree(best[1][1], rest, level + 1)

    out = np.full(len(y), y.mean())
    for _ in range(rounds):
        rest = y - out
        for rows, mean in tree(np.arange(len(y)), rest, 0):
            out[rows] += rate * mean
    return out


@pytest.fixture(scope="module")
def bumps(spark):
    rng = np.random.default_rng(9)
    x = np.stack([rng.normal(size=600), rng.integers(0, 4, 600), rng.normal(size=600)], axis=1).round(2)
    y = np.where(x[:, 0] > 0.3, 40, -10) + 7 * x[:, 1] * (x[:, 2] < 0) + rng.normal(size=600)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)]
    return spark.createDataFrame([*rows, (None, 1.0, 1.0, 5.0), (1.0, 1.0, 1.0, None)], "a double, b double, c double, y double"), x, y


@pytest.mark.parametrize(("depth", "least"), [(1, 1), (3, 20), (4, 60), (3, 400)])
def test_booster_equals_a_plain_one(bumps, depth, least):
    df, x, y = bumps
    edges = bs.edges_of(df.dropna(), ["a", "b", "c"], 16)
    setting = bs.Setting(12, 0.3, depth, least)
    forest = bs.fit(df, ["a", "b", "c"], [F.col("y")], [setting], bins=16)[0]
    want = plain_booster(x, y, edges, 12, 0.3, depth, least)
    assert forest.predict(x) == pytest.approx(want)
    got = bs.predicted(df, ["a", "b", "c"], {"p": forest}).toPandas()
    assert got["p"][:600].to_numpy() == pytest.approx(want) and np.isnan(got["p"][600]) and len(got) == 602


def test_booster_joins_bins_when_there_are_too_many_cells(bumps):
    df, x, y = bumps
    names = ["a", "b", "c"]
    few = bs.fit(df, names, [F.col("y")], [bs.Setting(12, 0.3, 3, 20)], bins=16, most_cells=60)[0]
    edges = [e[1::2] for e in bs.edges_of(df.dropna(), names, 16)]
    while bs.cells_of(df, names, [F.col("y")], edges).count() > 60:
        edges = [e[1::2] for e in edges]
    assert few.predict(x) == pytest.approx(plain_booster(x, y, edges, 12, 0.3, 3, 20))
    with pytest.raises(ValueError, match="cells"):
        bs.fit(df, names, [F.col("y")], [bs.Setting(1)], most_cells=0)


def test_settings_share_fits_and_targets_differ(bumps):
    df, x, y = bumps
    names, high = ["a", "b", "c"], (F.col("y") > 20).cast("int")
    settings = [bs.Setting(5, 0.2, 2, 10), bs.Setting(9, 0.2, 2, 10), bs.Setting(5, 0.2, 2, 10, target=1)]
    forests = bs.fit(df, names, [F.col("y"), high], settings)
    alone = [bs.fit(df, names, [t], [bs.Setting(n, 0.2, 2, 10)])[0].predict(x) for n, t in ((5, F.col("y")), (9, F.col("y")), (5, high))]
    for forest, want in zip(forests, alone, strict=True):
        assert forest.predict(x) == pytest.approx(want)


def test_sweep_measures_each_setting(bumps):
    df, x, y = bumps
    settings = [bs.Setting(4, 0.3, 2, 10), bs.Setting(8, 0.3, 2, 10), bs.Setting(8, 0.1, 3, 10)]
    got = {(r.rounds, r.rate): (r.n, r.mae) for r in bs.sweep(df, df, ["a", "b", "c"], "y", settings, limit=30.0).collect()}
    for s, forest in zip(settings, bs.fit(df, ["a", "b", "c"], [F.col("y")], settings), strict=True):
        n, mae = got[s.rounds, s.rate]
        assert n == 600 and mae == pytest.approx(np.abs(y - forest.predict(x).clip(-30, 30)).mean())
    assert len(bs.grid()) == len(set(bs.grid())) == 36


def test_booster_of_nothing(bumps):
    df, x, _ = bumps
    forest = bs.fit(df.limit(0), ["a", "b", "c"], [F.col("y")], [bs.Setting(3)])[0]
    assert (forest.predict(x) == 0).all()


def test_platforms_against_the_usual_one(spark):
    """Two stations whose platform follows the route at one and the platform before at the other."""
    rows, rng = [], np.random.default_rng(2)
    for k in range(900):
        before = str(1 + int(rng.integers(2)))
        rows.append((k, 1, "S1", f"R{k % 2}", str(1 + k % 2), k * 600_000, None))
        rows.append((k, 2, "S2", "R0", "4" if before == "2" else "3", k * 600_000 + 1, before))
    calls = spark.createDataFrame([*rows, (1, 9, "S1", "R0", "31", 5, None), (1, 10, "S1", "R0", "x", 5, None)], "run_id long, stop_sequence int, stop_id string, route_id string, platform string, leaves_at long, previous string")
    learn, judge = calls.where("run_id < 700"), calls.where("run_id >= 700")
    modes = {(r.stop_id, r.route_id): (r.usual, r.usual_share) for r in pf.usual(learn.where("platform < '31'")).collect()}
    assert modes["S1", "R0"] == ("1", 1.0) and modes["S1", "R1"] == ("2", 1.0)
    got = pf.judged(learn, judge).first()
    assert got.n == 400 and got.top1 == 1.0 and 0.6 < got.baseline < 0.9 and got.change_n > 50 and got.change_top1 == 1.0 and got.deploy


def test_forest_and_missing_features(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    assert [r[0] for r in df.select(md.forest([("x", 0.5, 2, 4), -1], 0.5, 1.0)).collect()] == [1.5, 2.5]
    rows = spark.createDataFrame([(3_600_000, 0)], "sched_arr_epoch bigint, generated_at bigint")
    got = rows.select(*md.feature_row(rows)).first().asDict()
    assert list(got) == list(md.NAMES) and got["eventHours"] == 1 and got["anchorNone"] == 1


def test_files(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text('{"type":"REG","train":"1","stops":[{"node":7,"arr":1,"dep":2}]}\nbroken\n{"type":"IC","train":"2","stops":[]}\n')
    (tmp_path / "nodes.tsv").write_text("1\tA\t45.5\t9.1\n2\tB\tx\t9.1\n3\tC\tNaN\t9\n")
    (tmp_path / "strikes.json").write_text('[{"title":"a","start":1,"stop":2},\n{"title":"b","start":2,"stop":2},{"title":"c","start":1}]')
    (tmp_path / "stops.txt").write_text('﻿stop_id,stop_name\n1,"a ""b"", c"\n,\n2,"two\nlines"\n', encoding="utf-8")
    assert [r.train for r in pv.history(spark, str(tmp_path / "runs.jsonl")).collect()] == ["1"]
    assert [r.node for r in pv.nodes(spark, str(tmp_path / "nodes.tsv")).collect()] == ["1"]
    assert [r.title for r in pv.strikes(spark, str(tmp_path / "strikes.json")).collect()] == ["a"]
    assert [tuple(r) for r in pv.feed(spark, str(tmp_path), "stops").collect()] == [("1", 'a "b", c'), ("2", "two\nlines")]


def test_payload_edges(spark):
    raw = spark.createDataFrame([("nonsense",), (None,), ('{"numeroTreno":"9","fermate":[{"id":"S1","programmata":"1500000000","effettiva":"--","ritardo":null,"binario":"0"}]}',)], "raw string")
    assert [tuple(r) for r in pv.vt_stops(raw).collect()] == [("9", 0, "S1", 1_500_000_000_000, None, None)]
    lines = spark.createDataFrame([("A|12-S1-1500000000000",), ("no bar",), ("B|1-2",), (None,)], "line string")
    assert [tuple(r) for r in pv.autocomplete(lines).collect()] == [("A", "12", "S1", 1_500_000_000_000)]


def test_registered_fits_run_to_their_end():
    of = lambda f, name: inspect.signature(f).parameters[name].default
    assert of(QUERIES["m05_pinball"], "epochs") == of(md.pinball, "epochs") == 500
    assert of(QUERIES["m06_boosted_gate"], "rounds") == bs.Setting().rounds == 150
