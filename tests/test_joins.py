import random

from viaduct.operators import joins as jn
from viaduct.operators.export import differences


def test_asof_takes_latest_with_tie_and_tolerance(spark):
    left = spark.createDataFrame([(1, "a", 100), (2, "a", 5), (3, "b", 100), (4, None, 1)], "id int, k string, t long")
    right = spark.createDataFrame([("a", 50, 1, 7.0), ("a", 50, 2, 8.0), ("a", 101, 3, 9.0), ("c", 1, 4, 1.0)], "k string, rt long, rid int, v double")
    found = lambda tol: {r.id: r.v for r in jn.asof_backward(left, right, ["k"], "t", "rt", ["v"], "rid", tol).collect()}
    assert found(None) == {1: 8.0, 2: None, 3: None, 4: None}
    assert found(49)[1] is None and found(50)[1] == 8.0


def test_range_join_equals_brute_force(spark):
    rng = random.Random(3)
    a = [(k, rng.choice("xy"), rng.randrange(-500, 500)) for k in range(120)]
    c = [(k, rng.choice("xy"), rng.randrange(-500, 500)) for k in range(120)]
    left, right = spark.createDataFrame(a, "i int, k string, t long"), spark.createDataFrame(c, "j int, k string, u long")
    for low, high in ((-30, 45), (0, 0), (5, 200)):
        want = sorted((i, j) for i, k, t in a for j, m, u in c if k == m and low <= u - t <= high)
        assert sorted((r.i, r.j) for r in jn.range_join(left, right, ["k"], "t", "u", low, high).collect()) == want
        semi = jn.range_join(left, right, ["k"], "t", "u", low, high, "left_semi").collect()
        assert sorted(r.i for r in semi) == sorted({i for i, _ in want})


def test_differences_count_repeats(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    b = spark.createDataFrame([("x", 2), (None, 1), ("y", 3)], "b string, a int")
    assert {(r.a, r.b, r.more, r.side) for r in differences(a, b).collect()} == {(1, None, 1, "left"), (3, "y", 1, "right")}
    assert differences(a, a).isEmpty()


def test_differences_shuffle_no_equal_rows(spark):
    a = spark.range(20_000).selectExpr("id", "IF(id % 3 = 0, NULL, id * 31) AS x", "IF(id % 3 = 1, NULL, id * 31) AS y", "concat(sha2(CAST(id AS STRING), 512), sha2(CAST(-id AS STRING), 512)) AS text")
    wrote = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = wrote()
    assert differences(a, a).isEmpty()
    assert wrote() - before < 20_000 * 256 / 2  # half of one copy of the rows
    swapped = a.selectExpr("id", "IF(id = 9, y, x) AS x", "IF(id = 9, x, y) AS y", "text").union(a.where("id = 7"))
    assert sorted((r.id, r.more, r.side) for r in differences(a, swapped).collect()) == [(7, 1, "right"), (9, 1, "left"), (9, 1, "right")]


def test_scored_predictions_are_read_once(spark):
    from tests.oracle import SMALL
    from viaduct.sources import bindings as b

    plan = b.scored(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # lines with orders
