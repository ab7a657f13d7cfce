"""Results that hang on the last bit of a double."""

import duckdb
import numpy as np

from panoply.functions import calibration
from panoply.operators import clouds, sequence
from panoply.plans.queries import rounded


def test_quantile_of_equal_values_is_that_value(spark):
    groups = {n: round(0.01 * n + 0.07, 2) for n in range(2, 200)}
    assert any((1 - f) * v + f * v != v for n, v in groups.items() for f in [0.03 * (n - 1) % 1])
    df = spark.createDataFrame([(n, v) for n, v in groups.items() for _ in range(n)], "k long, v double")
    shares = {f"p{p}": p for p in (0.03, 0.2, 0.9)}
    for r in sequence.quantiles(df, ["k"], "v", shares).collect():
        assert [r[name] for name in shares] == [groups[r.k]] * 3, r.k
    assert clouds.density_cut(df, "v", ["k"]).count() == df.count()


def test_quantile_between_neighbours_is_rounded_as_by_sql(spark):
    rng = np.random.default_rng(3)
    groups = {n: sorted(np.round(rng.random(n) * 300, 2).tolist()) for n in range(2, 120)}
    df = spark.createDataFrame([(n, v) for n, vs in groups.items() for v in vs], "k long, v double")
    shares = {"a": 0.03, "b": 0.2, "c": 0.9}
    db = duckdb.connect()
    for r in sequence.quantiles(df, ["k"], "v", shares).collect():
        asked = ", ".join(f"quantile_cont(v, {p})" for p in shares.values())
        assert (r.a, r.b, r.c) == db.execute(f"SELECT {asked} FROM (SELECT unnest(?) AS v)", [groups[r.k]]).fetchall()[0], r.k
    nothing = spark.createDataFrame([(1, None), (2, 5.0)], "k long, v double")
    assert sorted(map(tuple, sequence.quantiles(nothing, ["k"], "v", {"m": 0.5}).collect())) == [(1, None), (2, 5.0)]


def test_quantile_of_few_equal_values_is_that_of_the_sql(spark):
    groups = {1000 * n + k: (n, k / 100) for n in (5, 9, 15, 17) for k in range(1, 400)}
    df = spark.createDataFrame([(g, v) for g, (n, v) in groups.items() for _ in range(n)], "k long, v double")
    rows = "SELECT g.k, g.v FROM (SELECT unnest(?, recursive := true)) g, range(g.k // 1000)"
    want = dict(duckdb.connect().execute(f"SELECT k, quantile_cont(v, 0.03) FROM ({rows}) GROUP BY k", [[{"k": g, "v": v} for g, (_, v) in groups.items()]]).fetchall())
    assert any(x != groups[g][1] for g, x in want.items())  # the SQL's own last bit
    assert {r.k: r.c for r in sequence.quantiles(df, ["k"], "v", {"c": 0.03}).collect()} == want
    kept = {g: n for g, (n, v) in groups.items() if v >= want[g]}
    assert {r["k"]: r["count"] for r in clouds.density_cut(df, "v", ["k"]).groupBy("k").count().collect()} == kept


def test_rounding_of_halves_is_that_of_the_sql(spark):
    pairs = [(k, n) for n in (128, 640, 1280, 3840) for k in range(1, n + 1)]
    df = spark.createDataFrame(pairs, "k long, n long").selectExpr("k", "n", "k / n AS x")
    want = duckdb.connect().execute("SELECT round(x, 6) FROM (SELECT unnest(?) AS x)", [[k / n for k, n in pairs]]).fetchall()
    assert {(r.k, r.n): r.x for r in rounded(df).collect()} == {p: w[0] for p, w in zip(pairs, want, strict=True)}
    assert rounded(spark.sql("SELECT double('NaN') AS a, double('Infinity') AS b, -0.0000005D AS c, cast(NULL AS double) AS d, 7 AS e")).collect()[0][1:] == (float("inf"), -1e-06, None, 7)


def test_tape_score_is_pixels_times_elongation():
    px = np.zeros((120, 160, 3), np.uint8)
    k = 758  # both bars are 30 wide: their scores differ in the last bit only
    for y, h, w in ((60, 6 + k % 5, 20 + k % 17), (90, 5 + k * 3 % 7, 25 + k * 7 % 31)):
        px[y : y + h, 5 : 5 + w] = (0, 220, 255)
    a, b = calibration.tape_endpoints(px)
    assert (a[1] + b[1]) / 2 == 64.0
