import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeflow.functions import vectors as v
from regimeflow.operators import density, grids, stats

XS = stats.XS
SCHEMA = "run_id int, t_idx bigint, " + ", ".join(f"{c} double" for c in XS) + ", loaded_at string, n int"


def table(spark, x, run=1):
    return spark.createDataFrame([(run, i, *map(float, r), "x", None) for i, r in enumerate(x)], SCHEMA)


def test_cleaning(spark):
    nan = float("nan")
    rows = [(1, 0, *[1.0] * 6, "a", 1), (1, 0, *[1.0] * 6, "b", 2), (1, 1, *[1.0] * 5, nan, "a", 1), (1, 2, *[1.0] * 5, None, "a", 1), (None, 3, *[1.0] * 6, "a", 1), (1, None, *[1.0] * 6, "a", 1)]
    assert [tuple(r)[:2] for r in stats.clean_trajectory(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 0)]


def test_statistics_equal_numpy(spark):
    x = np.random.default_rng(1).normal(size=(200, 6)) @ np.diag([1, 2, 3, 4, 5, 6])
    df = table(spark, x)
    got = {r["var"]: r for r in stats.ranges(df, XS).collect()}
    for i, c in enumerate(XS):
        assert got[c]["std"] == pytest.approx(x[:, i].std()) and got[c]["rms"] == pytest.approx(np.sqrt((x[:, i] ** 2).mean())) and got[c]["n"] == 200
    z = np.array([r[:] for r in stats.standardize(df, XS).orderBy("t_idx").select(*XS).collect()])
    assert np.allclose(z, (x - x.mean(0)) / x.std(0))
    g = {(r.i, r.j): r.v for r in stats.gram(df, [F.col(c) for c in XS]).collect()}
    assert len(g) == 21 and all(val == pytest.approx(x[:, i - 1] @ x[:, j - 1]) for (i, j), val in g.items())
    scores, patterns = stats.eof(df, XS, 3)
    s = np.array([r[:] for r in scores.orderBy("t_idx").select("PC1", "PC2", "PC3").collect()])
    p = patterns.orderBy("mode").collect()
    assert np.allclose(s.mean(0), 0, atol=1e-9) and np.allclose(np.cov(s.T), np.diag([r.variance for r in p]), atol=1e-8)
    assert all(max(r[3:], key=abs) > 0 for r in p)
    one = stats.standardize(table(spark, np.ones((3, 6))), XS).collect()
    assert all(r.x_1 is None for r in one)


def test_ridge_and_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[:, 1] = 2 * x[:, 0] - 1
    df = table(spark, x)
    w = {(r.i, r.j): r.w for r in stats.ridge(df, ["x_1"], ["x_2"], [0.0]).collect()}
    assert w[1, 1] == pytest.approx(2) and w[2, 1] == pytest.approx(-1)
    pairs = stats.lead_pairs(df, ["x_1"]).orderBy("t_idx").collect()
    assert len(pairs) == 299 and pairs[0].next_x_1 == x[1, 0]
    assert stats.ridge(df.limit(0), ["x_1"], ["x_2"], [1.0]).count() == 2


def test_bins(spark):
    df = spark.createDataFrame([(float(i), float(i), i) for i in range(5)] + [(None, 1.0, 9), (float("nan"), 1.0, 9)], "a double, b double, n int")
    closed = {(r.bx, r.by): r.n for r in grids.hist2d(df, [("a", "b")], 4).collect()}
    assert closed == {(0, 0): 1, (1, 1): 1, (2, 2): 1, (3, 3): 2}
    opened = {(r.bx, r.by): (r.n, r.mean_value) for r in grids.hist2d_mean(df, [("a", "b")], "n", 4).collect()}
    assert opened == {(i, i): (1, float(i)) for i in range(4)}
    same = spark.createDataFrame([(1.0, 1.0)] * 3, "a double, b double")
    assert [tuple(r) for r in grids.hist2d(same, [("a", "b")], 4).collect()] == [("a", "b", 0, 0, 3)]
    assert grids.hist2d(df.limit(0), [("a", "b")], 4).count() == 0
    assert grids.all_pairs(["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_streamfunction(spark):
    x = np.random.default_rng(3).normal(size=(2, 6))
    got = grids.streamfunction(table(spark, x), ["t_idx"], XS, 5, 4).collect()
    for r in got:
        X, Y = r.ix * 2 * np.pi / 4, r.iy * (np.pi / 2) / 3
        want = sum(c * np.sqrt(2) * (np.cos(2 * n * Y) if m == 0 else np.cos(m * X) * np.sin(2 * n * Y)) for c, (n, m) in zip(x[r.t_idx], grids.PLOT_MODES))
        assert r.psi == pytest.approx(want, abs=1e-9)
    assert len(got) == 40


@pytest.mark.parametrize(("radius", "want"), [(5.0, [2, 2, 2]), (4.9, [1, 0, 1])])
def test_density_of_three_points(spark, radius, want):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 0.0, 0.0)], "id int, a double, b double")
    assert [r.density for r in density.radius_density(df, "id", ["a", "b"], radius).orderBy("id").collect()] == want


@pytest.mark.parametrize("crowded", [7, 4096])
def test_density_equals_brute_force(spark, crowded):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.uniform(-1, 1, (200, 4)), np.tile([[0.1, 0.2, 0.3, 0.4]], (60, 1)), rng.normal(scale=0.02, size=(80, 4))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 0.0, 0.0, 0.0), (998, float("nan"), 0.0, 0.0, 0.0)], "id int, a double, b double, c double, d double")
    got = {r.id: r.density for r in density.radius_density(df, "id", list("abcd"), 0.1, crowded=crowded).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert got == {i: int((r <= 0.1).sum() - 1) for i, r in enumerate(d)}
    assert density.radius_density(df.limit(0), "id", ["a"], 1.0).count() == 0


def test_array_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(v.dot(F.col("a"), F.col("b")), v.norm(F.col("a")), v.normalize(F.col("a")), v.roll(F.col("a"), 1), v.linspace(0, 1, 3), v.clip(F.lit(5.0), 0, 2)).collect()
    assert r[0][:] == (24.0, 5.0, [0.6, 0.8], [4.0, 3.0], [0.0, 0.5, 1.0], 2.0) and r[1][2] == [None, None]
    e = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, -1.0])], "a array<double>, b array<double>")
    assert [round(x[0], 6) for x in e.select(v.angle(F.col("a"), F.col("b"))).collect()] == [0.0, 90.0]
    assert v.state_columns(["x_1", "PC1", "run_id"]) == ["x_1", "PC1"]
