import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeflow.operators import forecast as fc
from regimeflow.operators import lyapunov, reservoir
from regimeflow.functions.systems import lorenz63
from regimeflow.sources import results

SCHEMA = "run_id int, t_idx bigint, u double, v double"


def waves(spark, n=400):
    return spark.createDataFrame([(k, i, float(np.sin(0.2 * k * i)), float(np.cos(0.2 * k * i))) for k in (1, 2) for i in range(n)] + [(3, i, 0.0, 1.0) for i in range(30)], SCHEMA)


def test_forecast_of_waves(spark):
    df = waves(spark)
    settings = spark.createDataFrame([(k, 0, 0.8, -0.3, 1e-8) for k in (1, 2, 3)], "run_id bigint, realization int, rho double, log10_sigma_in double, tikh double")
    made = fc.forecast(df, settings, "run_id", ["u", "v"], 40, units=60)
    rows = made.orderBy("run_id", "t_idx").collect()
    assert len(rows) == 80 and {r.run_id for r in rows} == {1, 2}
    assert max(r.error for r in rows[:20]) < 0.05 and rows[0].t_idx == 360 and rows[0].log_growth is None and rows[5].log_growth is not None
    h = {r.run_id: r.horizon for r in fc.first_exceedance(made, "run_id", 0.4, 10).collect()}
    assert h[1] == 4.0
    le = fc.forecast_exponents(made, "run_id", 2, 0.2).collect()
    assert all(r.n == 36 and abs(r.le_1) < 0.5 for r in le)


def test_search_is_refined(spark):
    df = waves(spark, 200)
    scores = reservoir.search(df, "run_id", ["u", "v"], [0.3, 0.6, 0.9], [-0.9, -0.2, 0.5], [1e-6])
    more = fc.refine(df, scores, "run_id", ["u", "v"], [1e-6], rounds=2)
    assert more.count() == scores.count() + 4
    s = fc.surface(scores, "run_id", 11, low=-5.0, high=0.0)
    assert s.count() == 2 * 121 and s.filter("mean < -5 OR mean > 0").count() == 0


def test_gaussian_process_interpolates():
    rng = np.random.default_rng(1)
    x = rng.random((25, 2))
    y = np.sin(3 * x[:, 0]) + x[:, 1]
    y = (y - y.mean()) / y.std()
    mean, std = fc.gp_predict(fc.gp_fit(x, y), x, x)
    assert mean == pytest.approx(y, abs=1e-3) and (std < 0.05).all()


def test_noise_depends_on_keys_only(spark):
    df = waves(spark, 1000).filter("run_id = 1")
    a = {r.t_idx: r.u for r in fc.with_noise(df, ["u"], 0.5, ["run_id", "t_idx"]).collect()}
    # the deviation is a sum of doubles, so it may differ in the last digits
    assert a == pytest.approx({r.t_idx: r.u for r in fc.with_noise(df.repartition(7), ["u"], 0.5, ["run_id", "t_idx"]).collect()})
    z = np.array([a[i] - np.sin(0.2 * i) for i in range(1000)]) / (0.5 * df.agg(F.stddev_pop("u")).first()[0])
    assert abs(z.mean()) < 0.1 and z.std() == pytest.approx(1, abs=0.1)


def test_networks_and_vectors_are_stored(spark, tmp_path):
    r = reservoir.make_reservoir(15, 2, 3)
    w = np.random.default_rng(1).normal(size=(16, 2))
    results.save_network(spark, str(tmp_path / "net"), r, w, np.array([1.0, 2.0]), 0.9, -1.0, 1e-6)
    back, w2, scale, s = results.load_network(spark, str(tmp_path / "net"))
    assert np.array_equal(back.w, r.w) and np.array_equal(back.w_in, r.w_in) and np.array_equal(w2, w) and list(scale) == [1, 2] and s["rho"] == 0.9
    start = spark.createDataFrame([(1, 1.0, 1.0, 20.0)], "run_id int, a double, b double, c double")
    steps = lyapunov.lyapunov_steps(start, lorenz63(), "run_id", ["a", "b", "c"], 50, 0.01)
    clv = lyapunov.covariant_vectors(steps, "run_id", 3, 0.01)
    for mode, part in (("all", "vectors"), ("angles", "angles")):
        results.save_vectors(str(tmp_path / mode), steps, clv, lyapunov.vector_angles(clv, "run_id", 3), "run_id", 1, 0, mode)
        assert spark.read.parquet(str(tmp_path / mode / part)).count() > 0
    with pytest.raises(ValueError, match="no mode"):
        results.save_vectors(str(tmp_path / "x"), steps, clv, clv, "run_id", 1, 0, "some")
    assert {x.name: x.n_lyap for x in results.experiments(spark).collect()} == {"lorenz96_10": 83, "lorenz96_20": 66, "lorenz63": 222, "rossler": 1428, "six_mode": 500}
