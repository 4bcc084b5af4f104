import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeflow.functions import systems as sy
from regimeflow.operators import hmm, lyapunov, reservoir, simulate

X0 = np.array([sy.START])


def test_golden_numbers():
    s = sy.six_mode()
    c = sy.coefficients()
    want = dict(a1=0.24008435097522832, a2=0.7343756618065809, beta1=0.25, beta2=0.07352941176470588, gamma1=0.04801687019504567, gamma2=0.02259617420943326, gammap1=0.060021087743807086, gammap2=0.024008435097522835, d1=0.3841349615603653, d2=-1.242789581518829, e=1.44050610585137)
    assert c == pytest.approx(want)
    assert sy.np_tendency(s, X0)[0] == pytest.approx([-0.003601363412, 0.036733909163, -0.008683808346, 0.029434472006, -0.037464883435, 0.056171874635])
    assert simulate.step(s, X0, 2e-4, "midpoint")[0] == pytest.approx([0.927795279724, 0.160581346944, -0.096997036597, -0.672752112785, -0.118191493499, 0.214516234297])
    eig = np.sort(np.linalg.eigvals(sy.np_jacobian(s, X0)[0]).real)[::-1]
    assert eig == pytest.approx([0.1436596, 0.1436596, 0.0475350, -0.1088473, -0.4130034, -0.4130034], abs=1e-6)


@pytest.mark.parametrize(("s", "trace"), [(sy.six_mode(), -0.6), (sy.lorenz63(), -(10 + 1 + 8 / 3)), (sy.lorenz96(7), -7.0)])
def test_jacobians(spark, s, trace):
    x = np.random.default_rng(1).normal(size=(5, s.dim))
    j = sy.np_jacobian(s, x)
    assert np.trace(j, axis1=1, axis2=2) == pytest.approx([trace] * 5)
    for k in range(s.dim):
        e = np.zeros(s.dim)
        e[k] = 1e-6
        assert (sy.np_tendency(s, x + e) - sy.np_tendency(s, x - e)) / 2e-6 == pytest.approx(j[:, :, k], abs=1e-6)
    cols = [F.col(f"x{i}") for i in range(s.dim)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"x{i} double" for i in range(s.dim)))
    got = np.array([r[:] for r in df.select(*(c.alias(f"d{i}") for i, c in enumerate(sy.tendency(s, cols)))).collect()])
    assert got == pytest.approx(sy.np_tendency(s, x))
    flat = [c.alias(f"j{a}_{b}") for a, row in enumerate(sy.jacobian(s, cols)) for b, c in enumerate(row)]
    assert np.array([r[:] for r in df.select(*flat).collect()]).reshape(j.shape) == pytest.approx(j)


def test_registry():
    assert sy.system("rossler").dim == 3 and sy.system("lorenz96", dim=5).dim == 5
    with pytest.raises(ValueError, match="no system"):
        sy.system("pendulum")
    with pytest.raises(ValueError, match="no scheme"):
        simulate.step(sy.lorenz63(), np.zeros((1, 3)), 0.1, "heun")


MEMBERS = "run_id int, a double, b double, c double, sigma double, red boolean, t double"


def members(spark):
    return spark.createDataFrame([(1, 1.0, 2.0, 20.0, 0.0, False, 1.0), (2, 2.0, 1.0, 15.0, 0.5, False, 1.0), (3, 2.0, 1.0, 15.0, 0.5, True, 1.0), (4, None, 1.0, 1.0, 0.1, None, 1.0), (5, float("nan"), 1.0, 1.0, 0.1, None, 1.0)], MEMBERS)


@pytest.mark.parametrize("scheme", simulate.SCHEMES)
def test_simulation_without_noise(spark, scheme):
    s = sy.lorenz63()
    got = simulate.simulate(members(spark), s, "run_id", 4, 3, 0.01, scheme=scheme, start=["a", "b", "c"]).orderBy("run_id", "t_idx").collect()
    assert len(got) == 12
    x = np.array([[1.0, 2.0, 20.0]])
    for _ in range(9):
        x = simulate.step(s, x, 0.01, scheme)
    assert got[3][3:] == pytest.approx(tuple(x[0])) and got[3].t == pytest.approx(0.09)


def test_noise_is_seeded_by_member_and_red_noise_is_correlated(spark):
    s = sy.System("still", 3, (), ())
    run = lambda df: {(r.run_id, r.t_idx): (r.x_1, r.x_2) for r in simulate.simulate(df, s, "run_id", 400, 1, 1.0, start=["a", "b", "c"], sigma="sigma", red="red", r=0.8).collect()}
    one, two = run(members(spark).repartition(1)), run(members(spark).repartition(3))
    assert one == two and one[1, 399] == (1.0, 2.0)
    steps = {k: np.diff([one[k, t][0] for t in range(400)]) for k in (2, 3)}
    corr = {k: np.corrcoef(v[1:], v[:-1])[0, 1] for k, v in steps.items()}
    assert abs(corr[2]) < 0.15 and 0.7 < corr[3] < 0.9
    assert steps[2].std() == pytest.approx(0.5, rel=0.15) and steps[3].std() == pytest.approx(0.5, rel=0.3)
    noise = simulate.Noise(1, [1], np.array([True]), 0.9, 2, compat_reset=True)
    assert noise.block(3).shape == (3, 1, 2) and noise.last is not None


def test_random_starts(spark):
    lo, hi = map(np.array, sy.START_BOX)
    x = np.array([simulate.random_start(1, k) for k in range(50)])
    assert (x >= lo).all() and (x <= hi).all() and len(np.unique(x, axis=0)) == 50


def test_red_noise_last(spark):
    w = np.random.default_rng(2).normal(size=30)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(w)] + [(2, 0, None)], "k int, i int, w double")
    y = w[0]
    for v in w[1:]:
        y = 0.5 * y + np.sqrt(0.75) * v
    got = {r.k: r.last for r in simulate.red_noise_last(df, "k", ["i"], "w", 0.5).collect()}
    assert got == pytest.approx({1: y, 2: 0.0})


def starts(spark, n=3):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, *map(float, rng.normal(size=3) + [1, 1, 20])) for i in range(n)], "run_id int, a double, b double, c double")


def test_exponents_and_covariant_vectors(spark):
    s = sy.lorenz63()
    steps = lyapunov.lyapunov_steps(starts(spark), s, "run_id", ["a", "b", "c"], 4000, 0.005, transient=500)
    rows = lyapunov.final_exponents(steps, "run_id", 3).collect()
    for r in rows:
        assert r.n == 3500 and r.le_1 + r.le_2 + r.le_3 == pytest.approx(-(11 + 8 / 3), rel=1e-3)
        assert 0.4 < r.le_1 < 1.4 and abs(r.le_2) < 0.25
    series = lyapunov.exponents(steps, "run_id", 3).filter("t_idx = 3499").collect()
    assert {r.run_id: r.le_1 for r in series} == pytest.approx({r.run_id: r.le_1 for r in rows})
    assert lyapunov.ensemble_exponents(lyapunov.final_exponents(steps, "run_id", 3), 3).first().members == 3
    short = lyapunov.lyapunov_steps(starts(spark, 1), s, "run_id", ["a", "b", "c"], 200, 0.01)
    clv = lyapunov.covariant_vectors(short, "run_id", 3, 0.01)
    got = clv.orderBy("t_idx").collect()
    assert len(got) == 160 and got[0].t_idx == 20
    q = {r.t_idx: r.q for r in short.collect()}
    for r in got:
        v = np.array(r.v).reshape(3, 3)
        assert np.linalg.norm(v, axis=1) == pytest.approx([1, 1, 1])
        assert abs(v[0] @ np.array(q[r.t_idx]).reshape(3, 3)[:, 0]) == pytest.approx(1)
    angles = lyapunov.vector_angles(clv, "run_id", 3)
    assert angles.count() == 160 * 3 and angles.filter("angle < 0 OR angle > 90 OR angle IS NULL").count() == 0
    sub = {(r.t_idx): r for r in lyapunov.subspace_angles(clv, "run_id", 3, 1, 1).collect()}
    one = {(r.t_idx, r.i, r.j): r.angle for r in angles.collect()}
    assert all(sub[t].un_neutral == pytest.approx(one[t, 1, 2], abs=1e-5) for t in sub)
    tiny = lyapunov.lyapunov_steps(starts(spark, 1), s, "run_id", ["a", "b", "c"], 5, 0.01)
    assert lyapunov.covariant_vectors(tiny, "run_id", 3, 0.01).count() == 0


def test_catalogue_exponents_settle(spark, tmp_path, monkeypatch):
    """Over 20 Lyapunov times (the queries have 100), the second half changes no exponent by more than 0.05; runs have
    starts of their own."""
    from regimeflow.plans import catalogue

    assert catalogue.LENGTH >= 100 * catalogue.LYAPUNOV_TIME and catalogue.TRANSIENT >= 10 * catalogue.LYAPUNOV_TIME
    monkeypatch.setattr(catalogue, "LENGTH", 20 * catalogue.LYAPUNOV_TIME)
    monkeypatch.setattr(catalogue, "TRANSIENT", 2 * catalogue.LYAPUNOV_TIME)
    runs = [(i, 0.2, 0.0, None, 20) for i in range(1, 5)]
    spark.createDataFrame(runs, "run_id int, g double, sigma double, noise_type string, planned_samples int").write.parquet(str(tmp_path / "run_info.parquet"))
    rows = catalogue.lyapunov_series(spark, str(tmp_path)).collect()
    full, half = ({r.run_id: np.array(r[3:]) for r in rows if r.t_idx == n - 1} for n in (1000, 500))
    assert len({tuple(v) for v in full.values()}) == 4
    assert all(np.abs(full[k] - half[k]).max() < 0.05 and abs(full[k].sum() + 0.6) < 1e-3 for k in full)


def test_covariant_series_equals_vectors_of_steps(spark):
    s, names = sy.lorenz63(), ["a", "b", "c"]
    df = starts(spark, 2).withColumn("n", F.lit(30) + F.col("run_id") * 20)
    got = lyapunov.covariant_series(df, s, "run_id", names, "n", 0.01, 100, 60).collect()
    for run, n in ((0, 30), (1, 50)):
        steps = lyapunov.lyapunov_steps(df.filter(f"run_id = {run}"), s, "run_id", names, 100 + n + 120, 0.01, transient=100)
        want = {r.t_idx - 60: r for r in lyapunov.covariant_vectors(steps, "run_id", 3, 0.01).collect()}
        mine = [r for r in got if r.run_id == run]
        assert {r.t_idx for r in mine} == set(range(n))
        for r in mine:
            assert r.v == pytest.approx(want[r.t_idx].v) and r.growth == pytest.approx(want[r.t_idx].growth)


def test_kernels_give_the_same_numbers_side_by_side_and_alone():
    """States and matrices of the fast kernels are those of tangent_step, to the last bit for states."""
    for s, dt in ((sy.six_mode(g=None), 0.1), (sy.lorenz96(5), 0.01)):
        rng = np.random.default_rng(4)
        x, p = rng.normal(size=(7, s.dim)), rng.random((7, len(s.parameters)))
        kernel, one = sy.Kernel(s), sy.number_step(s, dt)
        y, u, z, alone = x, np.tile(np.eye(s.dim), (7, 1, 1)), x.T, [tuple(map(float, v)) for v in x]
        for _ in range(30):
            y, u = lyapunov.tangent_step(s, y, u, dt, p if s.parameters else None)
            z, alone = kernel.step(z, p.T, dt), [one(*v, *map(float, q)) for v, q in zip(alone, p)]
        assert (y == z.T).all() and (y == np.array(alone)).all()
        assert kernel.propagator(x.T, p.T, dt, 30) == pytest.approx(u, rel=1e-9, abs=1e-12)


def _covariant(kept, keys, **options):
    """Vectors by (member, t_idx) of six-mode members, whose keys are also their seeds."""
    x = np.stack([simulate.random_start(3, k) for k in keys], axis=1)
    p = np.full((1, len(keys)), 0.2)
    out = {}
    for member, at, v, growth in lyapunov.covariant_blocks(sy.six_mode(g=None), np.array(keys), np.array(kept), x, p, 0.1, 50, 20, 10, 3, **options):
        out |= {(keys[m], int(t)): (*a, *g) for m, t, a, g in zip(member, at, v, growth)}
    return out


def test_covariant_blocks_depend_on_no_neighbours(monkeypatch):
    """Members give the same alone, beside others, in blocks that are kept or computed again, and each has its own length."""
    kept, keys = [300, 120, 7], [1, 2, 3]
    whole = _covariant(kept, keys, kept_units=1 << 18)
    assert set(whole) == {(k, t) for k, n in zip(keys, kept) for t in range(n)}
    monkeypatch.setattr(lyapunov, "MATRICES", 16)
    again = _covariant(kept, keys, kept_units=100)
    monkeypatch.setattr(lyapunov, "FEW", 0)
    for n, k in zip(kept, keys):
        again |= {key: v for key, v in _covariant([n], [k], kept_units=0).items() if again.pop(key) == pytest.approx(v, abs=1e-9)}
    assert set(again) == set(whole) and all(again[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)


def test_a_long_run_alone_is_quick():
    """Of a run of 3,000 samples only the states go step by step: 0.4 CPU seconds, where tangent_step's alone were 28."""
    from time import process_time

    began = process_time()
    got = _covariant([3000], [1], kept_units=1 << 18)
    assert len(got) == 3000 and process_time() - began < 6


def test_subspaces_of_a_long_run_come_whole_and_soon(spark, tmp_path):
    """All planned samples of a long run beside short ones; before, the long one's 4,500 units took some 30 seconds."""
    from time import perf_counter

    from regimeflow.plans import catalogue

    runs = [(1, 0.2, 0.0, None, 3000), (2, 0.2, 0.0, None, 5), (3, None, 0.0, None, 5), (4, 0.1, 0.0, None, None)]
    spark.createDataFrame(runs, "run_id int, g double, sigma double, noise_type string, planned_samples bigint").write.parquet(str(tmp_path / "run_info.parquet"))
    began = perf_counter()
    rows = catalogue.clv_subspaces(spark, str(tmp_path)).collect()
    assert perf_counter() - began < 15
    assert sorted((r.run_id, r.t_idx) for r in rows) == [(k, t) for k, n in ((1, 3000), (2, 5), (4, 500)) for t in range(n)]
    assert all(0 <= a <= 90 for r in rows for a in r[2:])


def test_local_exponents(spark):
    df = spark.createDataFrame([(1, *map(float, sy.START), 0.2), (2, *[0.1] * 6, None), (3, *[0.1] * 6, 0.0)], "id int, " + ", ".join(f"x_{i} double" for i in range(1, 7)) + ", g double")
    got = {r.id: r[1:] for r in lyapunov.local_exponents(df, sy.six_mode(g=None), ["id"], [f"x_{i}" for i in range(1, 7)]).collect()}
    assert set(got) == {1, 3} and all(sum(v) == pytest.approx(-0.6) and list(v) == sorted(v, reverse=True) for v in got.values())
    assert got[1][0] == pytest.approx(0.1436596, abs=1e-6)


def test_reservoir_learns_a_wave(spark):
    t = np.arange(400) * 0.2
    rows = [(1, i, float(np.sin(a)), float(np.cos(a))) for i, a in enumerate(t)] + [(2, i, 0.0, 0.0) for i in range(20)] + [(1, 1000, None, 1.0)]
    df = spark.createDataFrame(rows, "run_id int, t_idx bigint, u double, v double")
    scores = reservoir.search(df, "run_id", ["u", "v"], [0.5, 0.9], [-0.5, 0.0], [1e-8, 1e-2], realizations=2)
    assert scores.count() == 2 * 2 * 2 * 2 and {r.run_id for r in scores.select("run_id").distinct().collect()} == {1}
    best = reservoir.best(scores, "run_id").collect()
    assert len(best) == 2 and all(r.score < -4 for r in best)


def test_reservoir_jacobian():
    r = reservoir.make_reservoir(20, 2, 1)
    assert np.abs(np.linalg.eigvals(r.w)).max() == pytest.approx(1) and (np.count_nonzero(r.w_in, axis=1) == 1).all()
    rng = np.random.default_rng(2)
    x, w_out, scale = rng.normal(size=20) * 0.1, rng.normal(size=(21, 2)) * 0.1, np.array([1.0, 2.0])
    f = lambda z: reservoir.advance(r, z, np.append(z, r.bias_out) @ w_out, scale, 0.7, 0.8)
    j = reservoir.map_jacobian(r, f(x), w_out, scale, 0.7, 0.8)
    num = np.stack([(f(x + e) - f(x - e)) / 2e-6 for e in np.eye(20) * 1e-6], axis=1)
    assert j == pytest.approx(num, abs=1e-6)


def test_hidden_regimes(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], {}
    for run in range(4):
        state = 0
        for t in range(300):
            state = int(rng.integers(0, 3)) if rng.random() < 0.05 else state
            truth[run, t] = state + 1
            rows.append((run, t, float(state * 4 + rng.normal()), float(rng.normal() - state)))
    df = spark.createDataFrame(rows + [(9, 0, None, 1.0), (9, 1, float("nan"), 1.0)], "run_id int, t_idx bigint, x_1 double, x_2 double")
    model, seq, likelihood = hmm.fit(df, ["x_1", "x_2"], 3, iterations=30)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(likelihood, likelihood[1:]))
    got = {(r.run_id, r.t_idx): r.state for r in hmm.label(model, seq, 2).collect()}
    assert len(got) == 1200 and np.mean([got[k] == v for k, v in truth.items()]) > 0.97
    assert model.move.sum(1) == pytest.approx([1, 1, 1])
    with pytest.raises(ValueError):
        hmm.fit(df, ["x_1"], 0)
    assert hmm.regimes(df.limit(0), ["x_1"], 2, iterations=2).count() == 0


def test_regimes_are_fitted_until_they_settle(spark, monkeypatch):
    """The query fits all six components and stops by the tolerance, or after the operator's hundred iterations."""
    from regimeflow.plans import catalogue

    got = []
    monkeypatch.setattr(catalogue, "trajectory", lambda spark, d: None)
    monkeypatch.setattr(hmm, "regimes", lambda df, columns, n_states, **options: got.append((list(columns), options)))
    catalogue.hmm_regimes(spark, "")
    assert got == [([f"x_{i}" for i in range(1, 7)], {})]
