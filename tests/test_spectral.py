import pytest

from regimeflow.functions.systems import coefficients, six_mode
from regimeflow.operators import spectral as sp


@pytest.mark.parametrize("b", [0.5, 0.8, 1.3])
def test_derived_terms_equal_the_model(spark, b):
    tri = sp.triads(sp.mode_table(spark), b)
    real = sp.real_modes(spark, b)
    assert tri.count() == 24
    got = {(r.j, r.k, r.l): r.v for r in sp.nonlinear_terms(tri, real, b).collect()}
    want = {}
    for row, c, f in six_mode(b=b, g=1.0).terms:
        if len(f) == 2:
            k, l = sorted(f)
            want[row + 1, k + 1, l + 1] = c
    assert set(got) == set(want) and len(got) == 10
    assert all(want[t] == pytest.approx(2 * b**3 * v) for t, v in got.items())
    oro = {(r.j, r.k): r.v for r in sp.orographic_terms(tri, real, b).collect()}
    c = coefficients(b=b, g=1.0)
    model = {(1, 3): c["gammap1"], (3, 1): -c["gamma1"], (4, 6): c["gammap2"], (6, 4): -c["gamma2"]}
    assert set(oro) == set(model) and all(model[t] == pytest.approx(b**3 * v) for t, v in oro.items())


def test_ten_modes(spark):
    tri = sp.triads(sp.mode_table(spark, sp.TEN_X), 0.5)
    real = sp.real_modes(spark, 0.5, sp.TEN_X, scaled=False)
    assert real.select("id").distinct().count() == 10
    got = {(r.j, r.k, r.l): r.v for r in sp.nonlinear_terms(tri, real, 0.5).collect()}
    small = {(r.j, r.k, r.l): r.v for r in sp.nonlinear_terms(sp.triads(sp.mode_table(spark), 0.5), sp.real_modes(spark, 0.5, scaled=False), 0.5).collect()}
    assert all(got[t] == pytest.approx(v) for t, v in small.items()) and len(got) > len(small)
