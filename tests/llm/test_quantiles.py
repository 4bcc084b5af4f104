import numpy as np
import pytest

from regimeflow.llm.quantiles import FAN, Sketch, merge_sketches, percentiles, sketch_columns

QS = [0.0, 0.05, 0.5, 0.95, 1.0]


def rank_errors(values, found):
    s = np.sort(values)
    for q, v in zip(QS, found):
        want = round(q * (len(s) - 1))
        yield max(np.searchsorted(s, v, "left") - want, want - (np.searchsorted(s, v, "right") - 1), 0)


@pytest.mark.parametrize("n", [1, 7, 1000, 300_000])
@pytest.mark.parametrize("kind", ["random", "sorted", "ties"])
def test_error_stays_within_the_stated_bound(n, kind):
    v = np.random.default_rng(n).normal(size=n)
    v = np.sort(v) if kind == "sorted" else np.round(v) if kind == "ties" else v
    s = Sketch(k=100)
    for part in np.array_split(v, 17):
        s.add(part)
    assert max(rank_errors(v, s.quantiles(QS))) <= s.bound()
    assert s.bound() <= max(1, n * 5 * FAN / 100)


def test_merged_parts_equal_whole_within_bound():
    v = np.random.default_rng(1).normal(size=200_000)
    whole = Sketch(k=200)
    for part in np.array_split(v, 40):
        s = Sketch(k=200)
        s.add(part)
        whole.merge(**s.row())
    assert whole.n == len(v)
    assert max(rank_errors(v, whole.quantiles(QS))) <= whole.bound() < 0.03 * len(v)


def test_distributed_percentiles_with_nulls(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(x), None if x > 1 else float("nan") if x < -2 else -float(x), "extra") for g, x in zip(rng.integers(1, 4, 30_000), rng.normal(size=30_000))]
    rows += [(None, 1.0, 1.0, "x"), (9, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "state int, a double, b double, node string").repartition(23)
    sk = merge_sketches(sketch_columns(df, "state", ["a", "b"], "no"), ["state", "no"], 23)
    got = {(r.state, r.no, r.q): r for r in percentiles(sk, ["state", "no"], QS).collect()}
    for g in (1, 2, 3):
        for no, values in ((1, [r[1] for r in rows if r[0] == g]), (2, [r[2] for r in rows if r[0] == g and r[2] is not None and r[2] == r[2]])):
            assert got[g, no, 0.5].n == len(values)
            assert max(rank_errors(np.array(values), [got[g, no, q].value for q in QS])) <= got[g, no, 0.5].rank_error * len(values) + 1
    assert got[9, 1, 0.5].value is None and got[9, 2, 0.5].n == 0


def test_empty(spark):
    df = spark.createDataFrame([], "state int, a double")
    sk = merge_sketches(sketch_columns(df, "state", ["a"], "no"), ["state", "no"], 1)
    assert percentiles(sk, ["state", "no"], QS).count() == 0
