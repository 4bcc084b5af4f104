import numpy as np

from regimeflow.llm.exponents import LAMBDAS, far_values, labelled_exponents, merged_days, rank_checks, state_percentiles

EXP = "run_id int, t_idx bigint, " + ", ".join(f"{c} double" for c in LAMBDAS) + ", q double, state string"
REG = "run_id int, t_idx bigint, state int, label string, prob double, value int"


def test_far_values_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    lam = rng.normal(size=(900, 6))
    state = rng.integers(1, 4, 900)
    lam[state == 2] *= 3
    for i, j, v in ((5, 0, 90.0), (17, 3, -80.0), (30, 5, float("nan")), (31, 5, None), (40, 2, 1e6)):
        lam[i, j] = np.nan if v is None else v
    exp = [(1, i, *(None if (i, j) == (31, 5) else float(v) for j, v in enumerate(r)), 0.5, "x") for i, r in enumerate(lam)]
    reg = [(1, i, int(s) if i % 3 else None, f"Regime {s}", None, 1) for i, s in enumerate(state) if i != 40]  # 40 has no state
    exp += exp[:20] + [(None, 3, *[1e9] * 6, 0.5, "x"), (1, None, *[1e9] * 6, 0.5, "x")]
    reg += [(1, i, 99, "--", 0.5, 2) for i in range(10)] + [(None, 1, 1, None, None, None)]
    labelled = labelled_exponents(spark.createDataFrame(exp, EXP).repartition(5), spark.createDataFrame(reg, REG))
    assert labelled.count() == 899
    stats = state_percentiles(labelled)
    got = {tuple(r) for r in far_values(labelled, stats).collect()}
    want = set()
    for s in (1, 2, 3):
        for j in range(6):
            rows = [i for i in range(900) if state[i] == s and i != 40 and not np.isnan(lam[i, j])]
            lo, med, hi = np.percentile(lam[rows, j], [5, 50, 95])
            want |= {(1, i, j + 1) for i in rows if abs(lam[i, j] - med) > 6 * (hi - lo)}
    assert got == want and {(1, 5, 1), (1, 17, 4)} <= got
    checked = rank_checks(labelled, merged_days(labelled, day=100)).collect()
    assert len(checked) == 3 * 6 * 7 and all(r.within for r in checked)
    wrong = stats.withColumn("value", stats.value + 0.5)
    assert not any(r.within for r in rank_checks(labelled, wrong).filter("q = 0.5").collect())
    assert far_values(labelled.limit(0), stats.limit(0)).count() == 0
