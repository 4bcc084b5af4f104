import numpy as np
import pytest

from regimeflow.llm import segments
from regimeflow.llm.segments import MAX_GAP, episodes, pelt, segment

SCHEMA = "entity bigint, pos bigint, symbol int"


def brute(pos, sym, penalty, gap):
    """Least total cost over the samples themselves, by plain dynamic programming."""
    m = len(pos)
    best = [0.0] + [float("inf")] * m
    for j in range(1, m + 1):
        for i in range(j - 1, -1, -1):
            if i < j - 1 and pos[i + 1] - pos[i] > gap:
                break
            part = sym[i:j]
            free = i == 0 or pos[i] - pos[i - 1] > gap
            cost = len(part) - np.bincount(part).max() + (0 if free else penalty)
            best[j] = min(best[j], best[i] + cost)
    return best[m]


def cost_of(rows, pos, gap, penalty):
    rows = sorted(rows)
    total = sum(n - same for _, _, n, same in rows)
    for a, b in zip(rows, rows[1:]):
        total += 0 if b[0] - a[1] > gap else penalty
    return total


@pytest.mark.parametrize("block", [3, 8, 4096])
@pytest.mark.parametrize("penalty", [0.49, 1.7, 2.5, 7.5])
def test_cost_is_the_least_for_any_block(spark, block, penalty):
    rng = np.random.default_rng(int(penalty * 10) + block)
    data, want = [], {}
    for e in range(12):
        m = int(rng.integers(1, 70))
        pos = np.cumsum(rng.choice([1, 1, 1, 2, 9], m))
        sym = np.repeat(rng.integers(1, 4, m), rng.integers(1, 6, m))[:m]
        data += [(e, int(p), int(s)) for p, s in zip(pos, sym)]
        want[e] = brute(pos, sym, penalty, MAX_GAP), pos
    got = segment(spark.createDataFrame(data, SCHEMA), penalty, block=block).collect()
    for e, (cost, pos) in want.items():
        rows = [(r.first_pos, r.last_pos, r.n, r.n_same) for r in got if r.entity == e]
        assert sum(r[2] for r in rows) == len(pos)
        assert cost_of(rows, pos, MAX_GAP, penalty) == pytest.approx(cost)


def test_long_run_over_many_blocks_is_one_segment(spark):
    rows = [(1, i, 2) for i in range(1000)] + [(1, 1000, 3)] + [(1, i, 2) for i in range(1001, 1200)]
    got = segment(spark.createDataFrame(rows, SCHEMA), 0.49, block=16).collect()
    assert sorted((r.first_pos, r.last_pos, r.n, r.symbol) for r in got) == [(0, 999, 1000, 2), (1000, 1000, 1, 3), (1001, 1199, 199, 2)]
    got = segment(spark.createDataFrame(rows, SCHEMA), 2.0, block=16).collect()
    assert [(r.first_pos, r.last_pos, r.n, r.n_same) for r in got] == [(0, 1199, 1200, 1199)]


@pytest.mark.parametrize("symbols", [2, 3, 4])
def test_alternating_events_over_many_blocks(spark, symbols, monkeypatch):
    """No run is heavy, so pieces reach over all blocks; their parts must cost no more, and as one piece no less."""
    rng = np.random.default_rng(symbols)
    data, want = [], {}
    for e in range(6):
        m = 90
        pos = np.cumsum(rng.choice([1, 1, 1, 1, 2, 9], m))
        favour = np.repeat(rng.integers(1, symbols + 1, m // 15), 15)
        sym = np.where(rng.random(m) < 0.6, favour, rng.integers(1, symbols + 1, m))
        data += [(e, int(p), int(s)) for p, s in zip(pos, sym)]
        want[e] = brute(pos, sym, 4.2, MAX_GAP), pos
    df = spark.createDataFrame(data, SCHEMA)
    for most in (64, 1):
        monkeypatch.setattr(segments, "SYMBOLS", most)
        got = segment(df, 4.2, block=10).collect()
        for e, (cost, pos) in want.items():
            rows = [(r.first_pos, r.last_pos, r.n, r.n_same) for r in got if r.entity == e]
            assert sum(r[2] for r in rows) == len(pos) and len(rows) > 1
            assert cost_of(rows, pos, MAX_GAP, 4.2) == pytest.approx(cost)


def test_nulls_repeats_clashing_columns_and_empty(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 1, "b"), (1, 1, None, "c"), (None, 2, 1, "d"), (1, None, 1, "e"), (1, 3, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", block string")
    assert [tuple(r) for r in segment(df, 0.49).collect()] == [(1, 0, 3, 2, 1, 2)]
    assert segment(df.limit(0), 0.49).count() == 0


def test_episodes_of_labels(spark):
    rows = [(7, 0, None, "R１"), (7, 1, 1, "--"), (7, 2, 99, "regime one"), (7, 3, 2, None), (7, 10, 2, "r.2"), (7, 11, None, "2.0"), (7, 12, 0, "unk")]
    df = spark.createDataFrame(rows, "run_id int, t_idx bigint, state int, label string")
    got = sorted(tuple(r)[:5] for r in episodes(df, 0.49).collect())
    assert got == [(7, 0, 2, 1, 3), (7, 3, 3, 2, 1), (7, 10, 11, 2, 2)]


def test_pelt_on_ties_keeps_all_runs():
    assert pelt(np.array([1, 2, 1, 2]), np.ones(4), 0.49) == [(0, 1), (1, 2), (2, 3), (3, 4)]
