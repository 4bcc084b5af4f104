import pytest
from pyspark.sql import functions as F

from regimeflow.operators import episodes as ep

SCHEMA = "run_id int, t_idx bigint, state int, changed string, rn int"


def seq(spark, *runs):
    return spark.createDataFrame([(r, i, s, "x", None) for r, states in enumerate(runs) for i, s in enumerate(states)], SCHEMA).select("run_id", "t_idx", "state")


ARGS = ("run_id", ["t_idx"], "state")


@pytest.mark.parametrize(("states", "want"), [([1, 1, 2, 2, 3], {1: [2], 2: [2], 3: [1]}), ([1, 2, 1, 1], {1: [1, 2], 2: [1]}), ([None, None, 1], {None: [2], 1: [1]}), ([], {})])
def test_episodes(spark, states, want):
    got = {}
    for r in ep.episodes(seq(spark, states), *ARGS).orderBy("episode_id").collect():
        got.setdefault(r.state, []).append(r.len)
    assert got == want


def test_episode_stats(spark):
    eps = spark.createDataFrame([(1, float(v)) for v in (1, 2, 4, 9)], "state int, duration double")
    r = ep.episode_stats(eps, "state").first()
    assert (r.n_episodes, r.mean_escape_time, r.median_escape_time, r.min_escape_time, r.max_escape_time, r.total_time_in_state) == (4, 4, 3, 1, 9, 16)
    assert r.std_escape_time == pytest.approx(3.082207, abs=1e-6)


@pytest.mark.parametrize(("target", "want"), [(2, [None, None, 2, 1, None]), (3, [None, None, None, None, 1]), (9, [None] * 5)])
def test_remaining_time(spark, target, want):
    got = ep.remaining_time(seq(spark, [1, 1, 2, 2, 3]), *ARGS, target=target).orderBy("t_idx").collect()
    assert [r.remaining for r in got] == want


def test_steps_to_change_and_invariants(spark):
    df = seq(spark, [1, 1, 2, 2, 3], [4, 4, 4])
    got = ep.steps_to_change(df, *ARGS).orderBy("run_id", "t_idx").collect()
    assert [r.steps for r in got] == [2, 1, 2, 1, 0, 0, 0, 0]
    assert ep.episodes(df, *ARGS).agg(F.sum("len")).first()[0] == 8
    report = ep.regime_report(df, *ARGS).collect()
    assert sum(r.share for r in report) == pytest.approx(1)


@pytest.mark.parametrize("block", [1, 3, 7])
def test_blocks_change_nothing(spark, monkeypatch, block):
    import random

    rng = random.Random(block)
    runs = [[rng.choice([1, 1, 1, 2, None]) for _ in range(rng.randrange(1, 40))] for _ in range(6)] + [[5] * 30]
    df = seq(spark, *runs)

    def results():
        return [
            sorted(map(str, f.collect()))
            for f in (
                ep.episodes(df, *ARGS), ep.with_episode(df, *ARGS), ep.remaining_time(df, *ARGS, target=1), ep.steps_to_change(df, *ARGS),
                ep.transition_matrix(df, *ARGS), ep.horizon(df, "run_id", ["t_idx"], F.col("state"), 1.5), ep.numbered(df, "run_id", ["t_idx"]),
            )
        ]

    whole = results()
    monkeypatch.setattr(ep, "BLOCK_ROWS", block)
    assert results() == whole
    lens = {(r.run_id, r.start_idx): r.len for r in ep.episodes(df, *ARGS).collect()}
    assert lens[6, 0] == 30 and sum(lens.values()) == sum(map(len, runs))


def test_timestamps_and_missing_order(spark):
    import datetime as dt

    rows = [(1, dt.datetime(2024, 1, d), s) for d, s in ((1, 1), (2, 1), (3, 2))] + [(1, None, 1), (None, dt.datetime(2024, 1, 1), 1)]
    df = spark.createDataFrame(rows, "run_id int, ts timestamp, state int")
    got = sorted(((r.run_id, r.start_idx, r.len, r.state) for r in ep.episodes(df, "run_id", ["ts"], "state").collect()), key=str)
    assert got == [(1, 0, 3, 1), (1, 3, 1, 2), (None, 0, 1, 1)]


def test_transitions(spark):
    got = {(r.from_state, r.to_state): (r.n, r.p) for r in ep.transition_matrix(seq(spark, [1, 1, 2, 1], [2, 2]), *ARGS).collect()}
    assert got == {(1, 1): (1, 0.5), (1, 2): (1, 0.5), (2, 1): (1, 0.5), (2, 2): (1, 0.5)}


def test_horizon_and_histogram(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 1, 5.0), (1, 2, 9.0), (2, 0, None), (2, 1, 0.0)], "run_id int, t_idx bigint, e double")
    assert {r.run_id: r.horizon for r in ep.horizon(df, "run_id", ["t_idx"], F.col("e"), 1.0, 2.0).collect()} == {1: 0.5, 2: 1.0}
    eps = spark.createDataFrame([(1, float(v)) for v in (2, 2, 3, 5)] + [(2, 7.0)], "state int, duration double")
    got = {(r.state, r.bin): r.n for r in ep.episode_histogram(eps, "state").collect()}
    assert got == {(1, 0): 2, (1, 1): 1, (1, 2): 1, (2, 0): 1}


def test_order_by_dates_fractions_and_others(spark, monkeypatch):
    """Blocks of dates and of fractions (NaN last) change nothing; a null entity is one of its own; text is refused."""
    monkeypatch.setattr(ep, "BLOCK_ROWS", 2)
    rows = [(e, float(i) if i < 7 else float("nan"), i, s) for e in (1, None) for i, s in enumerate([1, 1, 1, 1, 2, 2, 1, 1])]
    df = spark.createDataFrame(rows, "run_id int, x double, i int, state int").withColumn("day", F.date_add(F.lit("2026-01-01").cast("date"), F.col("i")))
    for order in ("x", "day", "i"):
        got = ep.steps_to_change(df, "run_id", [order], "state").orderBy("run_id", "i").collect()
        assert [r.steps for r in got] == [4, 3, 2, 1, 2, 1, 0, 0] * 2
        left = ep.remaining_time(df, "run_id", [order], "state", target=1).orderBy("run_id", "i").collect()
        assert [r.remaining for r in left] == [4, 3, 2, 1, None, None, 2, 1] * 2
    with pytest.raises(ValueError, match="first order column"):
        ep.episodes(df.withColumn("i", F.col("i").cast("string")), "run_id", ["i"], "state")
