import numpy as np
import pytest

from regimeflow.llm import packing
from regimeflow.llm.packing import Plan, contents, fill_report, pack, plan_slots
from regimeflow.llm.tokens import CHUNK, count_tokens, encoder, with_tokens

SCHEMA = "doc_id bigint, n bigint, size string, container_id int"


def check(rows, sizes, capacity):
    used, parts = {}, {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.size
        parts.setdefault(r.doc_id, []).append((r.part, r.size))
    assert max(used.values()) <= capacity
    for doc, n in sizes.items():
        got = sorted(parts[doc])
        assert sum(s for _, s in got) == n and [p for p, _ in got] == list(range(1, max(1, -(-n // capacity)) + 1))
        assert all(s == capacity for _, s in got[:-1])
    assert set(parts) == set(sizes)
    return used


def plain_best_fit(sizes, capacity):
    parts = sorted((p for v in sizes for p in [capacity] * (v // capacity) + [v % capacity] if p), reverse=True)
    rooms = []
    for p in parts:
        fit = min((r for r in rooms if r >= p), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((capacity if fit is None else fit) - p)
    return len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_every_item_once_and_little_unused(spark, seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 101, 600) if seed % 2 else np.minimum(rng.geometric(0.03, 600), 400)
    sizes = {i: int(v) for i, v in enumerate(n)}
    got = pack(spark.createDataFrame([(i, v, "x", None) for i, v in sizes.items()], SCHEMA), "doc_id", "n", capacity=100)
    used = check(got.collect(), sizes, 100)
    assert len(used) <= plain_best_fit(sizes.values(), 100) * 1.01 + 1
    held = {}
    for r in got.collect():
        held.setdefault(r.container_id, []).append(r.size)
    want = {}
    for v in held.values():
        want[tuple(sorted(v))] = want.get(tuple(sorted(v)), 0) + 1
    assert {tuple(r.sizes): r.containers for r in contents(got).collect()} == want
    rep = fill_report(got, 100).first()
    assert rep.containers == len(used) and rep.tokens == sum(sizes.values())


def test_exact_combinations_are_found():
    made = plan_slots({60: 1, 40: 1, 50: 2, 70: 1, 20: 1, 10: 1, 30: 4, 1: 0}, 100)
    assert max(first + times for _, _, _, times, first in made) == 5  # 60+40, 50+50, 70+30, 30+30+30+10; 20
    p = Plan({97: 2, 1: 6}, 100)
    p.exact()
    assert p.made == [((97, 1, 1, 1), 2)]


def test_one_size_holds_all_rows_and_hard_cases(spark):
    sizes = {i: 37 for i in range(500)} | {1000: 0, 1001: 100, 1002: 1000, 1003: 1001}
    rows = [(i, v, "x", None) for i, v in sizes.items()] + [(2000, None, None, None)]
    got = pack(spark.createDataFrame(rows, SCHEMA), "doc_id", "n", capacity=100).collect()
    check(got, sizes | {2000: 0}, 100)
    assert pack(spark.createDataFrame([], SCHEMA), "doc_id", "n").count() == 0


def test_a_size_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    sizes = {i: 37 if i % 3 else 40 for i in range(500)} | {900 + i: 1000 for i in range(20)}
    got = pack(spark.createDataFrame([(i, v, "x", None) for i, v in sizes.items()], SCHEMA), "doc_id", "n", capacity=100).collect()
    used = check(got, sizes, 100)
    assert sorted(used) == list(range(len(used))) and sum(v == 100 for v in used.values()) == 200


def test_tokens_of_long_and_empty_texts(spark):
    long = "word and 12 more, " * 9000 + "x" * 70_000
    df = spark.createDataFrame([(1, "Hello there"), (2, ""), (3, None), (4, long)], "doc_id int, text string")
    got = {r.doc_id: r.n_tokens for r in with_tokens(df).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: len(encoder().encode_ordinary(long))} and len(long) > 2 * CHUNK
    assert count_tokens("a b") == 2
