import numpy as np
import pytest

from regimeflow.llm.kmeans import describe, kmeans_cells, similar_groups
from regimeflow.llm.knn import near_pairs, nearest_rows
from regimeflow.llm.vectors import feature_map, hashed_vectors

SCHEMA = "vec_id bigint, state int, vec array<double>, f string, rep int"


def table(spark, vectors, first=1):
    return spark.createDataFrame([(first + i, i % 5, None if v is None else [float(x) if x is not None else None for x in v], "x", None) for i, v in enumerate(vectors)], SCHEMA)


def blobs(seed, n_groups, most, lone):
    rng = np.random.default_rng(seed)
    out = [rng.normal(scale=4, size=(lone, 20))]
    for _ in range(n_groups):
        c = rng.normal(scale=4, size=20)
        out.append(c + rng.normal(scale=0.12, size=(int(rng.integers(2, most)), 20)))
    x = np.vstack(out)
    return x[rng.permutation(len(x))]


def brute(x, ids, radius=1.5, k=5):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    hoods = [frozenset(np.flatnonzero(r <= radius)) for r in d]
    groups = {(int(ids[min(h)]), int(ids[i])) for i, h in enumerate(hoods) if len(h) > 1 and all(hoods[j] == h for j in h)}
    pairs = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], ids[j]))[:k]
        pairs |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if d[i, j] <= radius}
    return groups, pairs


@pytest.mark.parametrize("block_rows", [20, 4096])
def test_groups_and_pairs_equal_brute_force(spark, block_rows):
    x = blobs(3, 25, 30, 200)
    x = np.vstack([x, x[:3] + 1.2 / np.sqrt(20), x[:3] - 1.2 / np.sqrt(20)])  # chains: similar to one, not to each other
    ids = np.arange(1, len(x) + 1)
    groups, pairs = brute(x, ids)
    vectors = hashed_vectors(table(spark, x))
    got = {tuple(r) for r in similar_groups(vectors, k=12, block_rows=block_rows).collect()}
    assert got == groups
    # cells that are cut again, into small ones
    assert {tuple(r) for r in similar_groups(vectors, k=3, cell_rows=10, cut_rows=30, block_rows=block_rows).collect()} == groups
    assert {tuple(r) for r in near_pairs(vectors, leaf_rows=64).collect()} == pairs


def test_a_third_of_all_rows_are_copies(spark):
    x = blobs(4, 5, 8, 60)
    x = np.vstack([x, np.tile(x[7], (len(x) // 2, 1)), np.tile(x[9], (3, 1))])
    ids = np.arange(1, len(x) + 1)
    groups, pairs = brute(x, ids)
    vectors = hashed_vectors(table(spark, x))
    assert {tuple(r) for r in similar_groups(vectors, k=5).collect()} == groups
    assert {tuple(r) for r in near_pairs(vectors).collect()} == pairs


def test_a_third_of_all_rows_are_one_crowded_group(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(scale=4, size=(1500, 20)), rng.normal(scale=0.05, size=(1500, 20)) + 3, rng.normal(scale=0.05, size=(4, 20)) - 3])
    x = x[rng.permutation(len(x))]
    got = {}
    for g, v in similar_groups(hashed_vectors(table(spark, x)), block_rows=400).collect():
        got.setdefault(g, set()).add(v)
    big = {i + 1 for i in range(len(x)) if abs(x[i] - 3).max() < 0.5}
    few = {i + 1 for i in range(len(x)) if abs(x[i] + 3).max() < 0.5}
    assert got == {min(big): big, min(few): few}


def test_rows_without_a_whole_vector_take_no_part(spark):
    v = [0.5] * 20
    df = table(spark, [v, None, v[:19], v[:19] + [None], v[:19] + [float("nan")], v[:19] + [float("inf")], v, [-0.0] * 20, [0.0] * 20])
    vectors = hashed_vectors(df)
    assert sorted(map(tuple, similar_groups(vectors).collect())) == [(1, 1), (1, 7), (8, 8), (8, 9)]
    assert sorted(map(tuple, near_pairs(vectors).collect())) == [(1, 7), (8, 9)]
    again = hashed_vectors(df.unionByName(df))
    assert sorted(map(tuple, similar_groups(again).collect())) == [(1, 1), (1, 7), (8, 8), (8, 9)]
    assert sorted(map(tuple, near_pairs(again).collect())) == [(1, 7), (8, 9)]
    one = hashed_vectors(df.filter("vec_id = 1").unionByName(df.filter("vec_id = 1")))
    assert similar_groups(one).count() == 0 and near_pairs(one).count() == 0
    empty = hashed_vectors(df.limit(0))
    assert similar_groups(empty).count() == 0 and near_pairs(empty).count() == 0
    assert near_pairs(hashed_vectors(df.limit(1))).count() == 0


def test_description(spark):
    x = blobs(5, 3, 12, 10)
    df = table(spark, x)
    got = describe(similar_groups(hashed_vectors(df)), df).collect()
    groups, _ = brute(x, np.arange(1, len(x) + 1))
    assert {r.cluster_id: r.size for r in got} == {g: sum(a == g for a, _ in groups) for g, _ in groups}
    for r in got:
        members = np.array([i for g, i in groups if g == r.cluster_id])
        d = np.linalg.norm(x[members - 1] - x[members - 1].mean(0), axis=1)
        assert r.typical == list(members[np.argsort(d.round(9), kind="stable")][:3])
    cells = kmeans_cells(df, 4, state_weight=2.0).collect()
    assert sum(r.size for r in cells) == len(x) and len(cells) <= 4


def test_recall_of_the_search_without_radius(spark):
    x = np.random.default_rng(6).normal(scale=3, size=(4000, 20))
    df = table(spark, x, first=20)
    got = {(r.vec_id, r.other) for r in nearest_rows(hashed_vectors(df), queries=20, leaf_rows=128).collect()}
    asked = np.arange(0, 4000, 20)
    d = ((x[asked][:, None] - x[None]) ** 2).sum(-1)
    d[np.arange(len(asked)), asked] = np.inf
    want = {(int(a + 20), int(b + 20)) for a, r in zip(asked, np.argsort(d, axis=1)[:, :5]) for b in r}
    assert len({a for a, _ in got}) == len(asked) and len(got & want) / len(want) >= 0.9


def test_leaves_that_grow_trees_and_ties(spark, monkeypatch):
    from regimeflow.llm import knn

    x = np.random.default_rng(9).integers(0, 3, size=(900, 20)).astype(float)  # many equal distances
    df = table(spark, x, first=20)
    got = {}
    for r in nearest_rows(hashed_vectors(df), queries=20, leaf_rows=10_000).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.other))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    ids = np.arange(20, 920)
    want = {int(ids[i]): [(m + 1, int(ids[j])) for m, j in enumerate(np.lexsort((ids, d[i]))[:5])] for i in range(0, 900, 20)}
    assert {a: sorted(v) for a, v in got.items()} == want
    rows = np.repeat(True, 900)
    monkeypatch.setattr(knn, "SPLIT_ROWS", 300)
    monkeypatch.setattr(knn, "LEAF_ROWS", 150)
    y = np.random.default_rng(2).normal(size=(900, 20))
    found = knn.best_in_leaf(ids, rows, rows, y.astype(np.float32), 5, None)
    pairs = {(a, b) for p in found for a, b in zip(p[0], p[1])}
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    hits = sum((int(ids[i]), int(ids[j])) in pairs for i in range(900) for j in np.argsort(d[i])[:5])
    assert 0.5 < hits / 4500 and max(len(p[0]) for p in found) < 4500
    for a, b, d2, off in found:
        assert (np.abs(d2 - d[a - 20, b - 20]) <= off + 1e-12).all()


def test_features_keep_distances():
    m = feature_map([f"vec_{i}" for i in range(20)] + ["state=1"], [1.0] * 20 + [0.0])
    x = np.random.default_rng(1).normal(size=(5, 20))
    assert np.allclose(np.linalg.norm(x @ m[:20], axis=1), np.linalg.norm(x, axis=1))
