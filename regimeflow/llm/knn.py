"""Problem 3: most similar vectors of every vector, by a forest of random-projection trees.

The trees' planes are fitted on a bounded sample (SAMPLE rows), all rows are indexed. Each row is looked up in all trees
through one shared priority queue: the subtree whose planes lie least on the wrong side comes next, until `visits`
leaves are found or, with a radius, no subtree within it is left. The queue runs for thousands of rows at once as array
operations. Rows meet in leaves, where each is ranked against the rows at home there; a leaf that still holds more rows
than SPLIT_ROWS, as the sample is bounded and the table isn't, grows its own tree over its rows and ranks in its leaves.

Vectors travel to their leaves in single precision. A distance found there comes with the bound of its error, so the
best k of all leaves are ranked exactly: where the order of two, or the side of the radius, isn't certain, the distance is
computed again from the vectors themselves.

Exact copies are searched once and expanded afterwards, so a vector with many copies fills no leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import arrow_groups, materialize, table
from .kmeans import RADIUS, VALID_SQL, cells_for, fit, neighbourhoods
from .vectors import DIMS, bytes_of, hashed_vectors, matrix, matrix_of, without_copies

K = 5
#: Rows of the sample for the planes, at most; trees; rows a leaf shall have; sample rows a leaf has at least.
SAMPLE, TREES, LEAF_ROWS, LEAF_SAMPLE = 200_000, 6, 512, 16
#: Rows of a leaf, visitors counted, beyond which it grows a tree of its own; leaves that a row is looked up in there.
SPLIT_ROWS, SPLIT_VISITS = 8192, 4
#: Leaves looked up for a row: in a search without a radius; trees and leaves for pairs within one.
VISITS, NEAR_TREES, NEAR_VISITS = 96, 4, 6
SEED = 11


class Forest(NamedTuple):
    """Nodes of all trees: plane (normal, offset) and children; a child below zero is the leaf -1 - child."""

    normal: np.ndarray
    offset: np.ndarray
    child: np.ndarray
    roots: np.ndarray


def grow(sample: np.ndarray, trees: int, leaf: int, seed: int = SEED) -> Forest:
    """Trees that split the sample at the median along random directions until at most `leaf` rows are left."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, roots, leaves = [], [], [], [], 0
    for _ in range(trees):
        stack: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
        root = None
        while stack:
            rows, parent, side = stack.pop()
            me = None
            if len(rows) > leaf:
                a = rng.normal(size=sample.shape[1])
                a /= np.linalg.norm(a)
                along = sample[rows] @ a
                cut = float(np.median(along))
                right = along > cut
                if right.any():
                    me = len(normals)
                    normals.append(a)
                    offsets.append(cut)
                    children.append([0, 0])
                    stack += [(rows[~right], me, 0), (rows[right], me, 1)]
            if me is None:
                leaves += 1
                me = -leaves
            if parent < 0:
                root = me
            else:
                children[parent][side] = me
        roots.append(root)
    d = sample.shape[1]
    return Forest(np.array(normals).reshape(-1, d), np.array(offsets), np.array(children, dtype=np.int64).reshape(-1, 2), np.array(roots, dtype=np.int64))


def lookup(forest: Forest, x: np.ndarray, visits: int, radius: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): leaves of each row in the order of the queue; the row's own leaf of each tree is `home`."""
    n, trees = len(x), len(forest.roots)
    node = np.tile(forest.roots, (n, 1))
    best = np.full((n, trees), np.inf)
    taken = np.zeros(n, dtype=int)
    live = np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        at = best.argmax(1)
        i = np.arange(len(live))
        p, cur = best[i, at], node[i, at]
        keep = p > -np.inf
        if radius is not None:
            keep &= p >= -radius
        keep &= taken < visits
        if not keep.all():
            live, best, node, taken, at, p, cur = (a[keep] for a in (live, best, node, taken, at, p, cur))
            i = np.arange(len(live))
            if not len(live):
                break
        leaf = cur < 0
        if leaf.any():
            out.append((live[leaf], -1 - cur[leaf], p[leaf] >= 0))
            taken[leaf] += 1
        side = np.where(leaf, 0, cur)
        if len(forest.offset):
            m = np.einsum("ij,ij->i", x[live], forest.normal[side]) - forest.offset[side]
            right = m > 0
            near, far = forest.child[side, right.astype(int)], forest.child[side, (~right).astype(int)]
            m = np.abs(m)
        else:
            near = far = np.zeros(len(live), dtype=np.int64)
            m = np.zeros(len(live))
        best[i, at] = np.where(leaf, -np.inf, np.minimum(p, m))
        node[i, at] = np.where(leaf, 0, near)
        # a plane on which a row lies counts as crossed, so that only one leaf of a tree is its home
        best = np.c_[best, np.where(leaf, -np.inf, np.minimum(p, np.minimum(-m, -1e-12)))]
        node = np.c_[node, np.where(leaf, 0, far)]
        if best.shape[1] > 4 * trees + 64:
            order = np.argsort(-best, axis=1, kind="stable")[:, : visits + trees]
            best, node = np.take_along_axis(best, order, 1), np.take_along_axis(node, order, 1)
    if not out:
        e = np.empty(0, dtype=np.int64)
        return e, e, e.astype(bool)
    rows, leaves, home = (np.concatenate(c) for c in zip(*out))
    return rows, leaves, home


def best_in_leaf(rep: np.ndarray, home: np.ndarray, asks: np.ndarray, x: np.ndarray, k: int, radius: float | None, split: bool = True) -> list[tuple[np.ndarray, ...]]:
    """(a, b, squared distance, bound of its error) of the k best home rows for each row that asks, and of what may be as
    near as the last of them. `x` is in single precision, of numbers that were double."""
    if not home.any() or not asks.any():
        return []
    if split and len(rep) > SPLIT_ROWS:
        rng = np.random.default_rng(SEED)
        drawn = np.sort(rng.choice(len(x), min(len(x), 20_000), replace=False))
        y = x.astype(float)
        inner = grow(y[drawn], 1, max(LEAF_SAMPLE, LEAF_ROWS * len(drawn) // len(x)))
        row, leaf, own = lookup(inner, y, SPLIT_VISITS, radius)
        order = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(leaf[order]) != 0, True])
        if len(edges) > 2:
            out = []
            for lo, hi in zip(edges, edges[1:]):
                at = order[lo:hi]
                out += best_in_leaf(rep[row[at]], home[row[at]] & own[at], asks[row[at]], x[row[at]], k, radius, False)
            return out
    size = np.sqrt((x.astype(float) ** 2).sum(1)) * 2.0**-23  # how far a vector may lie from what it was
    x = x.astype(float) - x.mean(0, dtype=float)
    there, xt, st = rep[home], x[home], size[home]
    sq = (xt**2).sum(1)
    out = []
    for lo in range(0, int(asks.sum()), 1000):
        a = np.flatnonzero(asks)[lo : lo + 1000]
        sa = (x[a] ** 2).sum(1)
        d = sa[:, None] + sq - 2 * (x[a] @ xt.T)
        d[rep[a][:, None] == there] = np.inf
        last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(a), np.inf)
        if radius is not None:
            last = np.minimum(last, radius * radius)
        # room for the errors of both distances that are compared, and of the arithmetic
        off = (size[a] + st.max()) + 1e-7 * size[a].max() + 1e-30
        room = 2 * (2 * np.sqrt(np.maximum(np.where(np.isfinite(last), last, 0), 0)) * off + off**2) + 1e-13 * (sa + sq.max())
        q, c = np.nonzero((d <= (last + room)[:, None]) & np.isfinite(d))
        if len(q):
            near = np.sqrt(((x[a[q]] - xt[c]) ** 2).sum(1))
            both = size[a[q]] + st[c]
            out.append((rep[a[q]], there[c], near**2, (2 * near * both + both**2 + 1e-14 * (sa[q] + sq[c])).astype(np.float32)))
    return out


def nearest_reps(points: DataFrame, n: int, k: int, visits: int, radius: float | None = None, trees: int = TREES, leaf_rows: int = LEAF_ROWS, distances: bool = True) -> DataFrame:
    """(a, b, d2): for each row of `points` (rep, f, asks) that asks, the k best others found among all rows, in their exact
    order. Without `distances`, d2 may be off in the seventh digit where that changes no order."""
    u = F.pmod(F.xxhash64("rep", F.lit(SEED)), F.lit(1 << 20))
    want = min(SAMPLE, max(4096, LEAF_SAMPLE * n // leaf_rows))
    drawn = points.filter(u < min(1.0, 1.1 * want / n) * (1 << 20)).select("rep", "f").limit(SAMPLE).collect() if n > want else []
    if not drawn:
        drawn = points.select("rep", "f").limit(SAMPLE).collect()
    sample = matrix([r.f for r in sorted(drawn, key=lambda r: r.rep)])
    mid = sample.mean(0)
    held = points.sparkSession.sparkContext.broadcast((grow(sample - mid, trees, max(LEAF_SAMPLE, round(leaf_rows * len(sample) / n))), mid))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, mid = held.value
        for big in batches:
            for lo in range(0, big.num_rows, 4000):
                b = big.slice(lo, 4000)
                x, who = matrix_of(b.column(1)) - mid, b.column(2).to_numpy(zero_copy_only=False)
                row, leaf, home = lookup(forest, x[who], visits, radius)
                row1, leaf1, home1 = lookup(forest, x[~who], trees, 0.0)  # rows that don't ask lie in their own leaves
                row, leaf, home = np.r_[np.flatnonzero(who)[row], np.flatnonzero(~who)[row1]], np.r_[leaf, leaf1], np.r_[home, home1]
                role = home * 1 + who[row] * 2
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(role, pa.int8()), b.column(0).take(pa.array(row)), bytes_of(x.astype(np.float32)[row])], ["leaf", "role", "rep", "f"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, role, rep, f in arrow_groups(batches, 1):
            x = np.frombuffer(b"".join(f), dtype=np.float32).reshape(len(f), -1)
            for found in best_in_leaf(rep, role & 1 > 0, role & 2 > 0, x, k, radius):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["a", "b", "d2", "off"])

    groups = points.select("rep", "f", "asks").mapInArrow(spread, "leaf int, role tinyint, rep bigint, f binary")
    pairs = groups.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(rank, "a bigint, b bigint, d2 double, off float")
    # a pair met in several leaves has, but for its error, the same distance there
    once = pairs.groupBy("a", "b").agg(F.min("d2").alias("d2"), F.max("off").cast("double").alias("off"))
    w = Window.partitionBy("a").orderBy("d2", "b")
    one = Window.partitionBy("a")
    once = once.withColumn("rank", F.row_number().over(w)).withColumn("far", F.max(F.when(F.col("rank") <= k, F.col("d2") + F.col("off"))).over(one))
    once = once.filter(F.col("d2") - F.col("off") <= F.col("far"))
    if distances:
        unsure = F.lit(True)
    else:
        meets = lambda o, sign: F.coalesce(F.abs(F.col("d2") - o("d2").over(w)) <= F.col("off") + o("off").over(w), F.lit(False))
        unsure = meets(F.lag, -1) | meets(F.lead, 1)
        if radius is not None:
            unsure |= F.abs(F.col("d2") - radius * radius) <= F.col("off")
    once = once.select("a", "b", "d2", unsure.alias("unsure"))
    if not distances:
        once = materialize(once, "pairs")
    again = once.filter("unsure").select("a", "b")
    left, right = points.select(F.col("rep").alias("a"), F.col("f").alias("fa")), points.select(F.col("rep").alias("b"), F.col("f").alias("fb"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = ((matrix_of(b.column(2)) - matrix_of(b.column(3))) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], ["a", "b", "d2"])

    exact = again.join(left, "a").join(right, "b").select("a", "b", "fa", "fb").mapInArrow(measure, "a bigint, b bigint, d2 double")
    found = exact if distances else exact.unionByName(once.filter("NOT unsure").select("a", "b", "d2"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")


def nearest_rows(vectors: DataFrame, k: int = K, visits: int = VISITS, radius: float | None = None, queries: int = 1, **index) -> DataFrame:
    """(vec_id, other, d2, rank): the k most similar other rows of every row whose id is divisible by `queries`.

    `vectors` is what hashed_vectors() gives; with a radius only neighbours within it come out. Equal distances: the
    smaller id first. Copies are at distance 0: of a vector with more than k copies these are the k smallest ids.
    A table without rows, or with one, gives no rows.
    """
    asks = F.max(F.col("vec_id") % queries == 0)
    points = materialize(vectors.distinct().groupBy("f").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), asks.alias("asks")), "points")
    n = points.count()
    if not n:
        return vectors.select("vec_id", F.col("vec_id").alias("other"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank")).limit(0)
    copied = points.filter("w > 1").select("f", "rep", "w")
    # all copies by the id of the first; of each vector with copies the k + 1 smallest ids stand for all
    members = materialize(vectors.join(copied, "f").select("rep", "vec_id").distinct(), "copies")
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    near = nearest_reps(points, n, k, visits, radius, **index)
    to = near.join(few.select(F.col("rep").alias("b"), F.col("vec_id").alias("o")), "b", "left").select("a", F.coalesce("o", "b").alias("other"), "d2")
    single = to.join(members.select(F.col("rep").alias("a")).distinct(), "a", "left_anti").select(F.col("a").alias("vec_id"), "other", "d2")
    of_copies = members.join(to, members.rep == to.a).select("vec_id", "other", "d2")
    own = members.join(few.withColumnRenamed("vec_id", "other"), "rep").filter("vec_id <> other").select("vec_id", "other", F.lit(0.0).alias("d2"))
    w = Window.partitionBy("vec_id").orderBy("d2", "other")
    found = single.unionByName(of_copies).unionByName(own).filter(F.col("vec_id") % queries == 0)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def near_pairs(vectors: DataFrame, radius: float = RADIUS, k: int = K, visits: int = NEAR_VISITS, trees: int = NEAR_TREES, **index) -> DataFrame:
    """(vec_lo, vec_hi): pairs within the radius of which one is among the k most similar of the other."""
    found = nearest_rows(vectors, k, visits, radius, distances=False, trees=trees, **index).filter(F.col("d2") <= radius * radius)
    return found.select(F.least("vec_id", "other").alias("vec_lo"), F.greatest("vec_id", "other").alias("vec_hi")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(hashed_vectors(table(spark, sf_dir, "state_snap")))


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar vectors, at any distance, of every row whose id is divisible by 20, among all rows."""
    found = nearest_rows(hashed_vectors(table(spark, sf_dir, "state_snap")), queries=20)
    return found.select("vec_id", "rank", "other", F.sqrt("d2").alias("distance"))


def p3_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, density (as stored), neighbours (other rows within 1.5, exact), by the cells of the k-means operator."""
    snaps = table(spark, sf_dir, "state_snap")
    vectors = hashed_vectors(snaps)
    points = materialize(without_copies(vectors), "points")
    n = points.count()
    centres = fit(points.select("rep", "f", "w"), cells_for(n)) if n else np.zeros((1, DIMS))
    degrees = neighbourhoods(points, centres, RADIUS).select("rep", (F.col("deg") - 1).alias("neighbours"))
    by_rep = vectors.join(points.select("f", "rep"), "f").select("vec_id", "rep").join(degrees, "rep")
    return snaps.select("vec_id", "density").join(by_rep, "vec_id").select("vec_id", "density", "neighbours")


_PAIRS = f"""
WITH v AS MATERIALIZED (SELECT vec_id, density, CAST(vec AS DOUBLE[20]) AS x FROM ({VALID_SQL})),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, array_distance(a.x, b.x) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id)"""
P3_FOUND_SQL = f"""{_PAIRS},
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k FROM d WHERE dist <= {RADIUS})
SELECT DISTINCT least(a, b) AS vec_lo, greatest(a, b) AS vec_hi FROM r WHERE k <= {K}"""
P3_DENSITY_SQL = f"""{_PAIRS}
SELECT v.vec_id, v.density, CAST(count(d.b) AS BIGINT) AS neighbours FROM v LEFT JOIN d ON d.a = v.vec_id AND d.dist <= {RADIUS} GROUP BY ALL"""
