"""Problem 1: clusters of mutually similar vectors, by k-means with parallel oversampled seeding.

The rows are assigned to k centroids. Two rows within `radius` either share a cell or one lies so near the bisecting
plane of the two cells that it visits the other's; so comparing the home rows of a cell with each other and with its
visitors finds every pair exactly once. No pairs come out: each row keeps the number of its neighbours, the smallest of
their ids and a sum of hashes, which tell whether its neighbourhood is a group that is mutually similar and alone.

Cells shall hold some CELL_ROWS rows. There are at most LEVEL_CELLS of them, since their centroids go to every task; what
a cell then has too many of is assigned again, to centroids within the cell, by the same rule. A cell that no centroids
can cut, because its rows are all near to each other, is compared in blocks. Exact copies are one row, with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import arrow_groups, materialize, resolved_state, table
from ..operators.density import within
from .vectors import DIMS, bytes_of, hashed_vectors, matrix, matrix_of, without_copies

RADIUS = 1.5
SEED = 7
#: Rounds of seeding, each of some k rows; rounds of Lloyd's steps.
ROUNDS, LLOYD = 3, 4
#: Rows a cell shall have; centroids of a level, at most; rows of a block in a large cell; cells above so many rows are cut again.
CELL_ROWS, LEVEL_CELLS, BLOCK_ROWS, CUT_ROWS = 400, 1024, 4096, 1600
#: Centroids within one cell at most, and rows drawn in the cell for each of them.
INNER_CELLS, INNER_SAMPLE = 4096, 4
#: Centroids within cells that are broadcast at once.
INNER_AT_ONCE = 200_000
#: Numbers in a matrix of distances.
MOST_CELLS_OF_MATRIX = 2_000_000


def slices(n: int, k: int) -> Iterator[slice]:
    """Slices of n rows, whose distances to k centres fit into one matrix."""
    step = max(1, MOST_CELLS_OF_MATRIX // max(k, 1))
    return (slice(a, a + step) for a in range(0, n, step))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the squared distance to it, in single precision, which fitting can do with."""
    mid = centres.mean(0)
    c = (centres - mid).astype(np.float32)
    half, t = (c**2).sum(1) / 2, np.ascontiguousarray(c.T)
    at, d = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for s in slices(len(x), len(c)):
        y = (x[s] - mid).astype(np.float32)
        g = y @ t
        g -= half
        at[s] = g.argmax(1)
        d[s] = (y**2).sum(1) - 2 * g[np.arange(len(g)), at[s]]
    return at, np.maximum(d, 0)


def draw(points: DataFrame, centres: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Some k rows, each drawn with a chance in proportion to its squared distance from the centres, in one pass.

    A row of distance d and random number u is drawn if d / u exceeds the whole cost over k. A task knows its own part of
    the cost only, so it keeps what exceeds that part over k, some k rows; the whole cost then decides.
    """
    held = points.sparkSession.sparkContext.broadcast(centres)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, kept, ranks = 0.0, [], []
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix_of(b.column(0))
            d = nearest(x, held.value)[1] * b.column(1).to_numpy()
            cost += float(d.sum())
            rank = d / b.column(2).to_numpy()
            some = rank * k > cost
            kept.append(x[some])
            ranks.append(rank[some])
            if sum(map(len, ranks)) > 8 * k:
                r = np.concatenate(ranks)
                kept, ranks = [np.concatenate(kept)[r * k > cost]], [r[r * k > cost]]
        if cost > 0:
            r = np.concatenate(ranks)
            x = np.concatenate(kept)[r * k > cost]
            r = r[r * k > cost]
            yield pa.RecordBatch.from_arrays([pa.array([cost] + [0.0] * len(r)), pa.array(np.r_[0.0, r]), pa.concat_arrays([pa.array([b""], pa.binary()), bytes_of(x)]) if len(r) else pa.array([b""], pa.binary())], ["cost", "rank", "f"])

    u = (F.shiftrightunsigned(F.xxhash64("rep", F.lit(salt)), 11) + 1) / float((1 << 53) + 1)
    found = materialize(points.select("f", "w", u.alias("u")).mapInArrow(pick, "cost double, rank double, f binary"), "drawn")
    cost = found.agg(F.sum("cost")).first()[0] or 0.0
    rows = found.filter((F.col("rank") * k > cost) & (F.octet_length("f") > 0)).select("f").collect() if cost > 0 else []
    held.unpersist()
    return matrix([r.f for r in rows]) if rows else np.zeros((0, centres.shape[1]))


def reduced(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted candidates by the usual seeding, and a few rounds of weighted k-means over the candidates."""
    if len(candidates) <= k:
        return candidates
    rng = np.random.default_rng(seed)
    p = weight / weight.sum() if weight.sum() > 0 else None
    chosen = [int(rng.choice(len(candidates), p=p))]
    far = ((candidates - candidates[chosen[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        p = far * weight
        if p.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(candidates), p=p / p.sum())))
        far = np.minimum(far, ((candidates - candidates[chosen[-1]]) ** 2).sum(1))
    out = candidates[chosen].copy()
    for _ in range(5):
        at, _ = nearest(candidates, out)
        sums = np.zeros((len(out), out.shape[1] + 1))
        np.add.at(sums, at, np.c_[candidates * weight[:, None], weight])
        some = sums[:, -1] > 0
        out[some] = sums[some, :-1] / sums[some, -1:]
    return out


def seed_centres(points: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """k centres by parallel oversampled seeding: in each round some k rows, by their distance to the centres so far.

    `points` has rep, f, w. Some k * ROUNDS candidates come to the driver; weighted by the rows nearest to them they are
    reduced to k.
    """
    first = points.select("rep", "f").agg(F.min_by("f", F.struct(F.xxhash64("rep", F.lit(seed)), "rep"))).first()
    centres = matrix([first[0]])
    for at in range(ROUNDS if k > 1 else 0):
        found = draw(points, centres, k, seed + 1 + at)
        if not len(found):
            break
        centres = np.vstack([centres, found])
    centres = np.unique(centres, axis=0)
    if len(centres) <= k:
        return centres
    return reduced(centres, lloyd_sums(points, centres)[1], k, seed)


def lloyd_sums(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per centre: sum of its rows, and their weight. Summed in each partition first; k rows reach the driver."""
    held = points.sparkSession.sparkContext.broadcast(centres)
    k, width = centres.shape
    names = [f"s{i}" for i in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1))
        for b in batches:
            if b.num_rows:
                x, w = matrix_of(b.column(0)), b.column(1).to_numpy().astype(float)
                at, _ = nearest(x, held.value)
                order = np.argsort(at, kind="stable")
                own, start = np.unique(at[order], return_index=True)
                total[own] += np.add.reduceat(np.c_[x * w[:, None], w][order], start, axis=0)
        own = np.flatnonzero(total[:, -1])
        cols = [pa.array(own, pa.int32()), *(pa.array(c) for c in total[own].T)]
        yield pa.RecordBatch.from_arrays(cols, ["c", *names, "w"])

    schema = "c int, " + ", ".join(f"{x} double" for x in [*names, "w"])
    rows = points.select("f", "w").mapInArrow(sums, schema).groupBy("c").agg(*(F.sum(x).alias(x) for x in [*names, "w"])).collect()
    held.unpersist()
    out = np.zeros((k, width + 1))
    for r in rows:
        out[r.c] = r[1:]
    return out[:, :width], out[:, width]


def fit(points: DataFrame, k: int, seed: int = SEED, iterations: int = LLOYD) -> np.ndarray:
    """Centroids of k-means over the weighted rows of `points` (rep, f, w); fewer than k if there are fewer rows."""
    centres = seed_centres(points, k, seed)
    for _ in range(iterations if len(centres) > 1 else 0):
        total, weight = lloyd_sums(points, centres)
        moved = weight > 0
        new = centres.copy()
        new[moved] = total[moved] / weight[moved, None]
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def visits(x: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, guest): home cell of each row, and as a guest the cells of smaller numbers whose bisecting plane with
    the home is within the radius."""
    mid = centres.mean(0)
    c = centres - mid
    sq = (c**2).sum(1)
    rows, cells, guests = [], [], []
    for s in slices(len(x), len(c)):
        d = sq - 2 * ((x[s] - mid) @ c.T)
        home = d.argmin(1)
        ahead = d - d[np.arange(len(d)), home][:, None]
        # the plane's distance is the difference over twice the gap of the centres; gaps only where it may be near
        row, to = np.nonzero(ahead <= 2 * radius * (1 + 1e-9) * 2 * np.sqrt(sq.max()) + 1e-6)
        keep = to < home[row]
        row, to = row[keep], to[keep]
        gap = np.sqrt(((c[to] - c[home[row]]) ** 2).sum(1))
        near = ahead[row, to] <= 2 * gap * radius * (1 + 1e-9) + 1e-9
        rows += [np.arange(s.start, s.start + len(d)), row[near] + s.start]
        cells += [home, to[near]]
        guests += [np.zeros(len(d), bool), np.ones(int(near.sum()), bool)]
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(guests)


SPREAD = "cell bigint, guest int, rep bigint, f binary, w bigint, hs bigint"


def _spread(rows: DataFrame, centres: dict[int, np.ndarray], radius: float, level: int) -> DataFrame:
    """SPREAD: rows of `rows` (of the same columns) in the cells within theirs: the number of a cell of the first level goes
    into the upper bits, bit `level` of `guest` tells a visitor. Rows of cells without centres stay as they are."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(0).to_numpy()
            if not len(cell):
                continue
            order = np.argsort(cell, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0, True])
            x = matrix_of(b.column(3))
            for lo, hi in zip(edges, edges[1:]):
                at = order[lo:hi]
                c = held.value.get(int(cell[at[0]]))
                if c is None:
                    continue
                row, to, guest = visits(x[at], c, radius)
                take = pa.array(at[row])
                own = (cell[at[0]] << (0 if level == 0 else 20)) + to
                mask = b.column(1).to_numpy()[at[row]] | (guest.astype(np.int32) << level)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(mask, pa.int32()), *(b.column(i).take(take) for i in range(2, 6))], ["cell", "guest", "rep", "f", "w", "hs"])

    return rows.mapInArrow(run, SPREAD)


def _inner_centres(spread: DataFrame, large: dict[int, int], cell_rows: int) -> dict[int, np.ndarray]:
    """Centres within each large cell (number of its rows given), by k-means over rows drawn there: INNER_SAMPLE for a
    centre, so a group is bounded. Any centres give right results; these make the cells even."""
    wanted = {c: min(INNER_CELLS, -(-n // cell_rows)) for c, n in large.items()}
    share = spread.sparkSession.createDataFrame([(c, min(1.0, wanted[c] * INNER_SAMPLE / large[c])) for c in large], "cell bigint, share double")
    u = F.shiftrightunsigned(F.xxhash64("rep", F.lit(SEED)), 11) / float(1 << 53)
    drawn = spread.select("cell", "rep", "f").join(F.broadcast(share), "cell").filter(u < F.col("share")).select("cell", "rep", "f")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["cell"].iloc[0])
        x = np.unique(matrix(pdf["f"].to_list()), axis=0)
        return pd.DataFrame({"cell": c, "f": [r.tobytes() for r in reduced(x, np.ones(len(x)), wanted[c], SEED)]})

    out: dict[int, list] = {}
    for r in drawn.groupBy("cell").applyInPandas(run, "cell bigint, f binary").collect():  # INNER_AT_ONCE at most
        out.setdefault(r.cell, []).append(r.f)
    return {c: matrix(sorted(f)) for c, f in out.items() if len(f) > 1}


def in_cells(points: DataFrame, centres: np.ndarray, radius: float, cell_rows: int = CELL_ROWS, cut_rows: int = CUT_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """SPREAD of all rows in the final cells; and how many rows the cells have that need more than one block."""
    rows = points.select(F.lit(0).cast("bigint").alias("cell"), F.lit(0).alias("guest"), "rep", "f", "w", "hs")
    first = _spread(rows, {0: centres}, radius, 0)
    sizes = {r.cell: r["count"] for r in first.groupBy("cell").count().collect()}  # LEVEL_CELLS rows at most
    large = {c: n for c, n in sizes.items() if n > cut_rows}
    if not large:
        return first, {}
    first = materialize(first, "cells")
    done, parts, blocks, batch, held = set(large), [], {}, {}, 0
    for i, (c, n) in enumerate(sorted(large.items())):
        batch[c] = n
        held += min(INNER_CELLS, -(-n // cell_rows))
        if held < INNER_AT_ONCE and i < len(large) - 1:
            continue
        here = first.filter(F.col("cell").isin(list(batch)))
        inner = _inner_centres(here, batch, cell_rows)
        cut = _spread(here, inner, radius, 1)
        # a cell is cut only if its rows come to fewer places then than as blocks
        count = {r.cell: r["n"] for r in cut.groupBy(F.shiftright("cell", 20).alias("cell")).agg(F.count("*").alias("n")).collect()}
        good = {c for c, n in batch.items() if c in inner and count[c] <= n * max(4, -(-n // block_rows))}
        done -= good
        if good:
            parts.append(materialize(_spread(here, {c: inner[c] for c in good}, radius, 1), "inner"))
            big = parts[-1].groupBy("cell").count().filter(F.col("count") > block_rows).collect()  # no more than rows / block_rows
            blocks |= {r.cell: r["count"] for r in big}
        batch, held = {}, 0
    cut_up = [c for c in large if c not in done]
    rest = first.filter(~F.col("cell").isin(cut_up)) if cut_up else first
    rest = rest.withColumn("cell", F.shiftleft("cell", 20) + F.lit((1 << 20) - 1))
    blocks |= {(c << 20) + (1 << 20) - 1: n for c, n in sizes.items() if c in done or c not in large and n > block_rows}
    for p in parts:
        rest = rest.unionByName(p)
    return rest, {c: n for c, n in blocks.items() if n > block_rows}


def neighbourhoods(points: DataFrame, centres: np.ndarray, radius: float, cell_rows: int = CELL_ROWS, cut_rows: int = CUT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row of `points` (rep, f, w, hs): rep, w, low (smallest id within the radius), deg (rows within it, itself and
    its copies counted), hs (sum of the hashes of their ids). Exact for any centroids."""
    spark = points.sparkSession
    spread, large = in_cells(points, centres, radius, cell_rows, cut_rows, block_rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, own, guest, rep, f, w, hs in arrow_groups(batches, 3):
            x, n = matrix(f), len(rep)
            low, deg, sums = rep.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
            # weights and hashes in parts whose sums are exact in doubles
            parts = np.c_[w, hs & (1 << 26) - 1, hs >> 26].astype(float)
            for a in range(0, n, 1000):
                s = slice(a, a + 1000)
                near = within(x[s], x, radius)
                near &= (guest[s, None] & guest) == 0
                near[np.arange(near.shape[0]), np.arange(a, a + near.shape[0])] = False
                if i[0] != j[0]:
                    near &= own[s, None] != own
                at = np.flatnonzero(near.any(1))
                if len(at):
                    near = near[at]
                    got = (near.astype(float) @ parts).astype(np.int64)
                    low[at + a] = np.minimum(low[at + a], np.where(near, rep, np.iinfo(np.int64).max).min(1))
                    deg[at + a], sums[at + a] = got[:, 0], got[:, 1] + (got[:, 2] << 26)
            some = deg > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (rep, low, deg, sums)], ["rep", "low", "deg", "hs"])

    # a cell of B blocks has a group for each two of them; a row goes to the B groups of its own block
    zero = F.lit(0)
    if large:
        many = F.broadcast(spark.createDataFrame([(c, -(-n // block_rows)) for c, n in large.items()], "cell bigint, many int"))
        spread = spread.join(many, "cell", "left").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(3)), F.coalesce("many", F.lit(1))).cast("int"))
        spread = spread.withColumn("other", F.explode(F.sequence(zero, F.coalesce("many", F.lit(1)) - 1)))
    else:
        spread = spread.withColumn("own", zero).withColumn("other", zero)
    groups = spread.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "guest", "rep", "f", "w", "hs")
    near = (
        groups.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
        .mapInArrow(compare, "rep bigint, low bigint, deg bigint, hs bigint")
    )
    alone = points.select("rep", F.col("rep").alias("low"), F.col("w").alias("deg"), "hs", "w")
    return (
        alone.unionByName(near.withColumn("w", F.lit(0).cast("bigint")))
        .groupBy("rep").agg(F.max("w").alias("w"), F.min("low").alias("low"), F.sum("deg").alias("deg"), F.sum("hs").alias("hs"))
    )


def cells_for(n: int, cell_rows: int = CELL_ROWS) -> int:
    return max(1, min(LEVEL_CELLS, round(n / cell_rows)))


def _points(vectors: DataFrame) -> tuple[DataFrame, int]:
    points = materialize(without_copies(vectors), "points")
    return points, points.count()


def similar_groups(vectors: DataFrame, radius: float = RADIUS, k: int | None = None, **cells) -> DataFrame:
    """(cluster_id, vec_id) of all groups of two or more rows that are all within `radius` of each other and of no other.

    `vectors` is what hashed_vectors() gives; `k` is the number of k-means cells, by default a cell for 400 rows. The
    smallest id names the cluster. Copies of a vector are members like others. An empty table gives no rows.
    """
    points, n = _points(vectors)
    if not n:
        return vectors.select(F.col("vec_id").alias("cluster_id"), "vec_id").limit(0)
    centres = fit(points.select("rep", "f", "w"), k or cells_for(n))
    hoods = materialize(neighbourhoods(points, centres, radius, **cells), "hoods")
    # rows that name the same smallest id are one group exactly if each has all of them, and only them, as neighbours
    good = (
        hoods.groupBy("low")
        .agg(F.sum("w").alias("size"), F.min("deg").alias("d0"), F.max("deg").alias("d1"), F.min("hs").alias("h0"), F.max("hs").alias("h1"))
        .filter("size >= 2 AND d0 = size AND d1 = size AND h0 = h1").select("low")
    )
    reps = hoods.join(good, "low").select(F.col("low").alias("cluster_id"), "rep", "w")
    copied = reps.filter("w > 1").select("cluster_id", "rep")
    others = (
        vectors.join(points.filter("w > 1").select("f", "rep"), "f").filter("vec_id <> rep")
        .join(copied, "rep").select("cluster_id", "vec_id").distinct()
    )
    return reps.select("cluster_id", F.col("rep").alias("vec_id")).unionByName(others)


def describe(groups: DataFrame, snaps: DataFrame, typical: int = 3) -> DataFrame:
    """Per cluster: size, regime (the most frequent state, of equally frequent ones the smallest; null if none is given),
    spread (mean distance to the centre) and the ids of its most typical members, the nearest to the centre first."""
    x = groups.join(snaps.select("vec_id", "state", "vec").dropDuplicates(["vec_id"]), "vec_id")
    parts = [F.col("vec")[i] for i in range(DIMS)]
    centre = x.groupBy("cluster_id").agg(F.count("*").alias("size"), F.array(*(F.avg(p) for p in parts)).alias("centre"))
    dist = F.sqrt(F.aggregate(F.zip_with("vec", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    far = x.join(centre, "cluster_id").select("cluster_id", "vec_id", "size", dist.alias("dist"))
    # members that are equally far but for rounding, such as the two of a pair, come by id
    first = Window.partitionBy("cluster_id").orderBy(F.round("dist", 9), "vec_id")
    top = (
        far.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= typical)
        .groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("t"))
        .select("cluster_id", F.col("t.vec_id").alias("typical"))
    )
    votes = x.filter(F.col("state").isin(1, 2, 3, 4)).groupBy("cluster_id", "state").count()
    regime = votes.groupBy("cluster_id").agg(F.max_by("state", F.struct("count", -F.col("state"))).alias("regime"))
    spread = far.groupBy("cluster_id").agg(F.first("size").alias("size"), F.avg("dist").alias("spread"))
    return spread.join(regime, "cluster_id", "left").join(top, "cluster_id").select("cluster_id", "size", "regime", "spread", "typical")


def kmeans_cells(snaps: DataFrame, k: int | None = None, state_weight: float = 0.0, typical: int = 3) -> DataFrame:
    """The k-means clusters themselves: cell, size, spread, typical members nearest to the centroid. The state may weigh in.
    `k` is by default a cluster for 400 rows, LEVEL_CELLS at most."""
    vectors = hashed_vectors(snaps.withColumn("state", resolved_state(F.col("state"), F.lit(None).cast("string"))), state="state", state_weight=state_weight)
    points, n = _points(vectors)
    centres = fit(points.select("rep", "f", "w"), k or cells_for(n)) if n else np.zeros((1, DIMS))
    held = snaps.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column(1))
                at, _ = nearest(x, held.value)
                d = np.sqrt(((x - held.value[at]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array(d)], ["vec_id", "cell", "dist"])

    cells = vectors.mapInArrow(assign, "vec_id bigint, cell int, dist double")
    # partial sums and the few nearest rows of each task first: a cluster may hold a third of all rows
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size"), F.avg("dist").alias("spread"))
    first = Window.partitionBy("cell").orderBy("dist", "vec_id")
    top = (
        cells.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= typical)
        .groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("t"))
    )
    return sizes.join(top, "cell").select("cell", "size", "spread", F.col("t.vec_id").alias("typical"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(hashed_vectors(table(spark, sf_dir, "state_snap")))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = table(spark, sf_dir, "state_snap")
    return describe(similar_groups(hashed_vectors(snaps)), snaps)


def p1_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_clusters in plain columns: size, regime, spread and the three most typical members of each cluster."""
    typical = [F.get("typical", F.lit(i)).alias(f"typical_{i + 1}") for i in range(3)]
    return p1_clusters(spark, sf_dir).select("cluster_id", "size", "regime", F.round("spread", 6).alias("spread"), *typical)


def p1_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_cells(table(spark, sf_dir, "state_snap"), state_weight=1.0)


VALID_SQL = f"""SELECT vec_id, vec, state, density FROM state_snap WHERE vec_id IS NOT NULL AND len(vec) = {DIMS}
  AND len(list_filter(vec, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = {DIMS}"""
P1_FOUND_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CAST(vec AS DOUBLE[{DIMS}]) AS x FROM ({VALID_SQL})),
n AS (SELECT a.vec_id, list(b.vec_id ORDER BY b.vec_id) AS hood FROM v a JOIN v b ON array_distance(a.x, b.x) <= {RADIUS} GROUP BY a.vec_id),
g AS (SELECT hood FROM n GROUP BY hood HAVING count(*) = len(hood) AND len(hood) >= 2)
SELECT hood[1] AS cluster_id, vec_id FROM n JOIN g USING (hood)"""

P1_DESCRIBED_SQL = f"""
WITH m AS MATERIALIZED ({P1_FOUND_SQL}),
x AS MATERIALIZED (SELECT m.cluster_id, m.vec_id, s.state, s.vec FROM m JOIN state_snap s USING (vec_id)),
l AS (SELECT cluster_id, vec_id, unnest(vec) AS v, unnest(range(1, {DIMS + 1})) AS i FROM x),
c AS (SELECT cluster_id, i, avg(v) AS c FROM l GROUP BY ALL),
d AS (SELECT cluster_id, vec_id, sqrt(sum((v - c) * (v - c))) AS dist FROM l JOIN c USING (cluster_id, i) GROUP BY ALL),
r AS (SELECT cluster_id, vec_id, dist, row_number() OVER (PARTITION BY cluster_id ORDER BY round(dist, 9), vec_id) AS k FROM d),
g AS (SELECT cluster_id, state, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, state) AS k FROM x WHERE state BETWEEN 1 AND 4 GROUP BY cluster_id, state)
SELECT cluster_id, CAST(count(*) AS BIGINT) AS size, (SELECT state FROM g WHERE g.cluster_id = r.cluster_id AND k = 1) AS regime, round(avg(dist), 6) AS spread,
  max(CASE WHEN k = 1 THEN vec_id END) AS typical_1, max(CASE WHEN k = 2 THEN vec_id END) AS typical_2, max(CASE WHEN k = 3 THEN vec_id END) AS typical_3 FROM r GROUP BY cluster_id"""
