"""Number of other rows within a radius, over a grid of cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import arrow_groups, materialize

#: Width of a cell in radii: wider cells mean fewer copies of rows near an edge, and more rows to compare.
WIDTH = 6
#: Rows of a cell, visitors counted, beyond which it is split.
CROWDED = 8192
#: Crowded cells that are broadcast at most; no more than one for CROWDED rows.
FEW = 100_000
#: Rows of a block that is compared with a group's others at once.
BLOCK = 1000


def within(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Which rows of x and y are at most the radius apart: by matrix product, and by differences where that is too close to tell."""
    mid = y.mean(0)
    a, b = x - mid, y - mid
    sa, sb = (a * a).sum(1), (b * b).sum(1)
    d2 = sa[:, None] + sb - 2 * (a @ b.T)
    near = d2 <= radius * radius
    slack = 1e-12 * (radius * radius + sa.max(initial=0.0) + sb.max(initial=0.0))
    i, j = np.nonzero(np.abs(d2 - radius * radius) <= slack)
    if len(i):
        near[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum(1)) <= radius
    return near


def radius_density(df: DataFrame, key: str | Sequence[str], columns: Sequence[str], radius: float, grid_dims: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """(key, density): rows whose Euclidean distance over `columns` is at most the radius, without the row itself.

    Keys (a column or several, of whole numbers) are unique; exact copies of a row under other keys count. A row with null
    or NaN among the columns, or a null key, takes no part.

    Rows lie in cells of a grid over the first `grid_dims` columns (all, by default). A row meets the rows of its cell, and
    visits those later neighbour cells whose edge is within the radius; a row in the middle of a cell visits none. The rows
    and visitors of a crowded cell are cut into parts, and a group is made for each two of them, so no group is large. A
    group counts all its rows at once as array operations; a row and its count go on, never a pair. Cells are told apart by
    a 64-bit hash: two cells of one hash meet in vain, which costs time only.
    """
    keys = [key] if isinstance(key, str) else list(key)
    n, width = len(columns), WIDTH * radius
    dims, ks, vs = range(min(n, grid_dims or n)), [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(n)]
    rows = df.select(*(F.col(k).alias(a) for k, a in zip(keys, ks)), *(F.col(c).cast("double").alias(v) for c, v in zip(columns, vs)))
    rows = rows.filter(" AND ".join([*(f"{k} IS NOT NULL" for k in ks), *(f"{v} IS NOT NULL AND NOT isnan({v})" for v in vs)]))
    cells, own = [f"c{i}" for i in dims], [f"h{i}" for i in dims]
    near = rows.withColumns({f"h{i}": F.floor(F.col(f"v{i}") / width) for i in dims})
    for i in dims:
        c, at = F.col(f"h{i}"), F.col(f"v{i}") - F.col(f"h{i}") * width
        slack = radius * 1e-9
        sides = F.array(c, F.when(at <= radius + slack, c - 1), F.when(at >= width - radius - slack, c + 1))
        near = near.withColumn(f"c{i}", F.explode(F.array_compact(sides)))
    there, home = F.struct(*cells), F.struct(*(F.col(h).alias(c) for h, c in zip(own, cells)))
    near = near.filter(there >= home).select(F.xxhash64(*cells).alias("cell"), (there > home).alias("visit"), *ks, *vs)
    hot = near.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > crowded)
    hot = materialize(hot.select("cell", F.ceil(F.col("n") / crowded).alias("parts")), "crowded")
    if hot.count() <= FEW:
        hot = F.broadcast(hot)
    parts = F.coalesce("parts", F.lit(1)).cast("int")
    near = near.join(hot, "cell", "left").withColumn("part", F.pmod(F.xxhash64(*ks, F.lit(1)), parts).cast("int"))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    kinds = dict(df.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, part, visit, *cols in arrow_groups(batches, 3):
            x, m = np.stack(cols[len(ks) :], axis=1), np.zeros(len(part), dtype=np.int64)
            if i[0] == j[0]:
                pairs = [(~visit, ~visit | visit)]
            else:
                first = part == i[0]
                pairs = [(~visit & first, ~first), (visit & first, ~visit & ~first)]
            for a, b in pairs:
                ia, ib = np.flatnonzero(a), np.flatnonzero(b)
                # from the other side: visitors of the same part, or all rows of the other one
                back = visit[ib] if i[0] == j[0] else np.ones(len(ib), dtype=bool)
                for lo in range(0, len(ia) if len(ib) else 0, BLOCK):
                    near = within(x[ia[lo : lo + BLOCK]], x[ib], radius)
                    m[ia[lo : lo + BLOCK]] += near.sum(1)
                    m[ib[back]] += near[:, back].sum(0)
            if m.any():
                some = m > 0
                yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (*cols[: len(ks)], m)], [*ks, "m"])

    groups = near.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "visit", *ks, *vs)
    counts = groups.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(count, ", ".join([*(f"{a} {kinds[k]}" for k, a in zip(keys, ks)), "m bigint"]))
    # every row meets itself once, in its own cell and part
    return counts.groupBy(*ks).agg((F.sum("m") - 1).alias("density")).select(*(F.col(a).alias(k) for k, a in zip(keys, ks)), "density")
