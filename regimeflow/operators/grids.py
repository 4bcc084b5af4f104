"""Two-dimensional binning, and wave modes on grids."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modes (zonal, meridional wavenumber) of the six coefficients of a state, in the order of the plots.
PLOT_MODES = ((1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2))


def extents(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with lo_<c> and hi_<c> of every column."""
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))


def bin_of(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """0-based bin of equal width; the highest value gives n. All values equal: bin 0."""
    return F.coalesce(F.floor(F.try_divide(x - lo, hi - lo) * F.lit(n)), F.lit(0)).cast("int")


def hist2d(df: DataFrame, pairs: Sequence[tuple[str, str]], bins: int = 200) -> DataFrame:
    """(var1, var2, bx, by, n): counts of each pair of columns; the last bin is closed on the right, so every row counts.

    Rows with a null or NaN in one of the columns of a pair are not counted for it. One pass serves all pairs."""
    return _binned(df, pairs, bins, None, closed=True)


def hist2d_mean(df: DataFrame, pairs: Sequence[tuple[str, str]], value: str, bins: int = 500) -> DataFrame:
    """(var1, var2, bx, by, n, mean_value): as hist2d, with the mean of a column; the largest x and y fall outside."""
    return _binned(df, pairs, bins, value, closed=False)


def _binned(df: DataFrame, pairs, bins: int, value: str | None, closed: bool) -> DataFrame:
    names = list(dict.fromkeys(c for p in pairs for c in p))
    number = {c: F.when(~F.isnan(c), F.col(c).cast("double")) for c in names}
    keep = df.select(*(number[c].alias(c) for c in names), *([F.col(value).cast("double").alias("_value")] if value else []))
    framed = keep.crossJoin(F.broadcast(extents(keep, names)))
    at = {c: bin_of(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), bins) for c in names}
    if closed:
        at = {c: F.least(b, F.lit(bins - 1)) for c, b in at.items()}
    ok = lambda c: F.col(c).isNotNull() & (at[c] < bins)
    cells = [F.when(ok(a) & ok(b), F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), at[a].alias("bx"), at[b].alias("by"))) for a, b in pairs]
    long = framed.select(F.explode(F.array_compact(F.array(*cells))).alias("c"), *(["_value"] if value else [])).select("c.*", *(["_value"] if value else []))
    aggs = [F.count("*").alias("n")] + ([F.avg("_value").alias("mean_value")] if value else [])
    return long.groupBy("var1", "var2", "bx", "by").agg(*aggs)


def all_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def mode_value(m: Column, n: Column, x: Column, y: Column, ratio: float = 0.5) -> Column:
    """Real part of a wave mode: sqrt2 cos(n y / ratio) for m = 0, else sqrt2 cos(m x) sin(n y / ratio)."""
    root = F.sqrt(F.lit(2.0))
    return F.when(m == 0, root * F.cos(n * y / F.lit(ratio))).otherwise(root * F.cos(m * x) * F.sin(n * y / F.lit(ratio)))


def streamfunction(states: DataFrame, keys: Sequence[str], columns: Sequence[str], nx: int, ny: int, modes: Sequence[tuple[int, int]] = PLOT_MODES, x_max: float = 6.283185307179586, y_max: float = 1.5707963267948966) -> DataFrame:
    """(keys, ix, iy, psi): the field of each state on a grid, the sum of its modes weighted by its columns.

    The grid's points come from each row by explode, so rows need no shuffle."""
    x = F.col("ix") * F.lit(x_max / max(nx - 1, 1))
    y = F.col("iy") * F.lit(y_max / max(ny - 1, 1))
    psi = sum((F.col(c) * mode_value(F.lit(m), F.lit(n), x, y) for c, (n, m) in zip(columns, modes)), F.lit(0.0))
    grid = states.withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    return grid.select(*keys, "ix", "iy", psi.alias("psi"))
