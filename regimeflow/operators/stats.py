"""Statistics of state tables: ranges, standardisation, Gram matrices and ridge regression, principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import KEY
from .episodes import numbered

XS = [f"x_{i}" for i in range(1, 7)]


def clean_trajectory(trajectory: DataFrame, columns: Sequence[str] = XS) -> DataFrame:
    """One row (run_id, t_idx, columns) per sample; re-sent rows carry the same values and count once. Samples with a
    null or NaN component, or a null key, are left out."""
    once = trajectory.filter("run_id IS NOT NULL AND t_idx IS NOT NULL").groupBy(*KEY).agg(*(F.max(c).alias(c) for c in columns))
    return once.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in columns))


CLEAN_SQL = f"""(SELECT * FROM (SELECT run_id, t_idx, {", ".join(f"max({c}) AS {c}" for c in XS)} FROM trajectory
  WHERE run_id IS NOT NULL AND t_idx IS NOT NULL GROUP BY ALL) WHERE {" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in XS)})"""


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: n, min, max, range, mean, population deviation, root mean square; NaN counts as missing."""
    one = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns]
    long = df.select(*one).unpivot([], list(columns), "var", "v")
    return long.groupBy("var").agg(
        F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), (F.max("v") - F.min("v")).alias("range"),
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"),
    )


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column less its mean, over its population deviation; null where that is 0. One row of statistics is joined."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).select(*(scaled[c].alias(c) if c in scaled else c for c in df.columns))


def lead_pairs(df: DataFrame, columns: Sequence[str], by: str = "run_id", order: str = "t_idx") -> DataFrame:
    """Supervised pairs: each row with the columns of the next one of the same run as next_<column>; the last has none."""
    here = numbered(df, by, [order])
    after = here.select(F.col(by).alias("_e"), (F.col("rn") - 1).alias("_rn"), *(F.col(c).alias(f"next_{c}") for c in columns))
    return here.join(after, here[by].eqNullSafe(after["_e"]) & (here["rn"] == after["_rn"])).select(*df.columns, *(f"next_{c}" for c in columns))


def gram(df: DataFrame, xs: Sequence[Column], ys: Sequence[Column] | None = None) -> DataFrame:
    """(i, j, v): sums of products of columns i and j (of xs with itself, i <= j, or of xs with ys), counted from 1.

    All sums form one row of partial aggregates per partition, then the row is turned into the long form."""
    pairs = [(i, j, a * b) for i, a in enumerate(xs, 1) for j, b in enumerate(ys if ys is not None else xs, 1) if ys is not None or i <= j]
    row = df.agg(*(F.sum(p).alias(f"p{k}") for k, (_, _, p) in enumerate(pairs)))
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{k}").alias("v")) for k, (i, j, _) in enumerate(pairs)))
    return row.select(F.inline(cells))


def ridge(df: DataFrame, xs: Sequence[str], ys: Sequence[str], tikhonov: Sequence[float]) -> DataFrame:
    """(tikhonov, i, j, w): weights of the regression of each y on the xs and a constant (i = len(xs) + 1).

    The normal equations are summed in Spark; their size is that of the columns, and they are solved on the driver."""
    x = [*(F.col(c).cast("double") for c in xs), F.lit(1.0)]
    both = np.zeros((len(x), len(x) + len(ys)))
    for r in gram(df, x, x + [F.col(c).cast("double") for c in ys]).collect():  # one pass for both matrices
        both[r.i - 1, r.j - 1] = r.v or 0.0
    a, b = both[:, : len(x)], both[:, len(x) :]
    rows = []
    for t in tikhonov:
        w = np.linalg.lstsq(a + t * np.eye(len(x)), b, rcond=None)[0]
        rows += [(float(t), i + 1, j + 1, float(w[i, j])) for i in range(len(x)) for j in range(len(ys))]
    return df.sparkSession.createDataFrame(rows, "tikhonov double, i int, j int, w double")


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and the sample covariance matrix of some columns, in one pass."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*(F.avg(c) for c in columns), *(F.covar_samp(columns[i], columns[j]) for i, j in pairs)).first()
    c = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row[len(columns) :]):
        c[i, j] = c[j, i] = v or 0.0
    return np.array([v or 0.0 for v in row[: len(columns)]]), c


def eof(df: DataFrame, columns: Sequence[str], n_modes: int) -> tuple[DataFrame, DataFrame]:
    """Principal components: (scores, patterns). Scores add PC1.. of the centred columns to `df`; patterns are rows
    (mode, variance, share, loading of each column). A pattern's largest loading is positive."""
    mean, cov = covariance(df, columns)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:n_modes]
    total = float(values.sum())
    rows, made = [], {}
    for k, i in enumerate(order, 1):
        v = vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i])
        made[f"PC{k}"] = sum(((F.col(c) - F.lit(float(m))) * F.lit(float(x)) for c, m, x in zip(columns, mean, v)), F.lit(0.0))
        rows.append((k, float(values[i]), float(values[i]) / total if total else None, *map(float, v)))
    schema = "mode int, variance double, share double, " + ", ".join(f"{c} double" for c in columns)
    return df.withColumns(made), df.sparkSession.createDataFrame(rows, schema)
