"""Use of trained reservoirs: closed-loop forecasts with exponents, refinement of a search by Gaussian processes, noise."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lyapunov import positive_qr
from .reservoir import advance, make_reservoir, map_jacobian, open_loop, search, train

#: Ranges of the spectral radius and of log10 of the input scaling in a search.
BOUNDS = ((0.1, 1.0), (-1.0, math.log10(5.0)))
#: Signal share, length scales and noise of the Gaussian process, on settings scaled to [0, 1].
LENGTHS, NUGGET = (0.1, 0.2, 0.4, 0.8), 1e-6


def forecast(series: DataFrame, settings: DataFrame, key: str, columns: Sequence[str], steps: int, units: int = 50, washout: int = 20, dt: float = 1.0, seed: int = 0) -> DataFrame:
    """(key, realization, t_idx, pred, truth, error, log_growth): closed-loop forecasts of the last `steps` rows of each
    series by a reservoir trained on the rows before, with the setting of its row in `settings` (as best() gives).

    `error` is the distance to the truth over the root mean square of the series' norm; `log_growth` the log growth of
    as many tangent directions as there are columns, null in the first tenth, while they settle. Series too short to
    train on have no rows. The recurrence runs in one task per series and realization."""
    d = len(columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, u = pdf.iloc[0], pdf.sort_values("t_idx")
        t, u = u["t_idx"].to_numpy(), u[list(columns)].to_numpy(dtype=float)
        n = len(u) - steps
        if n < 3 * washout:
            return pd.DataFrame([], columns=names)
        scale = np.ptp(u[:n], axis=0)
        scale[scale == 0] = 1.0
        r = make_reservoir(units, d, seed + int(first["realization"]))
        sigma, rho = 10.0 ** float(first["log10_sigma_in"]), float(first["rho"])
        w_out = train(r, u[:n], washout, [float(first["tikh"])], scale, sigma, rho)[0]
        x = open_loop(r, u[n - washout : n], np.zeros(units), scale, sigma, rho)[-1, :-1]
        q = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(units, d)))[0]
        size, rows = math.sqrt(np.mean((u**2).sum(1))) or 1.0, []
        for i in range(steps):
            y = np.append(x, r.bias_out) @ w_out
            x = advance(r, x, y, scale, sigma, rho)
            q, growth = positive_qr((map_jacobian(r, x, w_out, scale, sigma, rho) @ q)[None])
            q, growth = q[0], np.log(np.maximum(np.diag(growth[0]), 1e-300))
            rows.append((first[key], int(first["realization"]), int(t[n + i]), y.tolist(), u[n + i].tolist(), float(np.linalg.norm(y - u[n + i]) / size), growth.tolist() if i >= steps // 10 else None))
        return pd.DataFrame(rows, columns=names)

    names = [key, "realization", "t_idx", "pred", "truth", "error", "log_growth"]
    good = series.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in columns)).select(F.col(key).cast("bigint").alias(key), "t_idx", *columns)
    rows = good.join(settings.select(key, "realization", "rho", "log10_sigma_in", "tikh"), key)
    return rows.groupBy(key, "realization").applyInPandas(run, f"{key} bigint, realization int, t_idx bigint, pred array<double>, truth array<double>, error double, log_growth array<double>")


def forecast_exponents(forecasts: DataFrame, key: str, dim: int, dt: float) -> DataFrame:
    """(key, realization, n, le_1..): mean growth per unit of time of the closed loop."""
    sums = [(F.sum(F.col("log_growth")[i]) / (F.count("log_growth") * F.lit(dt))).alias(f"le_{i + 1}") for i in range(dim)]
    return forecasts.groupBy(key, "realization").agg(F.count("log_growth").alias("n"), *sums)


def _matern(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    d = np.sqrt(5) * np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)) / length
    return (1 + d + d**2 / 3) * np.exp(-d)


def gp_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(length scale, Cholesky factor, weights) of the process most likely among LENGTHS, for centred and scaled y."""
    best = None
    for length in LENGTHS:
        low = np.linalg.cholesky(_matern(x, x, length) + NUGGET * np.eye(len(x)))
        w = np.linalg.solve(low.T, np.linalg.solve(low, y))
        like = -0.5 * y @ w - np.log(np.diag(low)).sum()
        if best is None or like > best[0]:
            best = like, length, low, w
    return best[1:]


def gp_predict(model: tuple[float, np.ndarray, np.ndarray], x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length, low, w = model
    k = _matern(at, x, length)
    return k @ w, np.sqrt(np.maximum(1 - (np.linalg.solve(low, k.T) ** 2).sum(0), 1e-12))


def _grid(n: int) -> np.ndarray:
    a = np.linspace(0, 1, n)
    return np.stack(np.meshgrid(a, a, indexing="ij"), axis=-1).reshape(-1, 2)


def _scaled(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    one = pdf.groupby(["rho", "log10_sigma_in"])["score"].min().reset_index()
    lo, span = np.array([b[0] for b in BOUNDS]), np.array([b[1] - b[0] for b in BOUNDS])
    y = one["score"].to_numpy(dtype=float)
    return (one[["rho", "log10_sigma_in"]].to_numpy(dtype=float) - lo) / span, (y - y.mean()) / (y.std() or 1.0), float(y.mean()), float(y.std() or 1.0)


def propose(scores: DataFrame, key: str) -> DataFrame:
    """(key, realization, rho, log10_sigma_in): for each search the setting of largest expected improvement."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, _, _ = _scaled(pdf)
        at = _grid(41)
        mean, std = gp_predict(gp_fit(x, y), x, at)
        z = (y.min() - mean) / std
        gain = std * (z * np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z]) + np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi))
        p = at[int(gain.argmax())]
        return pd.DataFrame([(pdf[key].iloc[0], int(pdf["realization"].iloc[0]), *(float(lo + v * (hi - lo)) for v, (lo, hi) in zip(p, BOUNDS)))], columns=[key, "realization", "rho", "log10_sigma_in"])

    return scores.groupBy(key, "realization").applyInPandas(run, f"{key} bigint, realization int, rho double, log10_sigma_in double")


def surface(scores: DataFrame, key: str, n: int = 100, low: float | None = None, high: float | None = None) -> DataFrame:
    """(key, realization, rho, log10_sigma_in, mean): the process's mean on an n x n grid, clipped to [low, high] if given."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, mu, sd = _scaled(pdf)
        at = _grid(n)
        mean = gp_predict(gp_fit(x, y), x, at)[0] * sd + mu
        if low is not None or high is not None:
            mean = np.clip(mean, low, high)
        (a, b), (c, e) = BOUNDS
        return pd.DataFrame({key: pdf[key].iloc[0], "realization": pdf["realization"].iloc[0], "rho": a + at[:, 0] * (b - a), "log10_sigma_in": c + at[:, 1] * (e - c), "mean": mean})

    return scores.groupBy(key, "realization").applyInPandas(run, f"{key} bigint, realization int, rho double, log10_sigma_in double, mean double")


def refine(series: DataFrame, scores: DataFrame, key: str, columns: Sequence[str], tikhonov: Sequence[float], rounds: int = 5, **options) -> DataFrame:
    """Scores with `rounds` further settings per search, each chosen by expected improvement; a round is a job over all."""
    from ..common import materialize

    scores = materialize(scores, "scores")
    for _ in range(rounds):
        points = materialize(propose(scores, key), "points")
        more = search(series, key, columns, [], [], tikhonov, settings=points, **options)
        scores = materialize(scores.unionByName(more), "scores")
    return scores


def with_noise(df: DataFrame, columns: Sequence[str], strength: float, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Each column plus Gaussian noise of `strength` times its population deviation. The noise of a row depends on its
    keys and the seed only, not on the table's partitions."""
    stats = df.agg(*(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))

    def uniform(c: str, part: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(f"{seed}/{c}/{part}")), 11) + 1) / F.lit(float((1 << 53) + 1))

    made = {c: F.col(c) + F.lit(strength) * F.col(f"_s_{c}") * F.sqrt(-2 * F.log(uniform(c, 0))) * F.cos(F.lit(2 * math.pi) * uniform(c, 1)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).select(*(made[c].alias(c) if c in made else c for c in df.columns))


def first_exceedance(forecasts: DataFrame, key: str, threshold: float = 0.4, per_unit: float = 1.0) -> DataFrame:
    """(key, realization, horizon): steps until the error first exceeds the threshold, or all, over `per_unit`."""
    w = Window.partitionBy(key, "realization").orderBy("t_idx")
    at = forecasts.select(key, "realization", "error", (F.row_number().over(w) - 1).alias("i"))
    first = F.coalesce(F.min(F.when(F.col("error") > threshold, F.col("i"))), F.count("*"))
    return at.groupBy(key, "realization").agg((first / F.lit(float(per_unit))).alias("horizon"))
