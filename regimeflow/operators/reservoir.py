"""Echo state networks: random sparse reservoirs, training of the readout, search over settings, closed-loop forecasts.

A unit of work is a series (run) with a setting: the reservoir's recurrence is sequential within it. The units are
spread over tasks, so a long series costs one task per setting, not one for all settings.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Reservoir(NamedTuple):
    w_in: np.ndarray  # (units, dim + 1), one entry a row
    w: np.ndarray  # (units, units), spectral radius 1
    bias_in: float
    bias_out: float


def make_reservoir(units: int, dim: int, seed: int, bias_in: float = 0.1, bias_out: float = 1.0) -> Reservoir:
    """Random reservoir: one input a unit, some three connections a unit, spectral radius 1."""
    rng = np.random.Generator(np.random.PCG64(seed))
    w_in = np.zeros((units, dim + 1))
    w_in[np.arange(units), rng.integers(0, dim + 1, units)] = rng.uniform(-1, 1, units)
    w = rng.uniform(-1, 1, (units, units)) * (rng.random((units, units)) < 3 / (units - 1))
    radius = np.abs(np.linalg.eigvals(w)).max()
    return Reservoir(w_in, w / radius if radius > 0 else w, bias_in, bias_out)


def advance(r: Reservoir, x: np.ndarray, u: np.ndarray, scale: np.ndarray, sigma: float, rho: float) -> np.ndarray:
    """Reservoir state after an input, which is divided by `scale`."""
    return np.tanh(r.w_in @ (sigma * np.append(u / scale, r.bias_in)) + rho * (r.w @ x))


def open_loop(r: Reservoir, inputs: np.ndarray, x: np.ndarray, scale: np.ndarray, sigma: float, rho: float) -> np.ndarray:
    """States with the bias appended, one a row, after each input."""
    out = np.empty((len(inputs), len(x) + 1))
    out[:, -1] = r.bias_out
    for i, u in enumerate(inputs):
        x = advance(r, x, u, scale, sigma, rho)
        out[i, :-1] = x
    return out


def closed_loop(r: Reservoir, x: np.ndarray, w_out: np.ndarray, steps: int, scale: np.ndarray, sigma: float, rho: float) -> np.ndarray:
    """Forecast: each output is the next input; the first row is the output of the given state."""
    out = np.empty((steps, w_out.shape[1]))
    for i in range(steps):
        out[i] = np.append(x, r.bias_out) @ w_out
        x = advance(r, x, out[i], scale, sigma, rho)
    return out


def map_jacobian(r: Reservoir, x: np.ndarray, w_out: np.ndarray, scale: np.ndarray, sigma: float, rho: float) -> np.ndarray:
    """Jacobian of the closed loop's map at the new reservoir state x."""
    drive = r.w_in[:, :-1] * (sigma / scale) @ w_out[:-1].T + rho * r.w
    return (1 - x**2)[:, None] * drive


def train(r: Reservoir, series: np.ndarray, washout: int, tikhonov: Sequence[float], scale: np.ndarray, sigma: float, rho: float, split: int = 2000) -> list[np.ndarray]:
    """Readouts for each Tikhonov factor; the normal equations are summed over pieces of the series, so memory is bounded."""
    x = open_loop(r, series[:washout], np.zeros(len(r.w)), scale, sigma, rho)[-1, :-1] if washout else np.zeros(len(r.w))
    n = len(r.w) + 1
    a, b = np.zeros((n, n)), np.zeros((n, series.shape[1]))
    for lo in range(washout, len(series) - 1, split):
        hi = min(lo + split, len(series) - 1)
        states = open_loop(r, series[lo:hi], x, scale, sigma, rho)
        x = states[-1, :-1]
        a += states.T @ states
        b += states.T @ series[lo + 1 : hi + 1]
    return [np.linalg.solve(a + t * np.eye(n), b) for t in tikhonov]


def search(series: DataFrame, key: str, columns: Sequence[str], rho: Sequence[float], log_sigma: Sequence[float], tikhonov: Sequence[float], units: int = 50, realizations: int = 1, washout: int = 20, horizon: int = 10, folds: int = 4, least: int = 100, seed: int = 0, settings: DataFrame | None = None) -> DataFrame:
    """(key, realization, rho, log10_sigma_in, tikh, score, n) of every setting on the grid, for series of `least` rows or more.

    Score: mean log10 of the squared error, over the series's variance, of closed-loop forecasts of `horizon` steps from
    `folds` places of the series ("recycle" validation: the training data serve again). `series` has a row a step, in
    order of t_idx; rows with nulls or NaN are left out before. With `settings` (key, realization, rho, log10_sigma_in)
    each series has its own settings instead of the grid's."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        u = pdf.sort_values("t_idx")[list(columns)].to_numpy(dtype=float)
        if len(u) < least:
            return pd.DataFrame([], columns=names)
        scale = np.ptp(u, axis=0)
        scale[scale == 0] = 1.0
        r = make_reservoir(units, u.shape[1], seed + int(first["realization"]))
        sigma, out = 10.0 ** float(first["log10_sigma_in"]), []
        for t, w_out in zip(tikhonov, train(r, u, washout, tikhonov, scale, sigma, float(first["rho"]))):
            errors = []
            for lo in np.linspace(washout, len(u) - washout - horizon - 1, folds).astype(int):
                x = open_loop(r, u[lo : lo + washout], np.zeros(units), scale, sigma, float(first["rho"]))[-1, :-1]
                made = closed_loop(r, x, w_out, horizon, scale, sigma, float(first["rho"]))
                errors.append(np.log10(np.mean((made - u[lo + washout : lo + washout + horizon]) ** 2) / max(u.var(), 1e-12) + 1e-12))
            out.append((first[key], int(first["realization"]), float(first["rho"]), float(first["log10_sigma_in"]), float(t), float(np.mean(errors)), len(u)))
        return pd.DataFrame(out, columns=names)

    names = [key, "realization", "rho", "log10_sigma_in", "tikh", "score", "n"]
    good = series.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in columns)).select(F.col(key).cast("bigint").alias(key), "t_idx", *columns)
    if settings is None:
        grid = F.array(*(F.struct(F.lit(i).alias("realization"), F.lit(float(a)).alias("rho"), F.lit(float(b)).alias("log10_sigma_in")) for i in range(realizations) for a in rho for b in log_sigma))
        units_of_work = good.select(key, "t_idx", *columns, F.explode(grid).alias("s")).select(key, "t_idx", *columns, "s.*")
    else:
        units_of_work = good.join(settings.select(key, "realization", "rho", "log10_sigma_in"), key)
    schema = f"{key} bigint, realization int, rho double, log10_sigma_in double, tikh double, score double, n bigint"
    return units_of_work.groupBy(key, "realization", "rho", "log10_sigma_in").applyInPandas(score, schema)


def best(scores: DataFrame, key: str) -> DataFrame:
    """Setting of the least score per series and realization; of equal ones the smallest."""
    pick = F.struct("score", "rho", "log10_sigma_in", "tikh")
    return scores.groupBy(key, "realization").agg(F.min(pick).alias("b")).select(key, "realization", "b.rho", "b.log10_sigma_in", "b.tikh", "b.score")
