"""Ensembles of trajectories: stochastic and deterministic integration, many members of a partition at once.

A table has a row per member: its key, start values, settings. Time within a member is sequential; members are spread
over tasks and integrated side by side as arrays. Only every n_inner-th step leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.systems import START_BOX, System, np_tendency
from .episodes import numbered

SCHEMES = ("midpoint", "euler_maruyama", "euler", "rk4")
#: Members that are integrated side by side.
MEMBERS = 2048


def step(s: System, x: np.ndarray, dt: float, scheme: str, p: np.ndarray | None = None) -> np.ndarray:
    """States one step on, without noise."""
    f = lambda z: np_tendency(s, z, p)
    if scheme in ("euler", "euler_maruyama"):
        return x + dt * f(x)
    if scheme == "midpoint":
        return x + dt * f(x + 0.5 * dt * f(x))
    if scheme == "rk4":
        k1 = f(x)
        k2 = f(x + 0.5 * dt * k1)
        k3 = f(x + 0.5 * dt * k2)
        k4 = f(x + dt * k3)
        return x + dt * (k1 / 2 + k2 + k3 + k4 / 2) / 3
    raise ValueError(f"no scheme {scheme!r}; there are {', '.join(SCHEMES)}")


def random_start(seed: int, member: int) -> np.ndarray:
    """Start of a member, uniform in the box of random starts."""
    lo, hi = map(np.array, START_BOX)
    return lo + np.random.Generator(np.random.PCG64([seed, member, 1])).random(len(lo)) * (hi - lo)


class Noise:
    """Gaussian noise of many members, white or red (lag-1 correlation r), each from its own seeded generator."""

    def __init__(self, seed: int, members: Sequence[int], red: np.ndarray, r: float, dim: int, compat_reset: bool = False):
        self.made = [np.random.Generator(np.random.PCG64([seed, int(m)])) for m in members]
        self.red, self.r, self.dim, self.reset = red, r, dim, compat_reset
        self.last: np.ndarray | None = None

    def block(self, n: int) -> np.ndarray:
        """(n, members, dim) numbers of unit variance; red noise goes on from the block before unless it is reset."""
        w = np.stack([g.standard_normal((n, self.dim)) for g in self.made], axis=1)
        if self.red.any():
            k = np.sqrt(1 - self.r**2)
            last = None if self.reset else self.last
            for i in range(n):
                if last is not None:
                    w[i, self.red] = self.r * last[self.red] + k * w[i, self.red]
                last = w[i]
            self.last = last.copy()
        return w


def simulate(members: DataFrame, s: System, key: str, samples: int, n_inner: int, dt: float, scheme: str = "midpoint", start: Sequence[str] | None = None, sigma: str | None = None, red: str | None = None, r: float = 0.5, seed: int = 1, compat_reset: bool = False) -> DataFrame:
    """(key, t_idx, t, x_1..): `samples` states of each member, the start first, n_inner steps of dt apart.

    `start` names the columns of the start values (by default random ones in the box), `sigma` that of the noise's
    strength (none: no noise), `red` a boolean column; the system's parameters are columns of their own names.
    A member with a null or NaN among these gives no rows; of repeated keys each row is a member.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"no scheme {scheme!r}; there are {', '.join(SCHEMES)}")
    numbers = [*(start or []), *s.parameters, *([sigma] if sigma else [])]
    rows = members.select(F.col(key).cast("bigint").alias("_k"), (F.coalesce(F.col(red), F.lit(False)) if red else F.lit(False)).alias("_red"), *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(numbers)))
    rows = rows.filter(" AND ".join(["_k IS NOT NULL", *(f"_{i} IS NOT NULL AND NOT isnan(_{i})" for i in range(len(numbers)))]))
    names = [key, "t_idx", "t", *(f"x_{i + 1}" for i in range(s.dim))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, MEMBERS):
                b = big.slice(lo, MEMBERS)
                keys = b.column(0).to_numpy()
                v = np.stack([c.to_numpy() for c in b.columns[2:]], axis=1) if numbers else np.empty((len(keys), 0))
                n0 = len(start or [])
                x = v[:, :n0].copy() if start else np.stack([random_start(seed, k) for k in keys])
                p = v[:, n0 : n0 + len(s.parameters)] if s.parameters else None
                strength = v[:, -1] if sigma else None
                noise = Noise(seed, keys, b.column(1).to_numpy(zero_copy_only=False), r, s.dim, compat_reset) if sigma else None
                out = [x]
                for _ in range(samples - 1):
                    w = noise.block(n_inner) * (strength[None, :, None] * np.sqrt(dt)) if noise else None
                    for i in range(n_inner):
                        x = step(s, x, dt, scheme, p)
                        if w is not None:
                            x = x + w[i]
                    out.append(x)
                states = np.stack(out, axis=1).reshape(-1, s.dim)
                t = np.tile(np.arange(samples), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, samples)), pa.array(t), pa.array(t * dt * n_inner), *(pa.array(c) for c in states.T)], names)

    return rows.mapInArrow(run, f"{key} bigint, t_idx bigint, t double, " + ", ".join(f"{c} double" for c in names[3:]))


def euler_column(s: System, start: Sequence[Column], dt: float, steps: int) -> Column:
    """ARRAY<DOUBLE> of the state after some steps of forward Euler, inside one expression; for short recurrences."""
    def one(acc: Column, _: Column) -> Column:
        cols = [acc[i] for i in range(s.dim)]
        parts = []
        for i in range(s.dim):
            total = cols[i]
            for row, c, f in s.terms:
                if row == i:
                    term = F.lit(dt * c)
                    for k in f:
                        term = term * cols[k]
                    total = total + term
            parts.append(total)
        return F.array(*parts)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(*start), one) if steps else F.array(*start)


def red_noise_last(df: DataFrame, key: str, order: Sequence[str], white: str, r: float) -> DataFrame:
    """(key, n, last): last value of y_1 = w_1, y_i = r y_(i-1) + sqrt(1 - r^2) w_i over the rows of a key in order.

    The recurrence is a weighted sum over the rows, so it is a plain aggregate after their ranks are known; nulls and
    NaN count as 0."""
    v = F.when(F.isnan(white), F.lit(0.0)).otherwise(F.coalesce(F.col(white).cast("double"), F.lit(0.0)))
    ranked = numbered(df.select(key, *order, v.alias("_v")), key, order).select(key, F.col("_v").alias("v"), (F.col("rn") + 1).alias("i"))
    sizes = ranked.groupBy(F.col(key).alias("_e")).agg(F.count("*").alias("n"))
    ranked = ranked.join(sizes, ranked[key].eqNullSafe(sizes["_e"]))
    part = F.pow(F.lit(float(r)), F.col("n") - F.col("i")) * F.when(F.col("i") == 1, F.lit(1.0)).otherwise(F.lit(float(np.sqrt(1 - r * r)))) * F.col("v")
    return ranked.groupBy(key).agg(F.max("n").alias("n"), F.sum(part).alias("last"))
