"""Lyapunov exponents and covariant Lyapunov vectors of trajectories, and local exponents of single states."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.systems import Kernel, System, np_jacobian, np_tendency, number_step

#: Share of the steps at either end of a series that covariant vectors need to settle.
SPIN = 10


def local_exponents(df: DataFrame, s: System, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, lambda_1..): real parts of the eigenvalues of the Jacobian at each state, the largest first.

    Rows need no others, so nothing is shuffled. The system's parameters are columns; rows with a null or NaN among the
    columns have none."""
    names = [*columns, *s.parameters]
    rows = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in names)).filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in names))
    made = [f"lambda_{i + 1}" for i in range(s.dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.stack([c.to_numpy() for c in b.columns[len(keys) :]], axis=1)
                j = np_jacobian(s, v[:, : s.dim], v[:, s.dim :] if s.parameters else None)
                e = np.sort(np.linalg.eigvals(j).real, axis=1)[:, ::-1]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *(pa.array(np.ascontiguousarray(c)) for c in e.T)], [*keys, *made])

    types = dict(df.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{c} double" for c in made)]))


def positive_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """QR of stacked matrices with positive diagonals of R."""
    q, r = np.linalg.qr(a)
    sign = np.where(np.diagonal(r, axis1=-2, axis2=-1) < 0, -1.0, 1.0)
    return q * sign[..., None, :], r * sign[..., :, None]


def tangent_step(s: System, x: np.ndarray, u: np.ndarray, dt: float, p: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """One RK4 step of states and of their tangent vectors."""
    def f(z, m):
        return np_tendency(s, z, p), np_jacobian(s, z, p) @ m

    a1, b1 = f(x, u)
    a2, b2 = f(x + dt / 2 * a1, u + dt / 2 * b1)
    a3, b3 = f(x + dt / 2 * a2, u + dt / 2 * b2)
    a4, b4 = f(x + dt * a3, u + dt * b3)
    return x + dt * (a1 / 2 + a2 + a3 + a4 / 2) / 3, u + dt * (b1 / 2 + b2 + b3 + b4 / 2) / 3


def lyapunov_steps(members: DataFrame, s: System, key: str, start: Sequence[str], steps: int, dt: float, transient: int = 0, norm_time: int = 1, seed: int = 3, vectors: bool = True) -> DataFrame:
    """(key, t_idx, t, x, log_r, ftle, q, r): after every norm_time-th step beyond the transient, the state, the log
    growth of each tangent direction since the last, the same per unit of time, and the matrices (row by row).

    Members of a task run side by side; the first directions are random, seeded by the key. Members with a null or NaN
    start, or parameter, are left out. Without `vectors`, q and r are not written, so that long series stay narrow."""
    names = [*start, *s.parameters]
    rows = members.select(F.col(key).cast("bigint").alias(key), *(F.col(c).cast("double").alias(c) for c in names))
    rows = rows.filter(" AND ".join([f"{key} IS NOT NULL", *(f"{c} IS NOT NULL AND NOT isnan({c})" for c in names)]))
    d, span = s.dim, dt * norm_time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            v = np.stack([c.to_numpy() for c in b.columns[1:]], axis=1)
            x, p = v[:, :d].copy(), v[:, d:] if s.parameters else None
            u, _ = positive_qr(np.stack([np.random.Generator(np.random.PCG64([seed, int(k)])).random((d, d)) for k in keys]))
            for i in range(1, steps + 1):
                x, u = tangent_step(s, x, u, dt, p)
                if i % norm_time == 0:
                    u, r = positive_qr(u)
                    if i > transient:
                        growth = np.log(np.diagonal(r, axis1=1, axis2=2))
                        n, at = len(keys), (i - transient - 1) // norm_time
                        lists = lambda a, w: pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w, dtype=np.int32)), pa.array(np.ascontiguousarray(a).reshape(-1)))
                        columns = [pa.array(keys), pa.array(np.full(n, at)), pa.array(np.full(n, (at + 1) * span)), lists(x, d), lists(growth, d), lists(growth / span, d)]
                        if vectors:
                            columns += [lists(u, d * d), lists(r, d * d)]
                        yield pa.RecordBatch.from_arrays(columns, made)

    lists = ["x", "log_r", "ftle", *(["q", "r"] if vectors else [])]
    made = [key, "t_idx", "t", *lists]
    return rows.mapInArrow(run, f"{key} bigint, t_idx bigint, t double, " + ", ".join(f"{c} array<double>" for c in lists))


def covariant_series(members: DataFrame, s: System, key: str, start: Sequence[str], length: str, dt: float, transient: int, spin: int, norm_time: int = 1, seed: int = 3, side: int = 512, kept_units: int = 1 << 18) -> DataFrame:
    """(key, t_idx, v, growth) as covariant_vectors, for `length` (a column) norm_times of each member, between `spin`
    norm_times of spin-up and of spin-down and behind a transient of so many steps.

    `side` members run side by side, of like length, and keep their Q and R in the task, so that no step is shuffled. Only the
    states go step by step; the matrices that carry tangent vectors over a norm_time come from the states of many
    norm_times at once. Beyond `kept_units` norm_times a task keeps states, and Q at the beginnings of blocks, and computes
    the blocks' Q and R a second time on its way back."""
    names = [*start, *s.parameters]
    rows = members.select(F.col(key).cast("bigint").alias(key), F.col(length).cast("bigint").alias("_n"), *(F.col(c).cast("double").alias(c) for c in names))
    rows = rows.filter(" AND ".join([f"{key} IS NOT NULL", "_n > 0", *(f"{c} IS NOT NULL AND NOT isnan({c})" for c in names)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        t = pa.Table.from_batches(got).sort_by([("_n", "descending"), (key, "ascending")]) if got else None
        far = np.cumsum(t["_n"].to_numpy() + transient // norm_time + 2 * spin) if t else np.array([])
        lo = 0
        while lo < len(far):
            hi = max(lo + 1, min(lo + side, int(np.searchsorted(far, (far[lo - 1] if lo else 0) + STATES, "right"))))
            part = [c.to_numpy() for c in t.slice(lo, hi - lo).columns]
            lo = hi
            v = np.stack(part[2:])
            for member, at, vectors, growth in covariant_blocks(s, part[0], part[1], v[: s.dim], v[s.dim :], dt, transient // norm_time, spin, norm_time, seed, kept_units):
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(a).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(part[0][member]), pa.array(at), lists(vectors), lists(growth)], [key, "t_idx", "v", "growth"])

    return rows.mapInArrow(run, f"{key} bigint, t_idx bigint, v array<double>, growth array<double>")


#: Matrices that are made at once; states that a task keeps of members side by side (a longer member is alone); members from
#: which on arrays are faster than numbers, member by member.
MATRICES, STATES, FEW = 1024, 1 << 21, 24


def covariant_blocks(s: System, keys: np.ndarray, kept: np.ndarray, x: np.ndarray, p: np.ndarray, dt: float, transient: int, spin: int, norm_time: int, seed: int, kept_units: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the members, t_idx, vectors, growth) of members in descending order of `kept`, in blocks of norm_times, the
    last block first; x and p have a column per member."""
    d, kernel, one = s.dim, Kernel(s), number_step(s, dt)
    ends = transient + kept + 2 * spin  # the norm_times of each member
    block = max(64, 8 * MATRICES // len(keys))
    begins = range(0, int(ends.max()), block)
    there = [int((ends > lo).sum()) for lo in begins]  # members that a block has
    width = [min(block, int(ends[0]) - lo) for lo in begins]

    states = []
    for m, w in zip(there, width):
        x = x[:, :m]
        held = np.empty((w, d, m))
        if m < FEW:
            for j in range(m):
                now, rest = tuple(map(float, x[:, j])), tuple(map(float, p[:, j]))
                for i in range(w):
                    held[i, :, j] = now
                    for _ in range(norm_time):
                        now = one(*now, *rest)
                x[:, j] = now
        else:
            for i in range(w):
                held[i] = x
                for _ in range(norm_time):
                    x = kernel.step(x, p[:, :m], dt)
        states.append(held)

    def factors(b: int, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Q and R after each norm_time of a block, which begins with u."""
        m, w = there[b], width[b]
        flat, of = states[b].transpose(1, 0, 2).reshape(d, -1), np.tile(p[:, :m], w)
        carried = np.concatenate([kernel.propagator(flat[:, i : i + MATRICES], of[:, i : i + MATRICES], dt, norm_time) for i in range(0, m * w, MATRICES)]).reshape(w, m, d, d)
        q, r = np.empty((w, m, d, d)), np.empty((w, m, d, d))
        for i in range(w):
            u, r[i] = positive_qr(carried[i] @ u)
            q[i] = u
        return q, r

    u, _ = positive_qr(np.stack([np.random.Generator(np.random.PCG64([seed, int(k)])).random((d, d)) for k in keys]))
    first, made, units = [], {}, 0
    for b, lo in enumerate(begins):
        first.append(u := u[: there[b]])
        q, r = factors(b, u)
        u = q[-1].copy()
        if lo + width[b] > transient + spin and (units := units + there[b] * width[b]) <= kept_units:
            made[b] = q, r

    c = np.tile(np.eye(d), (len(keys), 1, 1))
    for b in range(len(begins) - 1, -1, -1):
        lo, m, w = begins[b], there[b], width[b]
        if lo + w <= transient + spin:
            break
        q, r = made.pop(b, None) or factors(b, first[b])
        got, size = np.empty((w, m, d, d)), np.empty((w, m, d))
        for i in range(w - 1, -1, -1):
            # a member begins at the identity at its own end
            c[:m][lo + i >= ends[:m] - 2] = np.eye(d)
            now = np.linalg.solve(r[i], c[:m])
            size[i] = np.linalg.norm(now, axis=1)
            got[i] = c[:m] = now / size[i][:, None, :]
        at = lo + np.arange(w)[:, None]
        i, member = np.nonzero((at >= transient + spin) & (at < ends[:m] - spin))
        if len(i):
            yield member, i + (lo - transient - spin), (q[i, member] @ got[i, member]).transpose(0, 2, 1).reshape(len(i), -1), -np.log(size[i, member]) / (dt * norm_time)


def exponents(steps: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, t_idx, t, le_1..): growth so far over the time so far; the row of the last step has the exponents."""
    w = Window.partitionBy(key).orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(key, "t_idx", "t", *((F.sum(F.col("log_r")[i]).over(w) / F.col("t")).alias(f"le_{i + 1}") for i in range(dim)))


def final_exponents(steps: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, n, t, le_1..) at the end of each series; the sums need no order."""
    sums = [(F.sum(F.col("log_r")[i]) / F.max("t")).alias(f"le_{i + 1}") for i in range(dim)]
    return steps.groupBy(key).agg(F.count("*").alias("n"), F.max("t").alias("t"), *sums)


def ensemble_exponents(final: DataFrame, dim: int) -> DataFrame:
    """Mean exponents over all members."""
    return final.agg(F.count("*").alias("members"), *(F.avg(f"le_{i + 1}").alias(f"le_{i + 1}") for i in range(dim)))


def covariant_vectors(steps: DataFrame, key: str, dim: int, dt: float) -> DataFrame:
    """(key, t_idx, v, growth): covariant vectors (v holds them one after the other) and their growth rates, for the
    steps between spin-up and spin-down (a tenth of the series each).

    A series is read backwards in one task, since each step needs the next; series are spread over tasks. One shorter
    than SPIN steps has no result."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx")
        n = len(pdf)
        cut = n // SPIN
        q = np.stack(pdf["q"].to_numpy()).reshape(n, dim, dim)
        r = np.stack(pdf["r"].to_numpy()).reshape(n, dim, dim)
        c, rows = np.eye(dim), []
        for i in range(n - 2, -1, -1):
            c = np.linalg.solve(r[i], c)
            size = np.linalg.norm(c, axis=0)
            c = c / size
            if cut and cut <= i <= n - cut - 1:
                rows.append((pdf[key].iloc[0], int(pdf["t_idx"].iloc[i]), (q[i] @ c).T.reshape(-1).tolist(), (-np.log(size) / dt).tolist()))
        return pd.DataFrame(rows[::-1], columns=[key, "t_idx", "v", "growth"])

    return steps.select(key, "t_idx", "q", "r").groupBy(key).applyInPandas(solve, f"{key} bigint, t_idx bigint, v array<double>, growth array<double>")


def vector_angles(vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, t_idx, i, j, angle): angle in degrees between covariant vectors i < j."""
    from ..functions.vectors import angle

    part = lambda i: F.slice("v", i * dim + 1, dim)
    pairs = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), angle(part(i), part(j)).alias("angle")) for i in range(dim) for j in range(i + 1, dim)))
    return vectors.select(key, "t_idx", F.inline(pairs))


def subspace_angles(vectors: DataFrame, key: str, dim: int, unstable: int, neutral: int) -> DataFrame:
    """(key, t_idx, un_neutral, un_stable, neutral_stable): smallest principal angles between the three subspaces."""
    cuts = [(0, unstable), (unstable, unstable + neutral), (unstable + neutral, dim)]
    if any(a >= b for a, b in cuts):
        raise ValueError("each subspace needs a vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(2).flatten().to_numpy().reshape(-1, dim, dim).transpose(0, 2, 1)
                base = [np.linalg.qr(v[:, :, x:y])[0] for x, y in cuts]
                out = []
                for x, y in ((0, 1), (0, 2), (1, 2)):
                    s = np.linalg.svd(base[x].transpose(0, 2, 1) @ base[y], compute_uv=False)
                    out.append(pa.array(np.degrees(np.arccos(np.clip(s.max(axis=1), 0, 1)))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out], [key, "t_idx", "un_neutral", "un_stable", "neutral_stable"])

    return vectors.select(key, "t_idx", "v").mapInArrow(run, f"{key} bigint, t_idx bigint, un_neutral double, un_stable double, neutral_stable double")
