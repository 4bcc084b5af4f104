"""Regimes by a hidden Markov model with Gaussian emissions of full covariance, fitted by expectation-maximisation.

Each run is a sequence of its own. An iteration is one job: the forward and backward passes of a task's runs go side
by side, and only sums (of K states: counts, means, squares, transitions) come back, one row a task. Labels are a last
job. States are numbered from 1 by their mean of the first column, so that labels don't depend on chance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import arrow_groups
from .stats import covariance


class Hmm(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    cov: np.ndarray


def _log_density(m: Hmm, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(m.mean)))
    for k, (mean, cov) in enumerate(zip(m.mean, m.cov)):
        low = np.linalg.cholesky(cov)
        z = np.linalg.solve(low, (x - mean).T)
        out[:, k] = -0.5 * (z**2).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out



def _estep(m: Hmm, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """State probabilities of each row, expected transitions, log likelihood of one sequence."""
    log_b = _log_density(m, x)
    top = log_b.max(1)
    b = np.exp(log_b - top[:, None])
    n, k = b.shape
    a, scale = np.empty((n, k)), np.empty(n)
    prev = m.start
    for t in range(n):
        prev = (prev if t == 0 else prev @ m.move) * b[t]
        scale[t] = prev.sum()
        prev = a[t] = prev / scale[t]
    post, moves, beta = np.empty((n, k)), np.zeros((k, k)), np.ones(k)
    post[-1] = a[-1]
    for t in range(n - 2, -1, -1):
        w = b[t + 1] * beta / scale[t + 1]
        moves += a[t][:, None] * m.move * w
        beta = m.move @ w
        post[t] = a[t] * beta
    return post, moves, float(np.log(scale).sum() + top.sum())


def _viterbi(m: Hmm, x: np.ndarray) -> np.ndarray:
    log_b, move = _log_density(m, x), np.log(m.move + 1e-300)
    best, back = np.log(m.start + 1e-300) + log_b[0], np.zeros(log_b.shape, dtype=np.int32)
    for t in range(1, len(x)):
        s = best[:, None] + move
        back[t] = s.argmax(0)
        best = s.max(0) + log_b[t]
    path = np.empty(len(x), dtype=np.int32)
    path[-1] = best.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t][path[t]]
    return path


def fit(df: DataFrame, columns: Sequence[str], n_states: int = 3, key: str = "run_id", order: str = "t_idx", iterations: int = 100, tolerance: float = 1e-4, centers: np.ndarray | None = None, single_sequence: bool = False) -> tuple[Hmm, DataFrame, list[float]]:
    """(model on standardised columns, rows in order, log likelihoods). Starts from `centers` (standardised), by default
    spread along the first column. With single_sequence all runs are one sequence, in order of the key."""
    if n_states < 1 or not columns:
        raise ValueError("a model needs a state and a column")
    if centers is not None and np.shape(centers) != (n_states, len(columns)):
        raise ValueError("centers need a row per state and a number per column")
    df = df.filter(" AND ".join([f"{key} IS NOT NULL", *(f"{c} IS NOT NULL AND NOT isnan({c})" for c in columns)]))
    mean, cov = covariance(df, columns)
    std = np.sqrt(np.diag(cov))
    std[std == 0] = 1.0
    scaled = [((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(c) for c, m, s in zip(columns, mean, std)]
    seq = F.lit(0).cast("bigint") if single_sequence else F.col(key).cast("bigint")
    rows = df.select(seq.alias("_seq"), F.col(order).cast("bigint").alias("_t"), *scaled, F.col(key).alias("_key"))
    # shuffled once for all iterations; a lost executor's part is made again from the source
    rows = rows.repartition("_seq").sortWithinPartitions("_seq", "_key", "_t").persist(StorageLevel.MEMORY_AND_DISK)
    d, k = len(columns), n_states
    if centers is None:
        centers = np.zeros((k, d))
        centers[:, 0] = np.linspace(-1.2, 1.2, k) if k > 1 else 0.0
    model = Hmm(np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)) * (1 - np.eye(k)) + np.eye(k) * (0.9 if k > 1 else 1.0), np.array(centers, dtype=float), np.stack([np.eye(d)] * k))
    width = k + k * k + k + k * d + k * d * d + 1
    likelihood: list[float] = []
    for _ in range(iterations):
        held = model

        def sums(batches: Iterator[pa.RecordBatch], m: Hmm = held) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for cols in arrow_groups(batches, 1):
                x = np.stack(cols[2 : 2 + d], axis=1)
                post, moves, ll = _estep(m, x)
                second = np.einsum("nk,ni,nj->kij", post, x, x, optimize=True)
                total += np.concatenate([post[0], moves.ravel(), post.sum(0), (post.T @ x).ravel(), second.ravel(), [ll]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["i", "v"])

        got = rows.mapInArrow(sums, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(width)
        for r in got:
            v[r.i] = r.v
        first, moves, n, one, two = np.split(v[:-1], np.cumsum([k, k * k, k, k * d]))
        if n.sum() == 0:
            break
        n = np.maximum(n, 1e-8)
        mu = one.reshape(k, d) / n[:, None]
        cov_k = two.reshape(k, d, d) / n[:, None, None] - mu[:, :, None] * mu[:, None, :] + 1e-3 * np.eye(d)
        moves = moves.reshape(k, k) + 1e-10
        model = Hmm((first + 1e-10) / (first + 1e-10).sum(), moves / moves.sum(1, keepdims=True), mu, cov_k)
        likelihood.append(float(v[-1]))
        if len(likelihood) > 1 and likelihood[-1] - likelihood[-2] < tolerance * abs(likelihood[-2]):
            break
    by = np.argsort(model.mean[:, 0])
    model = Hmm(model.start[by], model.move[np.ix_(by, by)], model.mean[by], model.cov[by])
    return model, rows, likelihood


def label(model: Hmm, rows: DataFrame, n_columns: int) -> DataFrame:
    """(run_id, t_idx, state): the most likely sequence of states, counted from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in arrow_groups(batches, 1):
            path = _viterbi(model, np.stack(cols[2 : 2 + n_columns], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cols[-1].astype(np.int64)), pa.array(cols[1]), pa.array((path + 1).astype(np.int32))], ["run_id", "t_idx", "state"])

    return rows.mapInArrow(run, "run_id bigint, t_idx bigint, state int")


def regimes(df: DataFrame, columns: Sequence[str], n_states: int = 3, **options) -> DataFrame:
    """Labels of a fitted model for every clean row."""
    model, rows, _ = fit(df, columns, n_states, **options)
    return label(model, rows, len(columns))
