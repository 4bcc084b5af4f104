"""Vectors of snapshots: which of them count, hashed features, exact copies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 20
#: Buckets of the hashed features.
WIDTH = 32
#: Bits of the hash of an id; sums of it stay in 64 bits for 2**27 ids.
ID_BITS = 36


def feature_map(names: Sequence[str], weights: Sequence[float], width: int = WIDTH) -> np.ndarray:
    """Matrix (names, width): each feature goes to a hashed bucket with a hashed sign and its weight.

    The first seed is taken for which no two features of weight meet in a bucket, so that distances between weighted
    features stay as they are; where there is none among 20,000 (too many names), the last.
    """
    if len(names) > width:
        raise ValueError(f"{len(names)} features don't fit {width} buckets")
    used = [n for n, w in zip(names, weights) if w]
    for seed in range(20_000):
        if len({xxhash.xxh64_intdigest(n, seed) % width for n in used}) == len(used):
            break
    m = np.zeros((len(names), width))
    for i, (n, w) in enumerate(zip(names, weights)):
        h = xxhash.xxh64_intdigest(n, seed)
        m[i, h % width] = w * (1 if h >> 63 else -1)
    return m


def whole(vec: Column, dims: int = DIMS) -> Column:
    """Whether a vector has `dims` values, none of them null, NaN or infinite (an infinite one is near to nothing)."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) == dims) & ~bad


def hashed_vectors(df: DataFrame, id_column: str = "vec_id", vec: str = "vec", state: str | None = None, state_weight: float = 0.0, dims: int = DIMS) -> DataFrame:
    """(vec_id, f): the hashed weighted features of every row with a whole vector, as bytes of doubles.

    Features are the vector's components at weight 1 and, if asked for, the category of `state` at `state_weight`.
    Buckets that no feature falls into are always 0 and aren't kept.
    """
    names = [f"vec_{i}" for i in range(dims)]
    states = [f"state={s}" for s in (1, 2, 3, 4)] if state and state_weight else []
    m = feature_map(names + states, [1.0] * dims + [state_weight] * len(states), WIDTH)
    m = m[:, m.any(axis=0)]

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, dims)
            f = x @ m[:dims]
            for k in range(len(states)):
                f[b.column(2).to_numpy(zero_copy_only=False) == k + 1] += m[dims + k]
            f += 0.0  # a negative zero equals zero, but not in bytes
            yield pa.RecordBatch.from_arrays([b.column(0), bytes_of(f)], ["vec_id", "f"])

    cols = [F.col(id_column).cast("bigint").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec")]
    cols += [F.coalesce(F.col(state).cast("int"), F.lit(0)).alias("state")] if states else []
    return df.filter(F.col(id_column).isNotNull() & whole(F.col(vec), dims)).select(*cols).mapInArrow(pack, "vec_id bigint, f binary")


def id_hash(c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 64 - ID_BITS)


def without_copies(vectors: DataFrame) -> DataFrame:
    """(rep, f, w, hs): each distinct vector with its smallest id, its number of ids and the sum of their hashes. Rows
    that repeat id and vector count once."""
    return vectors.distinct().groupBy("f").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.sum(id_hash(F.col("vec_id"))).alias("hs"))


def matrix(cells: np.ndarray) -> np.ndarray:
    """Doubles of a column of bytes, a row each; all are of one length."""
    return np.frombuffer(b"".join(cells), dtype=float).reshape(len(cells), -1)


def matrix_of(column: pa.Array) -> np.ndarray:
    """The same of an Arrow column without nulls, from its buffer."""
    if not len(column):
        return np.zeros((0, 0))
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return flat.view(float).reshape(len(column), -1)


def bytes_of(x: np.ndarray) -> pa.Array:
    """An Arrow column with the bytes of each row."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])
