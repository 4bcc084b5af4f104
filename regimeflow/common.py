"""Helpers shared by the operators: the shared folder, materialised tables, label parsing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = (1, 2, 3, 4)
#: Words that name a state, and full-width figures.
STATE_WORDS = ("one", "two", "three", "four")
WIDE_DIGITS, PLAIN_DIGITS = "０１２３４５６７８９", "0123456789"
KEY = ["run_id", "t_idx"]

_written: list[str] = []


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per Spark context; they may run elsewhere, or have no path to it."""
    sc = spark.sparkContext
    if getattr(sc, "_regimeflow_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "regimeflow.zip"  # served by the driver as long as it runs
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._regimeflow_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, and all runs on this machine, a temporary one, set for the
    session. On a cluster it must be set, since a folder of the driver's machine is none that executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset; give a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/regimeflow-{uuid.uuid4().hex[:12]}-{name}"
    _written.append(path)
    return path


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path as Hadoop's type."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends there and it survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup() -> None:
    """Delete what materialize() wrote; results that still read it must be used before."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _written:
        fs, p = hadoop_fs(spark, _written.pop())
        fs.delete(p, True)


def _at_exit() -> None:
    try:
        cleanup()
    except Exception:  # the JVM may be gone already
        pass


atexit.register(_at_exit)


def arrow_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns, as arrays, of each stretch of rows that agree in the first `keys` columns (none null).

    For use in mapInArrow after a repartition and a sort within partitions by these columns: a group comes whole,
    and of other groups no more than a batch is held.
    """
    pieces: list[list[np.ndarray]] = []  # of the open group; joined once, at its end
    join = lambda: pieces[0] if len(pieces) == 1 else [np.concatenate(x) for x in zip(*pieces)]
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if pieces and any(c[0] != o[-1] for c, o in zip(cols[:keys], pieces[-1])):
            yield join()
            pieces = []
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in cols[:keys]:
            new |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(edges, edges[1:]):
            pieces.append([c[a:b] for c in cols])
            yield join()
            pieces = []
        pieces.append([c[edges[-1] :] for c in cols])
    if pieces:
        yield join()


def label_state(label: Column) -> Column:
    """State 1 to 4 that a free label names, in figures or as an English word; null if it says nothing."""
    text = F.lower(F.translate(label, WIDE_DIGITS, PLAIN_DIGITS))
    number = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1)
    number = F.when(number != "", number.try_cast("double"))
    word = F.regexp_extract(text, "(?:^|[^a-z])(" + "|".join(STATE_WORDS) + ")(?:[^a-z]|$)", 1)
    by_word = F.lit(None).cast("int")
    for state, name in zip(STATES, STATE_WORDS):
        by_word = F.when(word == name, F.lit(state)).otherwise(by_word)
    return F.coalesce(F.when(number.isin(*map(float, STATES)), number.cast("int")), by_word)


def resolved_state(state: Column, label: Column) -> Column:
    """`state` if it is 1 to 4, otherwise the state that `label` names, else null."""
    return F.coalesce(F.when(state.isin(*STATES), state), label_state(label))


def state_samples(regime: DataFrame) -> DataFrame:
    """One row (run_id, t_idx, state) per sample with a known state.

    Re-sent rows count once; where one of them tells no state, the others decide. Null keys are no samples.
    """
    return (
        regime.select(*KEY, resolved_state(F.col("state"), F.col("label")).alias("state"))
        .filter(F.col("state").isNotNull() & F.col("run_id").isNotNull() & F.col("t_idx").isNotNull())
        .groupBy(*KEY).agg(F.max("state").alias("state"))
    )


def state_samples_sql() -> str:
    """The same in DuckDB's SQL, as a query text over the table `regime`."""
    words = " ".join(f"WHEN '{w}' THEN {s}" for s, w in zip(STATES, STATE_WORDS))
    return f"""
    SELECT run_id, t_idx, max(st) AS state FROM (
      SELECT run_id, t_idx, CASE WHEN state BETWEEN 1 AND 4 THEN state
        WHEN try_cast(num AS DOUBLE) IN (1, 2, 3, 4) THEN CAST(try_cast(num AS DOUBLE) AS INTEGER)
        ELSE CASE word {words} END END AS st
      FROM (SELECT run_id, t_idx, state, nullif(regexp_extract(txt, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS num,
              regexp_extract(txt, '(?:^|[^a-z])({"|".join(STATE_WORDS)})(?:[^a-z]|$)', 1) AS word
            FROM (SELECT run_id, t_idx, state, lower(translate(label, '{WIDE_DIGITS}', '{PLAIN_DIGITS}')) AS txt FROM regime)))
    WHERE st IS NOT NULL AND run_id IS NOT NULL AND t_idx IS NOT NULL GROUP BY ALL"""
