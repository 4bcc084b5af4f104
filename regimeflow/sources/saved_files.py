"""Small files of samples, kept as rows with their bytes: what they hold, and their compaction into a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import new_path, table
from ..operators.compaction import SnapshotTable
from .state_files import component

#: Kinds of files as named in results.
KINDS = ("dataOro", "ftle")
NAME = r"(dataoro|ftle)_?([0-9]+)_([0-9]+)"
#: Runs in a partition of the table.
RUNS_PER_GROUP = 250
KEY = ["file_kind", "run_id", "t_idx"]


def whole_files(saved: DataFrame) -> DataFrame:
    """file_kind, run_id, first_idx, sample_num, dims, payload of whole files: those of a known kind whose bytes are as
    many as dims and sample_num ask for. The run is `run_id` or, where that is null, the one the name tells.
    Anything null that is needed makes a file hold nothing; so do no samples."""
    name = F.lower("file_name")
    kind = F.regexp_extract(name, NAME, 1)
    told = F.regexp_extract(name, NAME, 3)
    by_name = F.when(told != "", told.try_cast("int"))
    rows = saved.select(
        F.when(kind == "dataoro", KINDS[0]).when(kind == "ftle", KINDS[1]).alias("file_kind"), F.coalesce(F.col("run_id").cast("int"), by_name).alias("run_id"),
        F.col("first_idx").cast("bigint"), F.col("sample_num").cast("int"), F.col("dims").cast("int"), "payload",
    )
    fits = F.octet_length("payload") == F.lit(8).cast("bigint") * F.col("dims") * F.col("sample_num")
    return rows.filter(fits & (F.col("sample_num") > 0) & (F.col("dims") > 0)).dropna()


def samples(saved: DataFrame) -> DataFrame:
    """One row per sample of every whole file: file_kind, run_id, t_idx, x ARRAY<DOUBLE>, n_files = 1."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, run, first, n, dims, payload = (c.to_pylist() for c in b.columns)
            if not n:
                continue
            counts = np.array(n)
            at = np.repeat(np.arange(len(n)), counts)
            step = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            flat = np.concatenate([np.stack([component(p, k, m) for k in range(d)], axis=1).ravel() for p, d, m in zip(payload, dims, n)])
            offsets = np.r_[0, np.cumsum(np.repeat(dims, counts))].astype(np.int32)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(np.array(first)[at] + step), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(np.ones(len(at), np.int64))],
                [*KEY, "x", "n_files"],
            )

    return whole_files(saved).mapInArrow(decode, "file_kind string, run_id int, t_idx bigint, x array<double>, n_files bigint")


def compacted(saved: DataFrame, root: str | None = None, target_bytes: int = 1 << 28) -> SnapshotTable:
    """A table, by kind and group of runs, of all samples that whole files hold, each once, in few files.

    First every sample goes in as it arrives, in many small files; then the partitions are compacted, and in each the
    samples that several files hold become one row, with their number.
    """
    spark = saved.sparkSession
    t = SnapshotTable(spark, root or new_path(spark, "samples"), ["file_kind", "run_group"])
    t.append(samples(saved).withColumn("run_group", F.expr(f"run_id div {RUNS_PER_GROUP}").cast("int")))
    t.compact(most_small=1, target_bytes=target_bytes, key=KEY, merge={"n_files": F.sum("n_files")})
    return t


def held_samples(t: SnapshotTable, spark: SparkSession) -> DataFrame:
    """file_kind, run_id, t_idx, x, n_files of the compacted table."""
    if not t.manifest().head(1):
        return spark.createDataFrame([], "file_kind string, run_id int, t_idx bigint, x array<double>, n_files bigint")
    if t.manifest().filter("NOT merged").head(1):
        raise ValueError("the table isn't compacted")
    return t.read().select(*KEY, "x", "n_files")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = compacted(table(spark, sf_dir, "saved_file"))
    return held_samples(t, spark).filter("n_files >= 2").select(*KEY)


def p4_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = compacted(table(spark, sf_dir, "saved_file"))
    return held_samples(t, spark).select(*KEY, "n_files", *(F.get("x", F.lit(i)).alias(f"x_{i + 1}") for i in range(6)))


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of each partition after compaction."""
    return compacted(table(spark, sf_dir, "saved_file")).census().select("part", "files", "bytes")


WHOLE_SQL = f"""SELECT file_id, CASE regexp_extract(lower(file_name), '{NAME}', 1) WHEN 'dataoro' THEN 'dataOro' WHEN 'ftle' THEN 'ftle' END AS file_kind,
  coalesce(run_id, try_cast(nullif(regexp_extract(lower(file_name), '{NAME}', 3), '') AS INTEGER)) AS run_id, first_idx, sample_num, dims, payload
  FROM saved_file WHERE octet_length(payload) = 8 * dims * sample_num AND sample_num > 0 AND regexp_extract(lower(file_name), '{NAME}', 1) <> ''
  AND coalesce(run_id, try_cast(nullif(regexp_extract(lower(file_name), '{NAME}', 3), '') AS INTEGER)) IS NOT NULL AND first_idx IS NOT NULL"""
P4_FOUND_SQL = f"""
WITH f AS ({WHOLE_SQL}),
s AS (SELECT DISTINCT file_id, file_kind, run_id, unnest(range(first_idx, first_idx + sample_num)) AS t_idx FROM f)
SELECT file_kind, run_id, t_idx FROM s GROUP BY ALL HAVING count(*) >= 2"""
