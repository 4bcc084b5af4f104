"""The dense state format: headerless doubles, all samples of component 1, then of component 2 and so on.

A Python data source reads it: a partition per file and range of rows. Only the columns asked for are read, since a
component lies in one stretch of the file. Paths may be those of this machine or URIs of a shared file system.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..common import arrow_groups

#: Run number at the end of a file's name, such as dataOro20_17.bin; before it the first sample's number, if it isn't 0.
RUN = re.compile(r"(?:_at([0-9]+))?_([0-9]+)\.bin$")
ROWS_PER_PARTITION = 1 << 20
BATCH = 1 << 16


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def component(data: bytes, number: int, total: int, first: int = 0, rows: int | None = None) -> np.ndarray:
    """Samples of a component (counted from 0) of bytes that hold `total` samples of each."""
    return np.frombuffer(data, dtype="<f8", count=total - first if rows is None else rows, offset=8 * (number * total + first))


class StatePartition(InputPartition):
    def __init__(self, path: str, run: int | None, origin: int, first: int, rows: int, total: int):
        self.path, self.run, self.origin, self.first, self.rows, self.total = path, run, origin, first, rows, total


class StateReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.dims = int(options["dims"])
        self.paths = options["path"].split(",")
        self.chunk = int(options.get("rowsPerPartition", ROWS_PER_PARTITION))
        self.samples = int(options["sample_num"]) if "sample_num" in options else None

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            fs, p = located(path)
            size = fs.get_file_info(p).size or 0
            total = self.samples if self.samples is not None else size // (8 * self.dims)
            if size != 8 * self.dims * total:
                raise ValueError(f"{path} has {size} bytes, not 8 * {self.dims} * {total}")
            found = RUN.search(path)
            run, origin = (int(found[2]), int(found[1] or 0)) if found else (None, 0)
            out += [StatePartition(path, run, origin, a, min(self.chunk, total - a), total) for a in range(0, total, self.chunk)]
        return out

    def read(self, partition: StatePartition) -> Iterator[pa.RecordBatch]:
        fs, path = located(partition.path)
        with fs.open_input_file(path) as f:
            for a in range(partition.first, partition.first + partition.rows, BATCH):
                n = min(BATCH, partition.first + partition.rows - a)
                cols = []
                for name in self.names:
                    if name == "run_id":
                        cols.append(pa.array([partition.run] * n, pa.int32()))
                    elif name == "t_idx":
                        cols.append(pa.array(np.arange(a, a + n) + partition.origin))
                    else:
                        f.seek(8 * ((int(name.rsplit("_", 1)[1]) - 1) * partition.total + a))
                        cols.append(pa.array(component(f.read(8 * n), 0, n)))
                yield pa.RecordBatch.from_arrays(cols, self.names)


class StateSource(DataSource):
    """Format "dense_states". Options: path (files, by commas), dims, sample_num (optional, checked), prefix ("x").

    Give a schema with fewer columns to read only these."""

    @classmethod
    def name(cls) -> str:
        return "dense_states"

    def schema(self) -> str:
        prefix = self.options.get("prefix", "x")
        return "run_id int, t_idx bigint, " + ", ".join(f"{prefix}_{i + 1} double" for i in range(int(self.options["dims"])))

    def reader(self, schema: StructType) -> DataSourceReader:
        return StateReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StateSource)


def read_states(spark: SparkSession, paths: Sequence[str], dims: int, sample_num: int | None = None, prefix: str = "x", columns: Sequence[str] | None = None, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """(run_id, t_idx, x_1..) of dense files; `columns` limits what is read."""
    register(spark)
    reader = spark.read.format("dense_states").option("dims", dims).option("prefix", prefix).option("path", ",".join(paths)).option("rowsPerPartition", rows_per_partition)
    if sample_num is not None:
        reader = reader.option("sample_num", sample_num)
    if columns:
        kinds = {"run_id": "int", "t_idx": "bigint"}
        reader = reader.schema(", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns))
    return reader.load()


def combine_runs(spark: SparkSession, pattern: str, runs: Sequence[int], dims: int, sample_num: int | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(rows of all runs found, missing runs): files are `pattern` with the run's number for `{run}`. Without a file: None."""
    wanted = spark.createDataFrame([(r,) for r in runs], "run_id int")
    paths = {r: pattern.format(run=r) for r in runs}
    there = {r: p for r, p in paths.items() if located(p)[0].get_file_info(located(p)[1]).type == pafs.FileType.File}
    found = spark.createDataFrame([(r,) for r in there], "run_id int")
    missing = wanted.join(found, "run_id", "left_anti")
    return (read_states(spark, list(there.values()), dims, sample_num) if there else None), missing


def write_states(df: DataFrame, folder: str, columns: Sequence[str], name: str = "states{at}_{run}.bin", key: str = "run_id", order: str = "t_idx", rows_per_file: int = ROWS_PER_PARTITION) -> DataFrame:
    """Write each run in the dense format, in order, a file for each range of `rows_per_file` numbers of `order`; gives
    (run_id, path, sample_num), a row per file.

    So no task holds more than a file. `{at}` in the name becomes the first sample's number, where that isn't 0. In a file
    samples follow each other: a run with holes is cut there. Rows with a null run or number are left out; of rows that
    repeat them one is written. A task that runs again writes the same file again."""
    fs, p = located(folder)
    fs.create_dir(p)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, p = located(folder)
        for run, _, at, *cols in arrow_groups(batches, 2):
            for a, b in zip(edges := [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)], edges[1:]):
                path = f"{p}/{name.format(run=run[0], at=f'_at{at[a]}' if at[a] else '')}"
                with fs.open_output_stream(path) as f:
                    f.write(np.stack([c[a:b] for c in cols]).astype("<f8").tobytes())
                where = path if "://" not in folder else folder[: folder.index("://") + 3] + path.lstrip("/") if not folder.startswith("file://") else f"file://{path}"
                yield pa.RecordBatch.from_arrays([pa.array([run[0]], pa.int32()), pa.array([where]), pa.array([b - a], pa.int64())], ["run_id", "path", "sample_num"])

    piece = F.floor(F.col(order) / F.lit(rows_per_file)).alias("piece")
    rows = df.select(F.col(key).cast("int").alias("run"), piece, F.col(order).cast("bigint").alias("at"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    rows = rows.dropna(subset=["run", "at"]).repartition("run", "piece").dropDuplicates(["run", "piece", "at"])
    out = rows.sortWithinPartitions("run", "piece", "at").mapInArrow(write, "run_id int, path string, sample_num bigint")
    # the files are there when this returns; a row per file
    return df.sparkSession.createDataFrame(out.collect(), "run_id int, path string, sample_num bigint")


def list_runs(folder: str) -> list[str]:
    fs, p = located(folder)
    head = folder[: len(folder) - len(p)] if "://" in folder and folder.endswith(p) else ""
    return sorted(head + f.path for f in fs.get_file_info(pafs.FileSelector(p)) if f.path.endswith(".bin"))


def file_name(kind: Column, g: Column, run: Column) -> Column:
    """Name of a run's file: kind, g times 100 rounded half up, run."""
    return F.format_string("%s%d_%d.bin", kind, F.floor(g * 100 + 0.5).cast("int"), run)
