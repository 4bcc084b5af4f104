"""Compaction of partitioned tables of many small files, with snapshot versions and conflict checks.

A table is a folder. `data/gen=N/<partition>/` holds the Parquet files that version N wrote; no file is ever changed.
`_snapshots/N.json` says what version N is and whether it is committed, `_snapshots/N/` is its manifest, a table with a
row per file: readers of a version see its files and no others, whatever is written meanwhile. To compact:

1. take the census of the version's files (its manifest, and files that others put beside them since) and pick the
   partitions with more than `most_small` files under `small_bytes`;
2. claim the next version by creating its file, which only one writer can;
3. rewrite the picked partitions, and only these, from just the files of the census, each in as many files as its bytes
   ask for, by dynamic overwrite of the new generation's folder: a job that runs again replaces its own files only;
4. check that all rows of the census' files were read, that all rows written are there, and that none of these files was
   changed or removed since the census (CompactionConflict); files that others added since stay and join the version;
5. write the manifest and commit the version. Replaced files stay for readers of older versions until vacuum().

Executors that are lost are no matter: Spark runs their tasks again, and only files of finished tasks come into place. If
the driver dies, its claim stays and its files belong to no version; recover() gives the claim up.

The claim relies on a file system that creates a file exclusively, as HDFS and local ones do. On object stores without
that, two writers may both believe to have the claim; there the folder needs a lock from outside.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..common import hadoop_fs, materialize

#: Files, and partitions, of which a list goes through the driver at most; beyond, it stays a table that is joined.
FEW = 10_000
#: Tasks that write in a job, at most.
MOST_TASKS = 20_000
#: Names of columns that the table itself uses.
RESERVED = frozenset(("gen", "_part", "_n", "_file", "_name"))
MANIFEST = "file string, part string, bytes bigint, written timestamp, rows bigint, merged boolean"


class CompactionConflict(RuntimeError):
    """Another writer changed the table, or claimed its next version."""


class SnapshotTable:
    """A partitioned Parquet table with versions."""

    def __init__(self, spark: SparkSession, root: str, partition_by: Sequence[str]):
        self.spark, self.root, self.partition_by = spark, root.rstrip("/"), list(partition_by)
        self.data, self.log = f"{self.root}/data", f"{self.root}/_snapshots"

    # versions

    def _heads(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, self.log)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def snapshot(self, version: int) -> dict:
        fs, p = hadoop_fs(self.spark, f"{self.log}/{version:08d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> int:
        """The last committed version; 0 for a new table."""
        return next((v for v in reversed(self._heads()) if self.snapshot(v)["state"] == "committed"), 0)

    def _write(self, version: int, content: dict, overwrite: bool) -> None:
        fs, p = hadoop_fs(self.spark, f"{self.log}/{version:08d}.json")
        try:
            stream = fs.create(p, overwrite)
        except Exception as e:  # Py4J wraps what the file system throws
            if fs.exists(p):
                raise CompactionConflict(f"version {version} is claimed") from e
            raise
        try:
            stream.write(json.dumps(content).encode())
        finally:
            stream.close()

    def claim(self, what: str) -> int:
        """Reserve the next version for this writer. A number is never used twice, so a writer that was given up can't
        come into another's files."""
        last = max(self._heads(), default=0)
        if last and self.snapshot(last)["state"] == "claimed":
            raise CompactionConflict(f"version {last} is claimed")
        self._write(last + 1, {"state": "claimed", "what": what}, overwrite=False)
        return last + 1

    def release(self, version: int) -> None:
        """Give a claim up: its files, if any, belong to no version and are deleted."""
        self._write(version, {"state": "abandoned"}, overwrite=True)
        fs, p = hadoop_fs(self.spark, f"{self.data}/gen={version}")
        fs.delete(p, True)

    def recover(self) -> None:
        """Give up the claim that a dead writer left. What it hadn't committed was never part of the table."""
        last = max(self._heads(), default=0)
        if last and self.snapshot(last)["state"] == "claimed":
            self.release(last)

    # files

    def manifest(self, version: int | None = None) -> DataFrame:
        """Files of a version: file (below data/), part, bytes, written, rows, merged (whether a key was made unique)."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.log}/{version:08d}")

    def _listing(self, generation: int | None = None) -> DataFrame:
        """file, part, bytes, written of all files below data/, or of a generation; no file is opened."""
        root = self.data if generation is None else f"{self.data}/gen={generation}"
        fs, p = hadoop_fs(self.spark, root)
        if not fs.exists(p):
            return self.spark.createDataFrame([], MANIFEST).drop("rows", "merged")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
        found = found.select(F.regexp_extract("_metadata.file_path", r"/data/(gen=\d+/.*)$", 1).alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("written"))
        return found.select("file", F.regexp_extract("file", r"^gen=\d+/(?:(.*)/)?[^/]+$", 1).alias("part"), "bytes", "written")

    def _rows_of(self, files: DataFrame) -> DataFrame:
        """file, rows: from the files' footers."""
        names = self._names(files)
        if not names:
            return self.spark.createDataFrame([], "file string, rows bigint")
        return self._only(files, names).groupBy(F.col("_name").alias("file")).agg(F.count("*").alias("rows"))

    def _with_strangers(self, known: DataFrame) -> DataFrame:
        """A manifest with the files that others put into the folders of its files."""
        folder = F.regexp_replace("file", r"/[^/]*$", "")
        added = self._listing().withColumn("folder", folder).join(known.select(folder.alias("folder")).distinct(), "folder", "left_semi").drop("folder")
        added = added.join(known.select("file"), "file", "left_anti")
        names = self._names(added)
        if not names:
            return known
        added = materialize(added, "added")
        return known.unionByName(added.join(self._rows_of(added), "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("merged", F.lit(False)))

    def census(self, small_bytes: int = 1 << 26) -> DataFrame:
        """Of the last version: part (partition folder), files, bytes, small (files under small_bytes), rows, print (of its files)."""
        return self._by_part(self.manifest(), small_bytes)

    def _by_part(self, files: DataFrame, small_bytes: int) -> DataFrame:
        return files.groupBy("part").agg(
            F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count(F.when(F.col("bytes") < small_bytes, 1)).alias("small"),
            F.sum("rows").alias("rows"), F.bit_xor(F.xxhash64("file", "bytes", "written")).alias("print"), F.every("merged").alias("merged"),
        )

    @staticmethod
    def _names(files: DataFrame) -> list[str]:
        """Names of files, more than FEW only if there are more."""
        return [r.file for r in files.select("file").limit(FEW + 1).collect()]

    def _only(self, files: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Rows of just these files, with the partition columns, and _name, the file. Few files are opened by name, so no other
        is listed."""
        reader = self.spark.read.option("basePath", self.data)
        names = self._names(files) if names is None else names
        file = F.regexp_extract("_metadata.file_path", r"/data/(gen=\d+/.*)$", 1)
        if len(names) <= FEW:
            return reader.parquet(*(f"{self.data}/{unquote(n)}" for n in names)).withColumn("_name", file)
        return reader.parquet(self.data).withColumn("_name", file).join(files.select(F.col("file").alias("_name")), "_name", "left_semi")

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, by default the last committed one; an empty table has no columns but `gen`."""
        files = self.manifest(version)
        names = self._names(files)
        return self._only(files, names).drop("gen", "_name") if names else self.spark.createDataFrame([], "gen int")

    def _commit(self, version: int, what: str, files: DataFrame) -> None:
        """Write the manifest, then the head that makes it a version."""
        path = f"{self.log}/{version:08d}"
        files.select(*(n.split()[0] for n in MANIFEST.split(", "))).coalesce(8).write.mode("overwrite").parquet(path)
        total = self.spark.read.schema(MANIFEST).parquet(path).agg(F.count("*"), F.sum("bytes"), F.sum("rows")).first()
        self._write(version, {"state": "committed", "what": what, "files": total[0], "bytes": total[1] or 0, "rows": total[2] or 0}, overwrite=True)

    def _put(self, df: DataFrame, version: int) -> DataFrame:
        """Write rows as a generation, by dynamic overwrite of its partitions; gives its files after counting their rows."""
        seen = Observation()
        rows = df.withColumn("gen", F.lit(version)).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gen", *self.partition_by).parquet(self.data)
        files = self._listing(version)
        files = materialize(files.join(self._rows_of(files), "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0))), "files")
        there = files.agg(F.sum("rows")).first()[0] or 0
        if there != seen.get["n"]:
            raise RuntimeError(f"{seen.get['n']} rows were written, {there} are there")
        return files

    def append(self, df: DataFrame) -> int:
        """Add rows as new files; gives the new version. Columns may not be named as those in RESERVED."""
        if clash := sorted(RESERVED.intersection(df.columns)):
            raise ValueError(f"columns {', '.join(clash)} are the table's own")
        known = self.manifest()
        version = self.claim("append")
        try:
            files = self._put(df, version)
            self._commit(version, "append", known.unionByName(files.withColumn("merged", F.lit(False))))
        except BaseException:
            self.release(version)
            raise
        return version

    def compact(
        self, small_bytes: int = 1 << 26, most_small: int = 8, target_bytes: int = 1 << 28, key: Sequence[str] = (), merge: dict[str, Column] | None = None,
        before_write: Callable | None = None, before_commit: Callable | None = None,
    ) -> int | None:
        """Rewrite the partitions that have more than `most_small` small files; gives the version, or None if there are none.

        With a `key`, rows that repeat it become one: other columns come from any of them, those in `merge` from its
        aggregates; partitions with files of which that isn't known yet are rewritten too. The two functions are called
        before the rewrite and before the last check (for tests).
        """
        before = self._with_strangers(self.manifest())
        wanted = F.col("small") > most_small
        if key:
            wanted |= ~F.col("merged")
        picked = materialize(self._by_part(before, small_bytes).filter(wanted).select("part", "bytes"), "picked")
        if not picked.head(1):
            return None
        version = self.claim("compact")
        try:
            sources = materialize(before.join(picked.select("part"), "part", "left_semi"), "sources")
            if before_write:
                before_write()
            files = self._rewrite(version, sources, picked, target_bytes, key, merge or {})
            if before_commit:
                before_commit()
            now = self._listing()
            lost = sources.select("file", "bytes", "written").exceptAll(now.select("file", "bytes", "written"))
            if lost.head(1):
                raise CompactionConflict("files were changed or removed since the census")
            # files that came since the census are nobody's source; they go on
            rest = self._with_strangers(self.manifest()).join(sources.select("file"), "file", "left_anti")
            self._commit(version, "compact", rest.unionByName(files.withColumn("merged", F.lit(bool(key)))))
        except BaseException:
            self.release(version)
            raise
        return version

    def _rewrite(self, version: int, sources: DataFrame, picked: DataFrame, target_bytes: int, key: Sequence[str], merge: dict[str, Column]) -> DataFrame:
        """Write the sources' rows as a generation, each partition in the files its bytes ask for."""
        seen = Observation()
        old = self._only(sources).drop("gen", "_name")
        rest = [c for c in old.columns if c not in self.partition_by]
        old = old.observe(seen, F.count(F.lit(1)).alias("n"))
        if key:
            aggs = [merge[c].alias(c) if c in merge else F.first(c).alias(c) for c in rest if c not in key]
            old = old.groupBy(*self.partition_by, *(c for c in key if c not in self.partition_by)).agg(*aggs)
        number = picked.select(F.col("part").alias("_part"), F.greatest(F.ceil(F.col("bytes") / F.lit(target_bytes)), F.lit(1)).alias("_n"))
        total = number.agg(F.sum("_n"), F.count("*")).first()
        small = number.hint("broadcast") if total[1] <= FEW else number
        sized = old.withColumn("_part", self._part()).join(small, "_part", "left").withColumn("_file", F.pmod(F.xxhash64(*(key or rest)), F.coalesce("_n", F.lit(1))))
        sized = sized.repartition(min(total[0], MOST_TASKS), *self.partition_by, "_file").select(*rest, *self.partition_by)
        files = self._put(sized, version)
        expected = sources.agg(F.sum("rows")).first()[0] or 0
        if seen.get["n"] != expected:
            raise RuntimeError(f"of {expected} rows {seen.get['n']} were read")
        return files

    def _part(self) -> Column:
        """The partition folder's name from the partition columns, as Spark spells plain values; others get one file."""
        null = "__HIVE_DEFAULT_PARTITION__"
        cols = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(null))) for c in self.partition_by]
        return F.concat_ws("/", *cols)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that only versions before the last `keep` have; gives their number. Those versions can't be read
        any more. Files that no version lists are left alone."""
        versions = [v for v in self._heads() if self.snapshot(v)["state"] == "committed"]
        old, kept = versions[:-keep], versions[-keep:]
        if not old or not kept:
            return 0
        wanted = self.manifest(kept[0]).select("file")
        for v in kept[1:]:
            wanted = wanted.unionByName(self.manifest(v).select("file"))
        gone = self.manifest(old[0]).select("file")
        for v in old[1:]:
            gone = gone.unionByName(self.manifest(v).select("file"))
        n = 0
        for r in materialize(gone.distinct().join(wanted, "file", "left_anti"), "gone").toLocalIterator():
            fs, p = hadoop_fs(self.spark, f"{self.data}/{unquote(r.file)}")
            n += bool(fs.delete(p, False))
        for v in old:
            self._write(v, {"state": "vacuumed"}, overwrite=True)
        return n
