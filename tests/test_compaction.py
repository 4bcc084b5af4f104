import struct

import pytest
from pyspark.sql import functions as F

from regimeflow.common import hadoop_fs, new_path
from regimeflow.operators import compaction
from regimeflow.operators.compaction import CompactionConflict, SnapshotTable
from regimeflow.sources.saved_files import compacted, held_samples


def rows(spark, a, b, part="p"):
    return spark.range(a, b).select("id", F.concat(F.lit(part), (F.col("id") % 2).cast("string")).alias("part"), (F.col("id") * 0.5).alias("v"))


def test_only_partitions_with_many_small_files_are_rewritten(spark):
    t = SnapshotTable(spark, new_path(spark, "t"), ["part"])
    for i in range(5):
        t.append(rows(spark, i * 100, i * 100 + 100).filter("part = 'p0' OR id < 100").coalesce(1))
    before = {r["part"]: r for r in t.census().collect()}
    assert before["part=p0"].files == 5 and before["part=p1"].files == 1
    want = sorted(map(tuple, t.read().select("id", "part", "v").collect()))
    version = t.compact(most_small=3)
    after = {r["part"]: r for r in t.census().collect()}
    assert after["part=p0"].files == 1 and after["part=p1"]["print"] == before["part=p1"]["print"]
    assert sorted(map(tuple, t.read().select("id", "part", "v").collect())) == want
    assert t.version() == version == 6 and t.snapshot(6)["rows"] == len(want) and t.snapshot(6)["files"] == 2
    assert t.compact(most_small=3) is None


def test_versions_stay_readable_until_vacuum(spark):
    t = SnapshotTable(spark, new_path(spark, "t"), ["part"])
    for i in range(4):
        t.append(rows(spark, i * 10, i * 10 + 10).coalesce(1))
    reader = t.read(2)  # begun before the compaction, ends after it
    t.compact(most_small=1)
    assert [t.read(v).count() for v in (1, 2, 3, 4, 5)] == [10, 20, 30, 40, 40] and reader.count() == 20
    assert t.vacuum(keep=1) == 8 and t.read().count() == 40 and t.vacuum() == 0


def test_conflicts_and_recovery(spark):
    t = SnapshotTable(spark, new_path(spark, "t"), ["part"])
    for i in range(3):
        t.append(rows(spark, i * 10, i * 10 + 10).coalesce(1))
    other = rows(spark, 1000, 1010).coalesce(1)

    def sneak_in():  # a writer that ignores the claim and puts files beside others
        other.write.mode("append").partitionBy("part").parquet(f"{t.data}/gen=3")

    assert t.compact(most_small=1, before_write=sneak_in, before_commit=sneak_in) == 4
    assert t.read().count() == 50 and t.read(3).count() == 30
    assert t.vacuum() == 6 and t.read().count() == 50
    assert t.compact(most_small=1) == 5 and t.read().count() == 50

    def take_away():
        fs, p = hadoop_fs(spark, f"{t.data}/{t.manifest().orderBy('file').first().file}")
        fs.delete(p, False)

    t.append(other)
    t.append(other)
    with pytest.raises(CompactionConflict, match="removed"):
        t.compact(most_small=1, before_commit=take_away)
    assert t.version() == 7 and t.snapshot(8)["state"] == "abandoned"

    t = SnapshotTable(spark, new_path(spark, "t"), ["part"])
    t.append(other)
    t.append(other)
    t.claim("a writer that dies")
    other.withColumn("gen", F.lit(3)).write.partitionBy("gen", "part").mode("append").parquet(t.data)  # what it left
    with pytest.raises(CompactionConflict):
        t.append(other)
    with pytest.raises(CompactionConflict):
        t.compact(most_small=1)
    t.recover()
    assert t.compact(most_small=1) == 4 and t.read().count() == 20

    def fail():
        raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        t.compact(most_small=0, before_write=fail)
    assert t.append(other) == 6 and t.read().count() == 30


def test_many_files_are_joined_not_listed(spark, monkeypatch):
    monkeypatch.setattr(compaction, "FEW", 1)
    t = SnapshotTable(spark, new_path(spark, "t"), ["part"])
    t.append(rows(spark, 0, 10, "a b/%").coalesce(1))
    t.append(rows(spark, 10, 20, "a b/%").withColumn("part", F.when(F.col("id") > 12, F.col("part"))).coalesce(1))
    assert t.compact(most_small=1) == 3 and t.read().count() == 20 and t.read().filter("part IS NULL").count() == 3


def test_sizes_and_key(spark):
    t = SnapshotTable(spark, new_path(spark, "t"), ["part"])
    t.append(rows(spark, 0, 4000).repartition(4))
    t.append(rows(spark, 2000, 5000).repartition(3))
    size = sum(r["bytes"] for r in t.census().collect()) / 2
    t.compact(most_small=1, target_bytes=int(size / 3), key=["id"])
    assert all(2 <= r["files"] <= 4 for r in t.census().collect())
    assert t.read().count() == 5000 == t.read().select("id").distinct().count()


def test_clashing_and_extra_columns(spark):
    t = SnapshotTable(spark, new_path(spark, "t"), ["part"])
    df = rows(spark, 0, 10).withColumns({"file": F.lit("x"), "n": F.lit(None).cast("string"), "rows": F.lit(2)})
    t.append(df)
    t.append(df)
    t.compact(most_small=1, key=["id"])
    assert t.read().count() == 10 and set(t.read().columns) == {"id", "v", "file", "n", "rows", "part"}
    with pytest.raises(ValueError, match="gen"):
        t.append(df.withColumn("gen", F.lit(1)))


def pack(cols):
    return b"".join(struct.pack("<d", v) for c in cols for v in c)


SAVED = "file_id bigint, file_name string, run_id int, first_idx bigint, sample_num int, dims int, n_bytes bigint, payload binary"


def test_samples_come_out_once(spark):
    files = [
        (1, "x/dataOro20_7.000.bin", 7, 0, 3, 2, 48, pack([(1, 2, 3), (10, 20, 30)])),
        (2, "DATAORO20_7-1.BIN", None, 2, 2, 2, None, pack([(3, 4), (30, 40)])),
        (3, "ftle_20_7.bin", 7, 2, 1, 2, 16, pack([(5,), (6,)])),
        (4, "dataOro20_7.bin", 7, 0, 3, 2, 48, pack([(1, 2, 3), (10, 20, 30)])[:-8]),
        (5, "dataOro20_7.bin", 7, 0, 0, 2, 0, b""),
        (6, "other.bin", 7, 0, 1, 2, 16, pack([(1,), (1,)])),
        (7, None, 7, 0, 1, 2, 16, pack([(1,), (1,)])),
        (8, "dataOro20_7.bin", 7, None, 1, 2, 16, pack([(1,), (1,)])),
        (9, "dataOro20_7.bin", 7, 0, 1, 2, 16, None),
    ]
    t = compacted(spark.createDataFrame(files, SAVED).repartition(4))
    got = sorted(tuple(r) for r in held_samples(t, spark).collect())
    assert got == [
        ("dataOro", 7, 0, [1, 10], 1), ("dataOro", 7, 1, [2, 20], 1), ("dataOro", 7, 2, [3, 30], 2), ("dataOro", 7, 3, [4, 40], 1), ("ftle", 7, 2, [5, 6], 1),
    ]
    assert all(r["files"] == 1 for r in t.census().collect())


def test_no_files(spark):
    t = compacted(spark.createDataFrame([], SAVED))
    assert held_samples(t, spark).count() == 0
