import numpy as np
import pytest

from regimeflow.sources.state_files import combine_runs, file_name, list_runs, read_states, write_states


def test_scan_of_a_small_file(spark, tmp_path):
    p = tmp_path / "dataOro20_7.bin"
    np.array([1, 2, 3, 10, 20, 30], dtype="<f8").tofile(p)
    rows = read_states(spark, [str(p)], dims=2).orderBy("t_idx").collect()
    assert [tuple(r) for r in rows] == [(7, 0, 1.0, 10.0), (7, 1, 2.0, 20.0), (7, 2, 3.0, 30.0)]
    with pytest.raises(Exception, match="bytes"):
        read_states(spark, [str(p)], dims=2, sample_num=4).count()


def test_round_trip_ranges_and_columns(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(1001, 6))
    rows = [(r, i, *map(float, v)) for r in (1, 3) for i, v in enumerate(x * r)]
    df = spark.createDataFrame(rows, "run_id int, t_idx bigint, " + ", ".join(f"x_{i + 1} double" for i in range(6)))
    made = write_states(df.repartition(5), str(tmp_path), [f"x_{i + 1}" for i in range(6)])
    assert {(r.run_id, r.sample_num) for r in made.collect()} == {(1, 1001), (3, 1001)} and len(list_runs(str(tmp_path))) == 2
    back, missing = combine_runs(spark, str(tmp_path / "states_{run}.bin"), [1, 2, 3], dims=6, sample_num=1001)
    assert [r.run_id for r in missing.collect()] == [2]
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    part = read_states(spark, list_runs(str(tmp_path)), 6, columns=["x_5", "t_idx"], rows_per_partition=300)
    assert part.rdd.getNumPartitions() == 8 and sorted(map(tuple, part.collect())) == sorted((r[6], r[1]) for r in rows)
    small = f"file://{tmp_path}/small"
    made = write_states(df.filter("t_idx <> 500"), small, ["x_1", "x_2", "x_3", "x_4", "x_5", "x_6"], rows_per_file=300)
    assert {r.sample_num for r in made.collect()} == {300, 200, 99, 101} and made.count() == 10 and sorted(r.path for r in made.collect()) == list_runs(small)
    assert sorted(map(tuple, read_states(spark, list_runs(small), 6).collect())) == sorted(r for r in rows if r[1] != 500)
    assert write_states(df.limit(0), f"{small}-none", ["x_1"]).count() == 0
    assert combine_runs(spark, str(tmp_path / "none_{run}.bin"), [1], 6)[0] is None


def test_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("dataOro", 0.2, 5), ("ftle", 0.155, 12)], "k string, g double, r int")
    assert [r[0] for r in df.select(file_name(F.col("k"), F.col("g"), F.col("r"))).collect()] == ["dataOro20_5.bin", "ftle16_12.bin"]
