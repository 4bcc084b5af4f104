import datetime as dt

from regimeflow.streaming.episodes import stream_episodes


def test_stream_gives_the_episodes_of_the_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    batches = [
        [(1, 0, 1, 0), (1, 1, 1, 1), (2, 0, 3, 1)],
        [(1, 3, 2, 2), (1, 2, 1, 2), (1, 1, 9, 2), (None, 0, 1, 2)],
        [(1, 20, 2, 3), (2, 1, 3, 3), (2, 2, 1, 3)],
        [(3, 0, 1, 100_000)],
        [(3, 1, 1, 200_000)],
    ]
    schema = "run_id int, t_idx bigint, state int, loaded_at timestamp"
    src = str(tmp_path / "in")
    frame = None
    stream = None
    for i, rows in enumerate(batches):
        spark.createDataFrame([(a, b, c, base + dt.timedelta(seconds=s)) for a, b, c, s in rows], schema).coalesce(1).write.mode("append").parquet(src)
        if stream is None:
            frame = spark.readStream.schema(schema).parquet(src)
            stream = stream_episodes(frame, timeout_ms=1000).writeStream.format("memory").queryName("eps").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        stream.processAllAvailable()
    stream.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM eps").collect())
    assert [g for g in got if g[0] < 3] == [(1, 1, 0, 2, 3), (1, 2, 3, 3, 1), (1, 2, 20, 20, 1), (2, 1, 2, 2, 1), (2, 3, 0, 1, 2)]
