from __future__ import annotations

from pyspark.sql import functions as F

from gavelgrid.streaming import events as streams

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _write(spark, path, part):
    spark.createDataFrame(part, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)


def test_upsert_stream_equals_batch_and_resumes(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    _write(spark, source, [(1, "2024-01-01 00:00:00", 7, "view", 1.0), (2, "2024-01-02 00:00:00", 7, "click", 2.0)])
    run = lambda: streams.stream_upsert(spark.readStream.schema(SCHEMA).parquet(source), target, checkpoint, ["user_id"], "ts").awaitTermination()
    run()
    assert [r.event_id for r in streams.read_version(spark, target).collect()] == [2]
    _write(spark, source, [(3, "2024-01-01 12:00:00", 7, "late", 1.0), (4, "2024-01-03 00:00:00", 8, "view", 1.0)])
    run()
    got = {(r.user_id, r.event_id) for r in streams.read_version(spark, target).collect()}
    batch = streams.latest_by_day(spark.read.schema(SCHEMA).parquet(source))
    assert got == {(r.user_id, r.event_id) for r in batch.collect()} == {(7, 2), (8, 4)}
    run()  # nothing new: nothing changes
    assert streams.read_version(spark, target).count() == 2


def test_sessions_stream_closes_with_the_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    _write(spark, source, [(1, "2024-01-01 00:00:00", 7, "view", 1.0), (2, "2024-01-01 00:30:00", 7, "view", 1.0), (3, "2024-01-01 05:00:00", 7, "view", 1.0)])
    stream = streams.sessions(spark.readStream.schema(SCHEMA).parquet(source), 3600, watermark="10 minutes")
    query = stream.writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.user_id, r.n) for r in spark.table("closed").collect()] == [(7, 2)]
    assert sorted(r.n for r in streams.sessions(spark.read.schema(SCHEMA).parquet(source)).collect()) == [1, 2]
