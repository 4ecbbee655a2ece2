"""Streams give what the batch gives."""

import datetime

from pyspark.sql import functions as F

from factloom.streaming import counts

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_sessions_equal_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    want = batch.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in" / "*"))
    got = counts.drained(spark, counts.sessions(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    closed = batch.agg(F.max("ts")).first()[0] - datetime.timedelta(minutes=10)
    ended = sorted((r.start, r.user_id, r.n) for r in want.select("session_window.start", "session_window.end", "user_id", "n").collect() if r.end <= closed)
    assert sorted((r.start, r.user_id, r.n) for r in got.collect()) == ended and ended


def test_late_batches_update_their_windows(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    (tmp_path / "in").mkdir()
    for k in range(3):
        batch.filter(F.col("event_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = counts.drained(spark, counts.windowed(stream, late="10000 days"), str(tmp_path / "out"), str(tmp_path / "state"), keys=["start", "event_type"])
    want = batch.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    row = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert row(got) == row(want)
