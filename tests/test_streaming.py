"""Streams give the rows of the same operation over all events at once."""

from pyspark.sql import functions as F

from veriquill.streaming import live

EVENTS = "/root/testdata/sf0.001/events.parquet"


def stream_of(spark, tmp_path, copies=1):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    for _ in range(copies):
        events.coalesce(1).write.mode("append").parquet(source)
    return events, live.read_events(spark, source, events.schema)


def test_repeated_events_come_once(spark, tmp_path):
    events, stream = stream_of(spark, tmp_path, copies=2)
    late = "4000 days"
    live.append_to(live.first_of_each(stream, late), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == events.count() == got.select("event_id").distinct().count()


def test_windows_count_like_batch(spark, tmp_path):
    events, stream = stream_of(spark, tmp_path)
    live.append_to(live.windowed_counts(stream, late="1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    closed = events.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n")).where(F.col("w.end") <= F.lit(closed))
    want = {(r.start, r.user_id, r.n) for r in want.select(F.col("w.start").alias("start"), "user_id", "n").collect()}
    assert want and {(r.start, r.user_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
