"""The import log as a stream gives what the batch form gives."""

from pyspark.sql import functions as F

from quire.operators import sessions
from quire.streaming import log

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_sequences_go_on_across_batches(spark, tmp_path):
    rows = spark.read.parquet(EVENTS).select("event_id", "user_id", "event_type", "ts").orderBy("ts", "event_id").limit(200).coalesce(1)
    for k in range(3):
        rows.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = log.log_stream(spark, str(tmp_path / "in"), rows.schema)
    log.append_sequenced(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "user_id", ["ts", "event_id"]).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 200
    per = got.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("idx_seq").alias("d"), F.max("idx_seq").alias("m"))
    assert per.filter("n <> d or m <> n - 1").count() == 0


def test_windowed_levels(spark, tmp_path):
    rows = spark.read.parquet(EVENTS).select("ts", "event_type")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = log.windowed_levels(log.log_stream(spark, str(tmp_path / "in"), rows.schema))
    q = stream.writeStream.format("memory").queryName("levels").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("levels").agg(F.sum("rows")).first()[0] == rows.count()
    assert sessions.sequenced(rows.withColumn("id", F.monotonically_increasing_id()), "event_type", ["ts", "id"]).count() == rows.count()
