"""The import log as a stream: sequence numbers, progress and counts kept up batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from quire.operators import segments, sessions


def log_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Log rows as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_levels(log: DataFrame, at: str = "ts", level: str = "event_type", late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Rows per level and tumbling window; rows later than the watermark are dropped, so state stays bounded."""
    return log.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, span).alias("w"), level).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("window_start"), level, "rows")


def append_sequenced(log: DataFrame, target: str, checkpoint: str, key: str, order: list[str]) -> DataStreamWriter:
    """Appends each batch with idx_seq going on from the rows already kept for its key.

    The last number of each key is kept beside the batches, so a batch reads one row a key and no older rows. A batch
    and its numbers are written under the batch's own number, so one that runs again replaces itself; numbers that no
    batch can need again are deleted.
    """
    last = lambda number: f"{target}/_last/{number}"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        numbered = sessions.sequenced(batch, key, order).withColumn("idx_seq", F.col("idx_seq").cast("long"))
        kept = spark.read.parquet(last(number - 1)) if number else None
        if kept is not None:
            numbered = numbered.join(kept, key, "left").withColumn("idx_seq", F.col("idx_seq") + F.coalesce(F.col("last") + 1, F.lit(0))).drop("last")
        numbered.write.mode("overwrite").parquet(f"{target}/batch={number}")
        now = spark.read.schema(numbered.schema).parquet(f"{target}/batch={number}").select(key, F.col("idx_seq").cast("long").alias("last"))
        (now.unionByName(kept) if kept is not None else now).groupBy(key).agg(F.max("last").alias("last")).write.mode("overwrite").parquet(last(number))
        if number > 1:
            segments.delete(spark, last(number - 2))

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
