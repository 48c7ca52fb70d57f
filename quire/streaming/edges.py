"""Reference edges kept up as sections change, by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from quire.operators import refs, segments
from quire.sources import stored

EDGES = "doc string, from_id string, to_id string, target_page int, anchor string, occurrences bigint"


def create(spark: SparkSession, path: str) -> None:
    """An empty table of edges, unless there is one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        empty = spark.createDataFrame([], EDGES)
        stored.replace(empty, path, empty)


def changes(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Changed sections (doc, id, at, markdown) as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def kept_up(changed: DataFrame, target: str, checkpoint: str, spans: DataFrame, page_counts: DataFrame) -> DataStreamWriter:
    """Replaces the edges that leave changed sections in the table at target, which holds what the batch form gives for the texts so far.

    changed: doc, id, at (which of two changes of a section within a batch is the later), markdown. spans (doc, id, page_start, page_end, lft) and
    page_counts are static. Each batch reads and writes the partitions of its own documents alone; one that runs again
    writes the same.
    """

    @segments.tidied
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        now = batch.groupBy("doc", "id").agg(F.max_by("markdown", "at").alias("markdown"))
        docs = now.select("doc").distinct()
        schema = spark.createDataFrame([], EDGES).schema
        old = stored.read(spark, target, schema).join(docs, "doc", "left_semi")
        new = refs.edges(now, spans, page_counts).select(*schema.fieldNames())
        stored.replace(refs.replace_outgoing(old, new, now.select("doc", "id")), target, docs)

    return changed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
