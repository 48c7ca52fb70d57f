"""Tables kept by document: read whole or by document, and replaced for some documents at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quire.operators import segments

#: Marks the one row that stands for a document without rows: its partition is written, so old rows go.
EMPTY = "__empty"


def _stored(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in schema if f.name != "doc"] + [StructField(EMPTY, BooleanType()), schema["doc"]])


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a table that `replace` writes. The partition of a document is all that a filter on doc reads."""
    return spark.read.schema(_stored(schema)).parquet(path).filter(~F.col(EMPTY)).select(*schema.fieldNames())


@segments.tidied
def replace(rows: DataFrame, path: str, docs: DataFrame) -> None:
    """All rows of docs (doc) in the table at path become rows, which has a column doc; other documents' files are not touched.

    The table is partitioned by document and only partitions of docs are overwritten, so running again changes nothing. A
    document of docs without rows is emptied; rows of documents that are not in docs are left out. rows may read the table itself: they are
    written aside first. Spark deals them by document, in more tasks where a document is large. A null doc is a document of
    its own; an empty name is stored as null.
    """
    asked = docs.select("doc").distinct()
    there = F.col("doc").eqNullSafe(F.col("__doc"))
    own = segments.settle(rows.join(asked.withColumnRenamed("doc", "__doc"), there, "left_semi").withColumn(EMPTY, F.lit(False)), "replaced")
    bare = asked.join(own.select(F.col("doc").alias("__doc")).distinct(), there, "left_anti").withColumn(EMPTY, F.lit(True))
    both = own.unionByName(bare, allowMissingColumns=True)
    columns = [*(c for c in rows.columns if c != "doc"), EMPTY, "doc"]
    both.select(*columns).hint("rebalance", "doc").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").parquet(path)
