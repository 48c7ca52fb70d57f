"""Ordered scans over documents of any size: each segment of a document by itself, then what it hands on.

A scan over a document's rows in order (their number, a running sum or greatest value, the last value of a kind) is
cut into segments of a bounded range of the order. Each segment is scanned by a window of its own; one row a segment
holds its total, and a window over these few rows gives what every segment starts from. So no task ever holds one
document's rows, however large the document is, and the result is that of one scan.

Also here: tables written to the shared folder, where a scan is read more than once.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pages of a segment, and rows of one where rows are numbered.
PAGES, ROWS = 256, 4096


#: Rows of one Arrow batch at most where texts are carried.
BATCH_ROWS = 1024


def bounded_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session may do without; a cluster may not."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root or "/tmp/checkpoints"


#: Folders that each running `tidied` function has written.
_written: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: what follows reads it, however often, and no lost executor costs more than a stage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidied(operator):
    """The operator, which deletes what it has written once it returns, but for the folders that its result reads.

    These stay, since results are read later; a folder of the session's own or a rule of the store clears them.
    """

    @wraps(operator)
    def run(*args, **named):
        _written.append([])
        try:
            out = operator(*args, **named)
        finally:
            paths = _written.pop()
        if paths:
            spark = SparkSession.active()
            files = out.inputFiles() if isinstance(out, DataFrame) else []
            for path in paths:
                if not any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in files):
                    delete(spark, path)
                elif _written:
                    _written[-1].append(path)
        return out

    return run


def carried(totals: DataFrame, keys: list[str], segment: str, **kinds: str) -> DataFrame:
    """keys, segment and, under each name of kinds, what the segments before hand on: their sum, max, or last value that is not null.

    totals has one row a segment: keys, segment and a column of each name.
    """
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    of = {"sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), "max": lambda c: F.max(c).over(before), "last": lambda c: F.last(c, ignorenulls=True).over(before)}
    return totals.select(*keys, segment, *[of[kind](c).alias(c) for c, kind in kinds.items()])


def running(rows: DataFrame, keys: list[str], order: list[str], segment: Column, **scans: tuple[str, Column, bool]) -> DataFrame:
    """rows with a column for each scan: name=(sum, max or last, value, whether the row's own value counts).

    order tells rows of a document apart; segment is a number that rises with it. last passes nulls over.
    rows are read twice, so they should be narrow or written.
    """
    w = Window.partitionBy(*keys, "__segment").orderBy(*order)
    cut = rows.withColumn("__segment", segment)
    local, totals = {}, []
    for name, (kind, value, own) in scans.items():
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        local[f"__{name}"] = {"sum": F.sum(value), "max": F.max(value), "last": F.last(value, ignorenulls=True)}[kind].over(frame)
        at = F.struct(*order)
        totals.append({"sum": F.sum(value), "max": F.max(value), "last": F.max_by(value, F.when(value.isNotNull(), at))}[kind].alias(name))
    before = carried(cut.groupBy(*keys, "__segment").agg(*totals), keys, "__segment", **{name: kind for name, (kind, _, _) in scans.items()})
    found = cut.withColumns(local).join(before, [*keys, "__segment"])
    joined = {
        name: {"sum": F.coalesce(f"__{name}", F.lit(0)) + F.col(name), "max": F.greatest(f"__{name}", name), "last": F.coalesce(f"__{name}", name)}[kind]
        for name, (kind, _, _) in scans.items()
    }
    return found.withColumns(joined).drop("__segment", *local)


def numbered(rows: DataFrame, key: str, order: str, name: str, width: int = ROWS) -> DataFrame:
    """rows with name, their place (from 1) among the rows of their key by the whole number order, which tells them apart.

    Segments are ranges of order of that width; rows should be narrow, for they are read twice.
    """
    return running(rows, [key], [order], F.floor(F.col(order) / width), **{name: ("sum", F.lit(1).cast("bigint"), True)})


def ranked(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with name, their place (from 1) among the rows of their key, by columns of any type that have an order.

    Rows are range-partitioned by key and order and written; the partitions are the segments, so even one key with all
    rows fills all tasks evenly.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("__at", F.monotonically_increasing_id())
    ordered = settle(ordered, "ranked").withColumn("__segment", F.shiftright("__at", 33))
    totals = ordered.groupBy(key, "__segment").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(key, "__segment", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__to"))
    return ordered.join(starts, [key, "__segment"]).withColumn(name, F.col("__at") + F.col("__to")).drop("__at", "__segment", "__to")
