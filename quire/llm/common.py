"""Helpers shared by the training-data operators: shared storage, ordered buckets, sized joins."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, fixed by the contracts: blank and the five control characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast up to this many rows; each holds a few numbers, so at most about 32 MB.
BROADCAST_ROWS = 500_000

#: Most buckets an ordered split is cut into.
MAX_BUCKETS = 20_000


#: Rows of one Arrow batch at most; texts may be long, and several Python workers share an executor's memory.
BATCH_ROWS = 1024


def bounded_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from the session's spark.checkpoint.dir.

    Where that is unset, one is set for a local session; on a cluster no folder is known to be shared, so it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Tables that settle has written since each running `tidied` function began.
_settled: list[list[str]] = []


def settle(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, lost executors cost nothing.

    narrow: rows hold a few numbers only, so an eighth of the tasks (and files) will do.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(1, partitions(spark) // 8))
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _settled:
        _settled[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(operator):
    """The operator, which deletes what it has settled once it returns, but for the tables that its result reads."""

    @wraps(operator)
    def run(*args, **named):
        _settled.append([])
        try:
            out = operator(*args, **named)
        finally:
            written = _settled.pop()
        if written:
            spark = SparkSession.active()
            files = out.inputFiles() if isinstance(out, DataFrame) else []
            read = {f.rsplit("/", 2)[-2] for f in files}
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            for path in written:
                if path.rsplit("/", 1)[-1] not in read:
                    at = jvm.org.apache.hadoop.fs.Path(path)
                    at.getFileSystem(conf).delete(at, True)
                elif _settled:
                    _settled[-1].append(path)
        return out

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_join(left: DataFrame, right: DataFrame, on, how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with a broadcast of right if it has at most so many rows (more than BROADCAST_ROWS only where they hold one number), else with a shuffle.

    right must be cheap to count (a settled table).
    """
    return left.join(F.broadcast(right) if right.limit(most + 1).count() <= most else right, on, how)


def bucket_bounds(df: DataFrame, key: str, n: int) -> tuple[list[int], list[int]]:
    """Up to n values of the integer column key that cut its range into even buckets, the least value first; and how many even shares each takes.

    Every bound is a value that occurs, so no bucket is empty. A value that many rows repeat takes several shares.
    The lists have one number per bucket and stay on the driver, as the bounds of a range partitioning do.
    """
    n = max(1, min(n, MAX_BUCKETS))
    at = [i / n for i in range(1, n)] or [0.0]
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    row = df.agg(F.min(k).alias("least"), F.percentile_approx(k, at, max(10_000, 10 * n)).alias("cuts")).first()
    if row["least"] is None:
        return [], []
    shares = Counter(row["cuts"]) | Counter([row["least"]])
    return sorted(shares), [shares[b] for b in sorted(shares)]


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Index of the last bound that key reaches. Two levels, so the work per row is the root of their number."""
    key = F.coalesce(key.cast("long"), F.lit(-(2**63)))
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.size(F.filter(F.lit(bounds[::step]), lambda b: b <= key)) - 1
    fine = F.size(F.filter(F.slice(F.lit(bounds), coarse * step + 1, F.lit(step)), lambda b: b <= key))
    return (coarse * step + fine - 1).cast("int")


def tie_bucket(key: Column, tie: Column, bucket: Column, bounds: list[int], shares: list[int]) -> Column:
    """Part of a bucket that a row belongs to: rows of a bound that takes several shares are dealt by their tie, in its order.

    Rows of the same bucket with a greater key come in the part after these; all other buckets are one part.
    """
    if max(shares) == 1:
        return F.lit(0)
    own = F.element_at(F.lit(shares), bucket + 1)
    at = F.least(F.floor((tie / F.lit(2.0**64) + 0.5) * own).cast("int"), own - 1)
    is_bound = F.coalesce(key.cast("long"), F.lit(-(2**63))) == F.element_at(F.lit(bounds), bucket + 1)
    return F.when(own == 1, 0).when(is_bound, at).otherwise(own).cast("int")
