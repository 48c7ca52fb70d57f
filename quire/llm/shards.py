"""Sharding by fixed virtual slots: records hash into thousands of slots, and a versioned map gives slots to shards.

The number of slots never changes, so a record's slot is fixed for good. Bytes are summed per slot, and only the
small map (one row per slot) is made, kept and edited. Its versions are folders of one table in shared storage:
version 0 deals slots in turn before any data is known, and each rebalancing writes the next one, in which
shards above their share give slots away; records of all other slots stay where they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import settle, shared_dir, tidied

#: Virtual slots. Fixed: a change would move every record.
SLOTS = 8192
#: Bytes that each record costs beside its text.
OVERHEAD = 8
#: A slot is crowded from this many times the mean of rows on (and from this many rows on).
CROWDED = 16


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot per row, by a hash of doc_id, size and checksum. A null text has no bytes and the checksum of none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(SLOTS)).cast("int"))


def spread(rows: DataFrame) -> DataFrame:
    """rows (with their place, at) whose slots hold CROWDED times the mean are dealt again, by their place too.

    Only rows that repeat id, size and checksum can fill a slot so; which of them lies where makes no difference.
    """
    full = rows.groupBy("virtual_slot").agg(F.count("*").alias("n"))
    mean = F.sum("n").over(Window.partitionBy(F.lit(0))) / SLOTS  # one row a slot
    full = full.withColumn("mean", mean).filter((F.col("n") > CROWDED * F.col("mean")) & (F.col("n") > CROWDED)).select("virtual_slot", F.lit(True).alias("full"))
    again = F.pmod(F.xxhash64("virtual_slot", "at"), F.lit(SLOTS)).cast("int")
    return rows.join(F.broadcast(full), "virtual_slot", "left").withColumn("virtual_slot", F.when(F.col("full"), again).otherwise(F.col("virtual_slot"))).drop("full", "at")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot: at most SLOTS rows, summed before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(spark: SparkSession, shards: int) -> DataFrame:
    """Version 0 of the map: slots to shards in turn."""
    return spark.range(SLOTS).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def save(slot_map: DataFrame, folder: str) -> None:
    """Writes a version of the map beside those before it; a version that is there already fails."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(folder)


def latest(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The last version of the map in a folder, or the given one."""
    versions = spark.read.parquet(folder)
    at = version if version is not None else versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == at).select(F.col("version").cast("int").alias("version"), "virtual_slot", "shard")


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, in which bytes are near equal.

    Each shard keeps its largest slots up to an even share; the others, largest first, go each to the shard
    that holds least by then. That fold runs over one array of at most SLOTS entries.
    """
    full = slot_map.join(sizes.select("virtual_slot", "bytes"), "virtual_slot", "left").na.fill(0, ["bytes"])
    share = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards
    held = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    full = full.withColumn("stays", held <= share)
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at("kept", i), F.lit(0).cast("long")))
    per = full.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("kept")).select(loads.alias("loads"))
    moving = full.filter(~F.col("stays")).agg(F.sort_array(F.collect_list(F.struct("bytes", (-F.col("virtual_slot")).alias("key"))), False).alias("slots"))
    moved = moving.join(F.broadcast(per), F.lit(True)).select(
        "slots",
        F.expr(
            """aggregate(slots, named_struct('loads', loads, 'shards', cast(array() as array<int>)),
            (a, x) -> named_struct(
              'loads', transform(a.loads, (v, i) -> if(i = array_position(a.loads, array_min(a.loads)) - 1, v + x.bytes, v)),
              'shards', concat(a.shards, array(cast(array_position(a.loads, array_min(a.loads)) - 1 as int)))),
            a -> a.shards)"""
        ).alias("shards"),
    )
    moved = moved.select(F.explode(F.arrays_zip("slots", "shards")).alias("z")).select((-F.col("z.slots.key")).alias("virtual_slot"), F.col("z.shards").alias("to"))
    return full.join(moved, "virtual_slot", "left").select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to", "shard").alias("shard"))


def add_shard(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map with one more shard, which takes slots up to an even share; no other slot moves.

    Of each old shard the smallest slots move while their bytes stay within its excess.
    """
    version = F.max("version").over(Window.partitionBy(F.lit(0)))
    with_bytes = slot_map.join(sizes, "virtual_slot", "left").na.fill(0, ["bytes"])
    w = Window.partitionBy("shard")
    moved = F.sum("bytes").over(w.orderBy("bytes", "virtual_slot")) <= F.sum("bytes").over(w) / (shards + 1)
    return with_bytes.select((version + 1).alias("version"), "virtual_slot", F.when(moved, F.lit(shards)).otherwise(F.col("shard")).alias("shard"))


def place(rows: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows with shard and slot, the gapless position in the shard.

    A position is the rows in the shard's slots before (from the small table of slots) plus the row's rank
    in its own virtual slot, so no window spans a shard.
    """
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = slot_map.join(sizes, "virtual_slot").select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("rank", rank)
    return ranked.join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("start") + F.col("rank")).drop("start", "rank")


@tidied
def shard_documents(docs: DataFrame, shards: int = 24, folder: str | None = None) -> DataFrame:
    """All rows of docs with their shard under the law `bytes`.

    The map's last version in folder is rebalanced by these rows' bytes and written there as the next one; without
    a folder, a new one in the shared folder starts with version 0. Repeated rows are placed each; an empty
    table gives an empty result; rows without a doc_id are dealt by their texts; columns other than doc_id and
    text are ignored.
    """
    spark = docs.sparkSession
    rows = settle(spread(settle(records(docs).withColumn("at", F.monotonically_increasing_id()), "records")), "spread")
    sizes = settle(slot_sizes(rows).coalesce(1), "slot_sizes")
    if folder is None:
        folder = f"{shared_dir(spark)}/slot_map-{uuid.uuid4().hex}"
        save(first_map(spark, shards), folder)
    save(rebalanced(latest(spark, folder), sizes, shards), folder)
    return place(rows, latest(spark, folder), sizes).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
