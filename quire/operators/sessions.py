"""Agent sessions and import logs: ordered replays, first and last values, sequences, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Messages that a replay holds (the oldest), and characters of a session's title.
REPLAY, TITLE = 40, 120


def sequenced(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """log with idx_seq, the place of each row in its import from 0."""
    return log.withColumn("idx_seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def replay(messages: DataFrame) -> DataFrame:
    """The first REPLAY messages of each session in order; of these, rows of hidden kinds only if a user wrote them."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return messages.withColumn("place", place).filter(F.col("place") <= REPLAY).filter((F.col("role") == "user") | (F.col("role") != "system"))


def titles(messages: DataFrame) -> DataFrame:
    """conv_id, title: the first line of the first user message, cut."""
    users = messages.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return users.select("conv_id", F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, TITLE).alias("title"))


def last_answers(messages: DataFrame) -> DataFrame:
    """conv_id, text of the last assistant message that is not empty."""
    return messages.filter("role = 'assistant' and trim(text) <> ''").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def progress(log: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """The last value of each import."""
    return log.groupBy(key).agg(F.max_by(value, at).alias(value))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one of two snapshots holds more often than the other, with the side that does."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))
