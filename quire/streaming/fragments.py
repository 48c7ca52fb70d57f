"""Fragments of calls, put together by call and index, in a batch or as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["call", "index"]
JOINED = "call string, index bigint, id string, name string, arguments string, fragments bigint, done boolean"


def together(fragments: DataFrame) -> DataFrame:
    """call, index, id, name, arguments, fragments of fragments (call, index, seq, id, name, arguments): the batch form.

    The last id that is neither null nor empty and the last such name count; arguments are joined in the order of seq.
    """

    def last(c: str) -> Column:
        return F.coalesce(F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("seq"))), F.lit(""))

    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("x")))), lambda p: p["x"])
    rows = fragments.withColumn("index", F.coalesce("index", F.lit(0)).cast("bigint"))
    return rows.groupBy(*KEYS).agg(last("id").alias("id"), last("name").alias("name"), F.array_join(parts, "").alias("arguments"), F.count("*").alias("fragments"))


def accumulated(fragments: DataFrame, idle: str = "1 minute", idle_ms: int = 60_000) -> DataFrame:
    """The same as a stream of fragments with a time (at), in update mode: a row per call and index that a batch has touched, with all that arrived so far.

    Fragments of one batch are taken in the order of seq, batches in theirs. Once the watermark (the latest time less idle) is
    idle_ms past the last fragment of a call, it is given once more with done and its state is dropped, so state is
    bounded by the calls that are open.
    """

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        id_, name, arguments, count = state.get if state.exists else ("", "", "", 0)
        done = state.hasTimedOut
        if done:
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for new_id, new_name, part in zip(rows["id"], rows["name"], rows["arguments"]):
                id_, name, arguments = new_id or id_, new_name or name, arguments + (part or "")
            count += len(rows)
            state.update((id_, name, arguments, count))
            state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([(*key, id_, name, arguments, count, done)], columns=[c.split()[0] for c in JOINED.split(", ")])

    rows = fragments.select("call", F.coalesce("index", F.lit(0)).cast("bigint").alias("index"), "seq", "at", "id", "name", "arguments").withWatermark("at", idle)
    return rows.groupBy(*KEYS).applyInPandasWithState(add, JOINED, "id string, name string, arguments string, count bigint", "update", GroupStateTimeout.EventTimeTimeout)
