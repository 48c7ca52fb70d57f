"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Of all rates r with sum(r * size) on target and r <= MOST, those nearest
to 1 in relative entropy are exponentially tilted, r = min(MOST, exp(lambda * size)). The multiplier of
each source solves a convex dual; Newton steps for all sources run together over the distributed
histogram of sizes (source, size, documents), which loses nothing and is far smaller than the corpus.
Rates are then rounded into whole copies by error diffusion within bounded parts of a source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, settle, sized_join, tidied

#: Weights of the sources in order, repeating; share of all words that the mix holds; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Newton steps at most, and the relative miss of a target that ends them (rounding takes out the rest).
STEPS, CLOSE = 40, 1e-5
#: Documents of one source that are rounded together.
PART = 1000


def same() -> Column:
    """A hash of what the mix knows of a row; rows that share it can take each other's copies."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), "text", F.col("source").isNull(), F.col("source").cast("string"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (of the source), same (a hash of the row) and size, the words of the text."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), same().alias("same"), size.alias("size"))


def targets(histogram: DataFrame) -> DataFrame:
    """key, source_size, longest and target of each source.

    Targets are shares by weight, but at most MOST times a source's size: with sources in order of
    size / weight, the first that the level of the rest doesn't fill ends the capped ones.
    """
    per = histogram.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.max("size").alias("longest"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    level: Column = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
    level = F.first("level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select("key", "source_size", "longest", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def rate(multiplier: Column, size: Column, longest: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(F.lit(50.0), multiplier * size / longest)))


def multipliers(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """key and multiplier of each source, by Newton steps kept within brackets.

    Where a target equals MOST times the size, the multiplier has no finite value; it is held as null.
    """
    open_ = F.col("target") < MOST * F.col("source_size")
    state = settle(goals.filter(open_).select("key", "longest", "target", F.lit(0.0).alias("m"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")), "dual", narrow=True)
    histogram = histogram.filter("size > 0")
    for _ in range(STEPS):
        r = rate(F.col("m"), F.col("size"), F.col("longest"))
        taken = F.col("docs") * F.col("size") * r
        slope = F.when(r < MOST, taken * F.col("size") / F.col("longest")).otherwise(0.0)
        own = [F.first(c).alias(c) for c in ("longest", "target", "m", "lo", "hi")]
        sums = sized_join(histogram, state, "key", "inner").groupBy("key").agg(*own, F.sum(taken).alias("taken"), F.sum(slope).alias("slope"))
        over = F.col("taken") >= F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("m")), F.when(over, F.col("m")).otherwise(F.col("hi"))
        sums = sums.withColumns({"lo": lo, "hi": hi, "step": F.when(F.col("slope") > 0, F.col("m") - (F.col("taken") - F.col("target")) / F.col("slope"))})
        inside = F.col("step").isNotNull() & F.coalesce(F.col("step") > F.col("lo"), F.lit(True)) & F.coalesce(F.col("step") < F.col("hi"), F.lit(True))
        halfway = F.coalesce((F.col("lo") + F.col("hi")) / 2, F.col("lo") * 2 + 1, F.col("hi") * 2 - 1)
        miss = F.abs(F.col("taken") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        m = F.when(miss <= CLOSE, F.col("m")).when(inside, F.col("step")).otherwise(halfway)
        state = settle(sums.select("key", "longest", "target", m.alias("m"), "lo", "hi", miss.alias("miss")), "dual", narrow=True)
        if state.filter(F.col("miss") > CLOSE).isEmpty():
            break
        state = state.drop("miss")
    return state.select("key", F.col("m").alias("multiplier"))


def settled(sizes: np.ndarray, copies: np.ndarray, owed: float) -> np.ndarray:
    """Copies after the changes, by one document or by one for another, that bring the words owed nearest to none."""
    for _ in range(len(sizes)):
        up, down = np.flatnonzero((copies < MOST) & (sizes > 0)), np.flatnonzero((copies > 0) & (sizes > 0))
        gain = np.concatenate([[0], sizes[up], -sizes[down]])
        more = np.concatenate([[-1], up, -1 * np.ones(len(down), int)])
        less = np.concatenate([[-1], -1 * np.ones(len(up), int), down])
        if len(up) and len(down):  # for each document that gains a copy, the one whose loss leaves least owed
            order = down[np.argsort(sizes[down], kind="stable")]
            at = np.searchsorted(sizes[order], sizes[up] - owed)
            for k in (np.maximum(at - 1, 0), np.minimum(at, len(order) - 1)):
                gain, more, less = np.concatenate([gain, sizes[up] - sizes[order[k]]]), np.concatenate([more, up]), np.concatenate([less, order[k]])
        best = int(np.argmin(np.abs(owed - gain)))
        if abs(owed - gain[best]) >= abs(owed) - 0.5:
            break
        copies[more[best]] += more[best] >= 0
        copies[less[best]] -= less[best] >= 0
        owed -= gain[best]
    return copies


def diffuse(part: pd.DataFrame) -> pd.DataFrame:
    """Copies of one part: large documents first, each rounded to whichever side lessens the words owed so far."""
    part = part.sort_values(["size", "doc_id", "same"], ascending=[False, True, True], kind="stable")
    owed, copies = 0.0, []
    for size, r in zip(part["size"].to_numpy().tolist(), part["rate"].to_numpy().tolist()):
        low = int(r)
        c = low if not size else min(max(round((owed + size * r) / size), low), low + (r > low))
        owed += size * (r - c)
        copies.append(c)
    copies = settled(part["size"].to_numpy(), np.array(copies, np.int64), owed)
    return pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "size": part["size"], "source_size": part["source_size"], "target": part["target"], "taken": copies * part["size"].to_numpy(), "copies": copies, "same": part["same"]})


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row.

    A null text has size 0 and is taken in whole copies like any other; a null source is a source of its
    own, the last in order; a null doc_id is an id like any other. Repeated rows are rounded each. An empty
    table gives an empty result; columns other than doc_id, source and text are ignored.
    """
    return rounded(docs).drop("same")


@tidied
def rounded(docs: DataFrame) -> DataFrame:
    """mix with the hash of each row."""
    rows = settle(sized(docs), "sized")
    histogram = settle(rows.groupBy("key", "source", "size").agg(F.count("*").alias("docs")), "sizes", narrow=True)
    goals = settle(targets(histogram).coalesce(1), "targets")
    parts = histogram.groupBy("key").agg(F.ceil(F.sum("docs") / PART).alias("parts"))
    plan = goals.join(multipliers(histogram, goals), "key", "left").join(parts, "key")
    plan = settle(plan.coalesce(1), "mix_plan")
    part = F.pmod(F.when(F.col("doc_id").isNull(), F.col("same")).otherwise(F.xxhash64("doc_id", "size")), F.col("parts")).cast("int")
    dealt = sized_join(rows, plan, "key", "inner").select(
        "key", part.alias("part"), "doc_id", "same", "size", "source_size", "target", F.coalesce(rate(F.col("multiplier"), F.col("size"), F.col("longest")), F.lit(float(MOST))).alias("rate")
    )
    return dealt.groupBy("key", "part").applyInPandas(diffuse, "doc_id bigint, size bigint, source_size bigint, target double, taken bigint, copies int, same bigint")


@tidied
def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, whether or not its doc_id is null or repeated.

    Of rows that are equal in doc_id, text and source any may take the copies of another. Rows without a source
    are a source of their own; a null text has no words and is taken in whole copies like any other; an empty
    table gives an empty one. All columns stay as they are.
    """
    up_to = [F.sum((F.col("copies") >= k).cast("int")) for k in range(1, MOST + 1)]
    copies = rounded(docs).groupBy("same").agg(F.count("*").alias("__rows"), F.array(*up_to).alias("__up_to"))
    copies = settle(copies.withColumnRenamed("same", "__same"), "copies")
    rows, repeated = docs.withColumn("__same", same()), copies.filter("__rows > 1")
    taken = sized_join(rows, copies.filter("__rows = 1"), "__same", "inner").withColumn("__rank", F.lit(1))
    if not repeated.isEmpty():
        rank = F.row_number().over(Window.partitionBy("__same").orderBy("__rows"))
        taken = taken.unionByName(sized_join(rows, repeated, "__same", "inner").withColumn("__rank", rank))
    times = F.size(F.filter("__up_to", lambda n: n >= F.col("__rank")))
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias("__copy")).drop("__copy")
