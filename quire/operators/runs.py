"""Parse runs: costs, scorecards, comparisons and overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def cost_by_label(calls: DataFrame) -> DataFrame:
    """label, calls, seconds, cost, cost_known (no cost is missing)."""
    return calls.groupBy("label").agg(
        F.count("*").alias("calls"), F.round(F.sum("seconds"), 2).alias("seconds"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 2).alias("cost"), F.expr("bool_and(cost is not null)").alias("cost_known")
    )


def scorecard(blocks: DataFrame, pages: DataFrame, section_blocks: DataFrame) -> DataFrame:
    """Per run: pages, blocks, tables, mean and least recall, coverage of blocks by pages, boxes and sections, unique ids, dangling ones.

    blocks: run, page_id, block_id, type, bbox; pages: run, page_id, text_recall, extra_ratio; section_blocks: run, block_id.
    Coverage is 1 where there is nothing to cover.
    """
    held = blocks.join(pages.select("run", "page_id", F.lit(1).alias("held")), ["run", "page_id"], "left")
    b = held.groupBy("run").agg(
        F.count("*").alias("block_count"),
        F.sum((F.col("type") == "table").cast("int")).alias("table_count"),
        F.count("held").alias("placed"),
        F.count("bbox").alias("boxed"),
        (F.count("block_id") == F.count_distinct("block_id")).alias("unique_ids"),
    )
    p = pages.groupBy("run").agg(F.count("*").alias("page_count"), T.exact_mean(F.col("text_recall")).alias("text_recall_avg"), F.round(F.min("text_recall"), 3).alias("text_recall_min"), T.exact_mean(F.col("extra_ratio")).alias("extra_ratio_avg"))
    s = section_blocks.join(blocks.select("run", "block_id", F.lit(1).alias("found")).distinct(), ["run", "block_id"], "left").groupBy("run").agg(F.count("*").alias("refs"), F.count("found").alias("sound"))
    rows = p.join(b, "run", "left").join(s, "run", "left").na.fill(0, ["block_count", "table_count", "placed", "boxed", "refs", "sound"])
    c = F.col
    return rows.select(
        "run", "page_count", "block_count", "table_count", "text_recall_avg", "text_recall_min", "extra_ratio_avg",
        F.round(T.share(c("placed"), c("block_count")), 3).alias("block_page_coverage"),
        F.round(T.share(c("boxed"), c("block_count")), 3).alias("bbox_coverage"),
        F.round(T.share(c("sound"), c("refs")), 3).alias("section_block_coverage"),
        (F.coalesce("unique_ids", F.lit(True))).alias("unique_ids"),
        (c("refs") - c("sound")).alias("dangling_refs"),
    )


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Upsert: the newest row of each key, with first_at the oldest row's time."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("first_at", F.min(at).over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc(at)))).filter("__n = 1").drop("__n")


def overview(runs: DataFrame) -> DataFrame:
    """doc, runs (newest first) and the union of their page numbers. runs: doc, run, started_at, page_no."""
    per = runs.groupBy("doc", "run").agg(F.max("started_at").alias("started_at"), F.collect_set("page_no").alias("p"))
    newest = F.transform(F.sort_array(F.collect_list(F.struct("started_at", "run")), False), lambda x: x["run"]).alias("runs")
    return per.groupBy("doc").agg(newest, F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("page_numbers"))


def patched(rows: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of patch where these are not null."""
    names = [c for c in patch.columns if c not in keys]
    joined = rows.join(patch.select(*keys, *[F.col(c).alias(f"__{c}") for c in names]), keys, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in names}).drop(*[f"__{c}" for c in names])


def page_selection(wanted: DataFrame) -> DataFrame:
    """id, page, place: pages named by `pages` ('all', '1-3,5', reverse ranges), first mention kept, within 1..page_count."""
    rows = wanted.select("id", "page_count", F.posexplode(F.split(F.regexp_replace(F.when(F.col("pages") == "all", F.concat(F.lit("1-"), "page_count")).otherwise(F.col("pages")), r"\s", ""), ",")).alias("k", "part"))
    a, b = F.split_part("part", F.lit("-"), F.lit(1)).try_cast("int"), F.coalesce(F.nullif(F.split_part("part", F.lit("-"), F.lit(2)), F.lit("")), F.split_part("part", F.lit("-"), F.lit(1))).try_cast("int")
    rows = rows.select("id", "page_count", "k", a.alias("a"), b.alias("b")).filter("a is not null and b is not null")
    pages = rows.select("id", "page_count", "k", F.posexplode(F.sequence("a", "b")).alias("i", "page")).filter("page between 1 and page_count")
    first = pages.groupBy("id", "page").agg(F.min(F.struct("k", "i")).alias("at"))
    return first.select("id", "page", F.row_number().over(Window.partitionBy("id").orderBy("at")).alias("place"))


def measured(rows: DataFrame, stage: str, folder: str, /, **metrics: Column) -> tuple[DataFrame, Observation]:
    """rows written to folder and read back, and what was observed of them on the way: metrics are aggregates, taken in the same pass."""
    seen = Observation(stage)
    rows.observe(seen, *[value.alias(name) for name, value in metrics.items()]).write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder), seen


def progress_report(spark: SparkSession, run: str, stages: list[Observation]) -> DataFrame:
    """run, place, stage, metric, value: one row for each metric of each stage that ended, to be written beside the run's scorecard."""
    rows = [(run, place, seen._name, name, float(value or 0)) for place, seen in enumerate(stages) for name, value in seen.get.items()]
    return spark.createDataFrame(rows, "run string, place int, stage string, metric string, value double")
