"""Whole input tables, and views of them in the shape of pages, sections, trees, runs and calls.

The input holds no markdown structure of its own, so views add it by expressions that SQL states as well
(`quire.plans.views`). A source is one document, and its texts in doc_id order are the pages, so a document may
hold a third of all rows; a nation is one tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import segments


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page_no, doc_id, without texts: a source's documents are the pages of one doc, numbered by doc_id, which is a key."""
    rows = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("doc"), F.col("doc_id").cast("bigint").alias("doc_id"))
    return segments.numbered(rows, "doc", "doc_id", "page_no")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, truth, doc, page_no: pages are numbered without their texts, which are joined on by doc_id."""
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("truth")).join(numbers(spark, sf_dir), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page_no, doc_id, kind, truth and three candidate transcriptions, some of them missing.

    Texts are dealt by page: whatever then groups or orders the lines or tokens of a page finds them in one partition, so
    these never cross the network.
    """
    c = F.col
    rows = page_texts(spark, sf_dir).repartition("doc", "page_no")
    half = F.substring("truth", F.lit(1), F.expr("cast(length(truth) div 2 as int)"))
    return rows.select(
        "doc", "page_no", "doc_id",
        F.when(c("doc_id") % 10 == 0, "visual").otherwise("text").alias("kind"),
        "truth",
        F.when(c("doc_id") % 4 == 0, half).otherwise(F.concat(F.replace("truth", F.lit(" of "), F.lit(" ")), F.lit(" zzz"))).alias("baseline"),
        F.when(c("doc_id") % 6 != 0, F.concat("truth", F.lit("\nzz yy xx"))).alias("cleanup"),
        F.when(c("doc_id") % 5 == 0, "").when(c("doc_id") % 3 != 0, c("truth")).alias("vlm"),
        F.when(c("doc_id") % 7 != 0, (c("doc_id") % 6) / 5.0).alias("judge_score"),
    )


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page_no, markdown: pages under numbered headings, the first of each three a chapter, some demoted or repeated."""
    p = pages(spark, sf_dir)
    chapter = F.expr("cast((page_no - 1) div 3 + 1 as string)")
    head = (
        F.when(F.col("page_no") % 3 == 1, F.concat(F.lit("# **"), chapter, F.lit(". Chapter**")))
        .when(F.col("page_no") % 3 == 2, F.concat(F.lit("## "), chapter, F.lit(".1 Part")))
        .when(F.col("page_no") % 2 == 0, F.concat(F.lit("# 1. Notes "), F.col("page_no").cast("string")))
        .otherwise(F.lit("### Remarks"))
    )
    return p.select("doc", "page_no", F.concat(head, F.lit("\n"), "truth").alias("markdown"))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, markdown: each customer's orders as a table, some without separator, ragged or within a fence."""
    o = read(spark, sf_dir, "orders")
    cells = F.concat(F.lit("|"), F.col("o_orderkey").cast("string"), F.lit("|"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 7 == 0, "|").otherwise(F.concat(F.lit("|"), "o_orderpriority", F.lit("|"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", cells.alias("x")))), lambda v: v["x"]), "\n")
    rows = o.groupBy(F.col("o_custkey").alias("key")).agg(body.alias("body"))
    head = F.concat(F.when(F.col("key") % 11 == 0, "```\n").otherwise(""), F.lit("Orders\n|key|status|priority|\n"), F.when(F.col("key") % 3 != 0, "|---|---|---|\n").otherwise(""))
    return rows.select("key", F.concat(head, "body", F.when(F.col("key") % 5 == 0, "\n\n|alone|\nend").otherwise("")).alias("markdown"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, id, parent, title, sort_order, include: segments of a nation's customers, these, and their orders."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    doc = F.col("c_nationkey").cast("bigint").alias("doc")
    seg = F.concat(F.lit("s:"), "c_mktsegment")
    cust = F.concat(F.lit("c:"), F.col("c_custkey").cast("string"))
    zero = F.lit(0).cast("bigint").alias("sort_order")
    top = c.select(doc, seg.alias("id"), F.lit(None).cast("string").alias("parent"), F.col("c_mktsegment").alias("title"), zero, F.lit(True).alias("include")).distinct()
    mid = c.select(doc, cust.alias("id"), seg.alias("parent"), F.col("c_mktsegment").alias("title"), (F.col("c_custkey") % 4).alias("sort_order"), (F.col("c_custkey") % 3 != 0).alias("include"))
    leaf = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        doc, F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), cust.alias("parent"), F.col("o_orderpriority").alias("title"), zero, (F.col("o_orderkey") % 2 == 0).alias("include")
    )
    return top.unionByName(mid).unionByName(leaf)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, id, parent, page_start, page_end, lft, rgt, doc_id (of the first page) and section_type, without texts.

    Chapters of four pages, each with two halves; a second half goes on over the first page of the next chapter. Every
    span has its first page, so spans follow from the numbers of the pages alone.
    """
    first = F.col("page_no")
    k, late = F.floor((first - 1) / 4), (first % 4 == 3).cast("bigint")
    half = F.struct(F.concat(F.lit("h"), first.cast("string")).alias("id"), F.concat(F.lit("c"), k.cast("string")).alias("parent"), first.alias("page_start"), (first + 1 + late).alias("page_end"), (6 * k + 2 + 2 * late).alias("lft"), (6 * k + 3 + 2 * late).alias("rgt"))
    chapter = F.struct(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), first.alias("page_start"), (first + 3).alias("page_end"), (6 * k + 1).alias("lft"), (6 * k + 6).alias("rgt"))
    own = F.explode(F.when(first % 4 == 1, F.array(chapter, half)).otherwise(F.array(half)))
    rows = numbers(spark, sf_dir).filter("page_no % 2 = 1").select("doc", "doc_id", own.alias("span"))
    kind = F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.concat(F.lit("type"), (F.col("doc_id") % 3).cast("string")))
    return rows.select("doc", "span.*", "doc_id", kind.alias("section_type"))


def span_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans with markdown: the texts of all pages of each, in order, and mentions of pages. Each text goes from its number to the spans of its page, once."""
    own, page = spans(spark, sf_dir), F.col("page_no")
    j, s = F.floor((page - 1) / 4), 2 * F.floor((page - 1) / 2) + 1
    name = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
    held = F.array(name("c", j), name("h", s))
    rows = page_texts(spark, sf_dir).select("doc", page, "truth", F.explode(F.when((page % 4 == 1) & (page > 1), F.array_append(held, name("h", page - 2))).otherwise(held)).alias("id"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "truth"))), lambda x: x["truth"]), "\n")
    texts = rows.groupBy("doc", "id").agg(body.alias("truth"))
    text = F.concat("truth", F.lit(" See page "), (1 + F.col("doc_id") * 7 % 60).cast("string"), F.lit(", and p. 4; refer to Page No. 12."))
    return own.join(texts, ["doc", "id"]).withColumn("markdown", text).drop("doc_id", "truth")


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers(spark, sf_dir).groupBy("doc").agg(F.max("page_no").alias("page_count"))
