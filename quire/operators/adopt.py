"""Choice among candidate transcriptions of a page, and page-level merges of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: Recall that a cleanup may lose against the baseline.
TOLERANCE = 0.12


def winner(base: Column, base_recall: Column, cleanup: Column, cleanup_recall: Column, image: Column, kind: Column) -> Column:
    """vlm if its composite beats the baseline's and is not below an eligible cleanup's; else that cleanup; else baseline.

    A cleanup is eligible on text pages if it keeps recall within the tolerance.
    """
    image_ok = F.coalesce(image > base, F.lit(False))
    cleanup_ok = F.coalesce((kind == "text") & cleanup.isNotNull() & (cleanup_recall >= base_recall - TOLERANCE), F.lit(False))
    return F.when(image_ok & (~cleanup_ok | (image >= cleanup)), "vlm").when(cleanup_ok, "cleanup").otherwise("baseline")


def routed(kind: Column, base_recall: Column) -> Column:
    """Which parse a page goes to under the older rule: vlm for visual pages and those of low recall, else cleanup."""
    return F.when((kind == "visual") | (base_recall < 0.85), "vlm").otherwise("cleanup")


def routed_adopted(method: Column, base: Column, base_recall: Column, new: Column, new_recall: Column) -> Column:
    """Whether the routed parse takes the baseline's place: a cleanup by recall within the tolerance, a vlm by a higher composite."""
    keeps = F.when(method == "cleanup", new_recall >= base_recall - TOLERANCE).otherwise(new > base)
    return F.coalesce(keeps, F.lit(False))


def kept_best(verdict: Column, old: Column, new: Column) -> Column:
    """Whether an escalated page's parse is kept: of pages without the verdict pass, where its composite is higher."""
    return F.coalesce(~verdict.eqNullSafe("pass") & (new > old), F.lit(False))


def flagged(pages: DataFrame) -> DataFrame:
    """Pages without the verdict pass; a missing verdict counts as flagged."""
    return pages.filter(~F.col("verdict").eqNullSafe("pass"))


def document_means(pages: DataFrame, canonical: str, baseline: str) -> DataFrame:
    """doc, mean of the adopted score, else the baseline's, to three digits."""
    return pages.groupBy("doc").agg(T.exact_mean(F.coalesce(canonical, baseline)).alias("canonical_mean"))


def escalation_reasons(recall: Column, extra: Column, table: Column, least_recall: float = 0.95, most_extra: float = 0.15) -> Column:
    """Codes of the reasons to parse a page again; none means that it stays."""
    return F.array_compact(F.array(F.when(recall < least_recall, F.lit("text_recall")), F.when(extra > most_extra, F.lit("extra_text_ratio")), F.when(table < 1, F.lit("table_score"))))


def improves(local: dict[str, Column], cloud: dict[str, Column], least_recall: float = 0.95, most_extra: float = 0.15) -> Column:
    """Whether the cloud's page takes the local one's place; keys recall, extra, table, each with its own null default."""
    lr, cr = F.coalesce(local["recall"], F.lit(1.0)), F.coalesce(cloud["recall"], F.lit(0.0))
    le, ce = F.coalesce(local["extra"], F.lit(0.0)), F.coalesce(cloud["extra"], F.lit(1.0))
    lt, ct = F.coalesce(local["table"], F.lit(1.0)), F.coalesce(cloud["table"], F.lit(1.0))
    worse = (cr < F.least(F.lit(least_recall), lr)) | (ct < lt)
    return ~worse & (((cr > lr) & (ce <= F.greatest(le, F.lit(most_extra)))) | ((ce < le) & (cr >= least_recall)))


def hybrid(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """Pages of the local run (doc, page_no, markdown, recall, extra, tbl) with cloud pages where these improve them."""
    names = ["markdown", "recall", "extra", "tbl"]
    other = cloud.select("doc", "page_no", *[F.col(c).alias(f"c_{c}") for c in names], F.lit(True).alias("asked"))
    rows = local.join(other, ["doc", "page_no"], "left")
    side = lambda p: {"recall": F.col(f"{p}recall"), "extra": F.col(f"{p}extra"), "table": F.col(f"{p}tbl")}
    take = F.coalesce("asked", F.lit(False)) & improves(side(""), side("c_"))
    return rows.withColumn("take", take).select(
        "doc", "page_no", *[F.when(F.col("take"), F.col(f"c_{c}")).otherwise(F.col(c)).alias(c) for c in names], F.when(F.col("take"), "cloud").otherwise("local").alias("provenance")
    )


def merged_warnings(local: DataFrame, cloud: DataFrame, taken: DataFrame) -> DataFrame:
    """Local warnings of pages not taken (and of no page), and all of the cloud's."""
    return local.join(taken.select("doc", "page_no"), ["doc", "page_no"], "left_anti").unionByName(cloud)


def worst(pages: DataFrame, n: int) -> DataFrame:
    """The n flagged pages of each document with the lowest composite."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc").orderBy("composite", "page_no"))
    return flagged(pages).withColumn("place", place).filter(F.col("place") <= n)


def sampled(pages: DataFrame, size: int) -> DataFrame:
    """Every k-th page of a document from its first, k = max(1, pages div size)."""
    n = pages.groupBy("doc").agg(F.count("*").alias("n"))
    return pages.join(n, "doc").filter(F.expr(f"(page_no - 1) % greatest(1, n div {size}) = 0")).drop("n")
