"""Nested parse documents: schema, reader, and the rows and graph within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: One JSON document per run; never inferred.
SCHEMA = """document STRUCT<id: STRING, filename: STRING, sha256: STRING, page_count: INT>,
parse_run STRUCT<id: STRING, profile_name: STRING, provider: STRING, model: STRING, started_at: STRING, duration_ms: BIGINT, cost_usd: DOUBLE>,
pages ARRAY<STRUCT<id: STRING, page_number: INT, width: DOUBLE, height: DOUBLE, rotation: INT, metadata: STRUCT<source_text: STRING>,
  blocks: ARRAY<STRUCT<id: STRING, page_id: STRING, type: STRING, text: STRING, markdown: STRING, level: INT, bbox: ARRAY<DOUBLE>, confidence: DOUBLE, reading_order: INT>>>>,
sections ARRAY<STRUCT<id: STRING, title: STRING, heading_path: ARRAY<STRING>, level: INT, page_start: INT, page_end: INT, block_ids: ARRAY<STRING>, markdown: STRING>>,
assets ARRAY<STRUCT<id: STRING, type: STRING, page_id: STRING, path: STRING, mime_type: STRING>>,
warnings ARRAY<STRUCT<code: STRING, severity: STRING, message: STRING, page_number: INT, block_id: STRING>>"""


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All canonical.json files below a folder."""
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "canonical.json").option("multiLine", True).json(folder)


def _each(docs: DataFrame, rows: Column, name: str) -> DataFrame:
    """run and name, one row for each of rows. Not by explode, for which Spark asks first whether rows has any and so makes them twice."""
    return docs.select("run", F.posexplode_outer(rows).alias("at", name)).filter("at is not null").drop("at")


def pages(docs: DataFrame) -> DataFrame:
    """run, page_id, page_number, source_text, markdown: blocks in reading order, joined by an empty line."""
    rows = _each(docs.select(F.col("parse_run.id").alias("run"), "pages"), F.col("pages"), "p")
    shown = F.transform(F.array_sort(F.transform("p.blocks", lambda b: F.struct(F.coalesce(b["reading_order"], F.lit(0)).alias("o"), F.coalesce(F.nullif(T.strip(b["markdown"]), F.lit("")), T.strip(b["text"]), F.lit("")).alias("x")))), lambda b: b["x"])
    return rows.select("run", F.col("p.id").alias("page_id"), "p.page_number", F.col("p.metadata.source_text").alias("source_text"), F.array_join(F.filter(shown, lambda x: x != ""), "\n\n").alias("markdown"))


def blocks(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("parse_run.id").alias("run"), F.explode("pages").alias("p")).select("run", F.explode("p.blocks").alias("b")).select("run", F.col("b.id").alias("block_id"), "b.page_id", "b.type", "b.text", "b.markdown", "b.level", "b.bbox", "b.reading_order")


def section_blocks(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("parse_run.id").alias("run"), F.explode("sections").alias("s")).select("run", F.col("s.id").alias("section_id"), F.explode("s.block_ids").alias("block_id"))


def graph(docs: DataFrame) -> DataFrame:
    """run, edge_id, type, source, target: documents to pages, pages to blocks, blocks to sections, sections to tables.

    Ids are made of the run and the ends, so loading twice gives the same rows. Section refs without a block are left out.
    Documents that are loaded again go before anything is made of them. Then blocks meet the refs to them in one window by
    run and block, which leaves each edge once; rows that no ref meets (of pages, of a null run or block) have windows by both ends.
    """
    c, page_end, block_end, ref_end = F.col, F.lit(0), F.lit(1), F.lit(2)
    held = lambda rows, kind: F.coalesce(rows, F.array().cast(f"array<{kind}>"))
    blocks_of = lambda p: held(F.transform(p["blocks"], lambda b: F.struct(b["id"].alias("id"), b["page_id"].alias("page_id"), (b["type"] == "table").alias("is_table"))), "struct<id:string,page_id:string,is_table:boolean>")
    loaded = docs.select(
        c("parse_run.id").alias("run"), c("document.id").alias("doc"), c("pages.id").alias("pages"), F.flatten(F.transform("pages", blocks_of)).alias("blocks"),
        F.transform("sections", lambda s: F.struct(s["id"].alias("id"), held(s["block_ids"], "string").alias("block_ids"))).alias("sections"),
    ).distinct()

    def end(kind, target, other, is_table=F.lit(False)):
        return F.struct(kind.alias("kind"), target.alias("target"), other.alias("other"), is_table.alias("is_table"))

    of_pages = F.transform("pages", lambda p: end(page_end, p, c("doc")))
    of_blocks = F.transform("blocks", lambda b: end(block_end, b["id"], b["page_id"], F.coalesce(b["is_table"], F.lit(False))))
    of_refs = F.flatten(F.transform("sections", lambda s: F.transform(s["block_ids"], lambda b: end(ref_end, b, s["id"]))))
    every = F.concat(*[held(x, "struct<kind:int,target:string,other:string,is_table:boolean>") for x in (of_pages, of_blocks, of_refs)])
    rows = _each(loaded, every, "end").select("run", "end.*")
    apart = (c("kind") == page_end) | c("run").isNull() | c("target").isNull()
    rows = rows.filter(~(apart & (c("kind") == ref_end))).withColumns({"of_page": c("kind") == page_end, "apart": F.when(apart, c("other"))})
    # in order, a row that says again what the one before says goes, and blocks come before refs
    ends = Window.partitionBy("run", "of_page", "target", "apart").orderBy("kind", "other")
    again, all_ends = F.struct("kind", "other").eqNullSafe(F.lag(F.struct("kind", "other")).over(ends)), ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = rows.withColumns({"again": again, "there": F.min("kind").over(all_ends) == block_end, "holds_table": F.max("is_table").over(all_ends)}).filter(~c("again"))

    def edge(name, source, target):
        return F.struct(F.lit(name).alias("type"), c(source).alias("source"), c(target).alias("target"))

    part, table = edge("BLOCK_PART_OF_SECTION", "target", "other"), edge("SECTION_HAS_TABLE", "other", "target")
    found = (
        F.when(c("kind") == page_end, F.array(edge("DOCUMENT_HAS_PAGE", "other", "target"))).when(c("kind") == block_end, F.array(edge("PAGE_HAS_BLOCK", "other", "target")))
        .when(c("there") & c("holds_table"), F.array(part, table)).when(c("there"), F.array(part))
    )
    edges = met.select("run", F.explode(found).alias("edge")).select("run", "edge.*")
    return edges.select("run", F.concat_ws(":", "run", F.lit("edge"), "type", "source", "target").alias("edge_id"), "type", "source", "target")
