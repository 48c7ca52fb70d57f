"""Markdown pages to a section tree, as scans over a document's lines in order, segment by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import segments

#: Deepest level that headings and numbering give; an outline may give deeper ones.
DEEPEST = 6


def _lines(pages: DataFrame) -> DataFrame:
    return pages.select("doc", "page_no", T.lines(F.coalesce("markdown", F.lit(""))).alias("lines"), F.floor(F.col("page_no") / segments.PAGES).alias("segment"))


def heading_counts(pages: DataFrame) -> DataFrame:
    """doc, segment (a range of pages), and how many lines (pos) and headings (section) it has."""
    heads = F.size(F.filter("lines", lambda x: x.rlike(T.HEADING)))
    return _lines(pages).groupBy("doc", "segment").agg(F.sum(F.size("lines")).alias("pos"), F.sum(heads).alias("section"))


def headed_lines(pages: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Lines of pages (doc, page_no, markdown) with their place in the document and, for headings, marks and title.

    Lines are numbered within ranges of pages, which go on from the counts of the ranges before (heading_counts, if they are at hand).
    """
    starts = segments.carried(heading_counts(pages) if counts is None else counts, ["doc"], "segment", pos="sum", section="sum")
    rows = _lines(pages).select("doc", "page_no", "segment", F.posexplode("lines").alias("line_no", "line"))
    order = Window.partitionBy("doc", "segment").orderBy("page_no", "line_no")
    heading = F.col("line").rlike(T.HEADING)
    rows = rows.withColumns({"__pos": F.row_number().over(order), "__section": F.sum(heading.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.join(starts, ["doc", "segment"]).select(
        "doc", "page_no", "line_no", "line", (F.col("pos") + F.col("__pos")).alias("pos"),
        F.when(heading, F.length(F.regexp_extract("line", T.HEADING, 1))).alias("marks"),
        F.when(heading, T.clean_title(F.regexp_extract("line", T.HEADING, 2))).alias("title"),
        (F.col("section") + F.col("__section")).alias("section"),
    )


def headings(pages: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """doc, pos, section, page_start, title, marks of the headings, written, for the scans that follow read them more than once."""
    rows = headed_lines(pages, counts).filter("title is not null")
    return segments.settle(rows.select("doc", "pos", "section", F.col("page_no").alias("page_start"), "title", "marks"), "headings")


def _segment() -> Column:
    return F.floor(F.col("pos") / segments.ROWS)


def levels(headings: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """headings (doc, pos, title, marks) with level: outline, else numbering, else marks; repeated chapters go down to 2.

    A numbered level-1 title is demoted if it looks like a list item or its number does not exceed that of
    every chapter before it: the highest one is handed on from segment to segment.
    """
    level = T.number_level(F.col("title"), F.col("marks"))
    if outline is not None:
        known = outline.select("doc", T.title_form(F.col("title")).alias("form"), F.col("level").alias("outline_level")).dropDuplicates(["doc", "form"])
        headings = headings.withColumn("form", T.title_form(F.col("title"))).join(known, ["doc", "form"], "left").drop("form")
        level = F.coalesce("outline_level", level)
    rows = headings.withColumn("level", level.cast("int")).withColumn("chapter", F.when(F.col("level") == 1, T.chapter(F.col("title"))))
    fair = F.when(F.col("chapter").isNotNull() & ~T.looks_like_list_item(F.col("title")), F.col("chapter"))
    rows = segments.running(rows, ["doc"], ["pos"], _segment(), highest=("max", fair, False))
    accepted = fair.isNotNull() & (F.col("chapter") > F.coalesce("highest", F.lit(0)))
    return rows.withColumn("level", F.when(F.col("chapter").isNotNull() & ~accepted, 2).otherwise(F.col("level"))).drop("chapter", "highest")


def paths(headings: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """headings with path, the titles of the live ancestors and their own.

    The last heading of each level k < own level counts if it stands after the last of every level above k; each
    segment hands on the last heading of each level.
    """
    last = {f"last{k}": ("last", F.when(F.col("level") == k, F.struct("pos", "title")), False) for k in range(1, deepest)}
    rows = segments.running(headings, ["doc"], ["pos"], _segment(), **last)
    parts, above = [], F.lit(0)
    for k in range(1, deepest):
        here = F.col(f"last{k}.pos")
        parts.append(F.when((F.col("level") > k) & (here > above), F.col(f"last{k}.title")))
        above = F.greatest(above, F.coalesce(here, F.lit(0)))
    return rows.withColumn("path", F.concat(F.array_compact(F.array(*parts)), F.array("title"))).drop(*last)


def bodies(lines: DataFrame) -> DataFrame:
    """doc, section, page_end and body (its lines without the heading, trimmed) of each section."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return lines.filter("section > 0").groupBy("doc", "section").agg(F.max("page_no").alias("page_end"), T.strip(body).alias("body"))


@segments.tidied
def sections(pages: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """doc, idx, title, level, path, page_start, page_end, markdown of every document.

    Text before a first heading is left out; a document without headings is one section named Preamble.
    An outline (doc, title, level) may give levels of any depth. Repeats of a numbered title fold into the first; then neighbours of equal level and title fold.
    A document may hold any share of all pages: what is ordered over a whole document is scanned by segments.
    """
    deepest = max(DEEPEST, outline.agg(F.max("level")).first()[0] or 0) if outline is not None else DEEPEST
    counts = segments.settle(heading_counts(pages), "counts")
    heads, same = headings(pages, counts), F.lower("title")
    first = heads.filter(F.col("title").rlike(T.NUMBERED)).groupBy("doc", same.alias("same")).agg(F.min("section").alias("owner"))
    rows = paths(levels(heads, outline), deepest).withColumn("same", same).join(first, ["doc", "same"], "left")
    rows = rows.withColumn("owner", F.coalesce("owner", "section")).withColumn("survives", F.col("owner") == F.col("section"))
    rows = segments.running(rows, ["doc"], ["pos"], _segment(), previous=("last", F.when(F.col("survives"), F.struct("level", "same")), False))
    again = (F.col("level") == F.col("previous.level")) & (F.col("same") == F.col("previous.same"))
    rows = segments.settle(rows.withColumn("starts", F.col("survives") & ~F.coalesce(again, F.lit(False))).drop("previous", "same"), "sections")
    starts = F.col("starts")
    folded = segments.running(rows.select("doc", "pos", "section", "survives", "starts"), ["doc"], ["pos"], _segment(), head=("last", F.when(starts, F.col("section")), True), idx=("sum", starts.cast("int"), True))
    merged = rows.join(folded.filter("survives").select("doc", F.col("section").alias("owner"), "head", "idx"), ["doc", "owner"]).join(bodies(headed_lines(pages, counts)), ["doc", "section"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("section", "body")))), lambda x: x["body"]), "\n")
    lead = lambda c: F.min_by(c, "section").alias(c)
    tree = merged.groupBy("doc", "head", "idx").agg(lead("title"), lead("level"), lead("path"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), text.alias("markdown"))
    tree = tree.select("doc", (F.col("idx") - 1).cast("int").alias("idx"), "title", "level", "path", "page_start", "page_end", "markdown")
    bare = counts.groupBy("doc").agg(F.sum("section").alias("n")).filter("n = 0").select("doc")
    if bare.isEmpty():
        return tree
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.array_join("lines", "\n").alias("x")))), lambda x: x["x"]), "\n")
    bare = _lines(pages).join(bare, "doc", "left_semi").groupBy("doc").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), T.strip(whole).alias("markdown")).filter("markdown <> ''")
    preamble = bare.select("doc", F.lit(0).alias("idx"), F.lit("Preamble").alias("title"), F.lit(1).alias("level"), F.array(F.lit("Preamble")).alias("path"), "page_start", "page_end", "markdown")
    return tree.unionByName(preamble)


def parents(tree: DataFrame) -> DataFrame:
    """tree with parent_idx: the latest earlier section whose path is this one's without its end."""
    up = F.slice("path", 1, F.size("path") - 1)
    child = tree.filter(F.size("path") > 1).select("doc", "idx", up.alias("want"))
    other = tree.select("doc", F.col("idx").alias("parent"), F.col("path").alias("want"))
    found = child.join(other, ["doc", "want"]).filter("parent < idx").groupBy("doc", "idx").agg(F.max("parent").alias("parent_idx"))
    return tree.join(found, ["doc", "idx"], "left")


def blocks(pages: DataFrame) -> DataFrame:
    """Blocks of markdown pages: runs of heading, table, list and paragraph lines; a blank line ends a run.

    Columns: doc, page_no, reading_order (from 1), type, level, markdown.
    """
    rows = pages.select("doc", "page_no", F.posexplode(F.split(F.coalesce("markdown", F.lit("")), "\n", -1)).alias("line_no", "line"))
    s = T.strip(F.col("line"))
    kind = (
        F.when(s == "", F.lit(None))
        .when(F.col("line").rlike(r"^(#{1,6})\s+(.+?)\s*$"), "heading")
        .when(T.is_table_line(F.col("line")), "table")
        .when(F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)])\s+"), "list")
        .otherwise("paragraph")
    )
    w = Window.partitionBy("doc", "page_no").orderBy("line_no")
    rows = rows.withColumn("type", kind)
    starts = F.col("type").isNotNull() & ((F.col("type") == "heading") | ~F.col("type").eqNullSafe(F.lag("type").over(w)))
    rows = rows.withColumn("reading_order", F.sum(starts.cast("int")).over(w)).filter("type is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    level = F.max(F.when(F.col("type") == "heading", F.length(F.regexp_extract("line", r"^\s*(#+)", 1))))
    return rows.groupBy("doc", "page_no", "reading_order", "type").agg(level.alias("level"), text.alias("markdown"))


def block_sections(found: DataFrame) -> DataFrame:
    """Sections of blocks: each heading starts one, leading blocks form a Preamble. doc, section, title, page_start, page_end, blocks."""
    head = F.col("type") == "heading"
    narrow = found.select("doc", "page_no", "reading_order", head.cast("bigint").alias("head"), F.when(head, F.regexp_replace("markdown", r"^#+\s+", "")).alias("title"))
    rows = segments.running(narrow, ["doc"], ["page_no", "reading_order"], F.floor(F.col("page_no") / segments.PAGES), section=("sum", F.col("head"), True))
    title = F.coalesce(F.max("title"), F.lit("Preamble"))
    return rows.groupBy("doc", "section").agg(title.alias("title"), F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.count("*").alias("blocks"))


def numbered_blocks(found: DataFrame) -> DataFrame:
    """Blocks with a number over the whole document; orders restart on each page. The blocks are written, for they are read twice."""
    rows = segments.settle(found, "blocks")
    return segments.running(rows, ["doc"], ["page_no", "reading_order"], F.floor(F.col("page_no") / segments.PAGES), number=("sum", F.lit(1).cast("bigint"), True))
