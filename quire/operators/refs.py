"""Page references: found in text by pattern, resolved to sections by interval, kept as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import segments


#: Bits of the widths of bins: a span lies in bins of the least width, of these, that is no less than its own, so in two at most.
BITS = (0, 3, 6, 9, 12, 15, 18, 21, 24, 27, 30)


def _level(start: Column, end: Column) -> Column:
    """The place in BITS of the bins that a span lies in."""
    return sum(((end - start + 1 > 2**bits).cast("int") for bits in BITS[:-1]), F.lit(0))


def binned(spans: DataFrame) -> DataFrame:
    """spans with a page range, each with level and one row for each bin it lies in: one or two."""
    rows = spans.filter("page_start > 0 and page_end >= page_start").withColumn("level", _level(F.col("page_start"), F.col("page_end")))
    width = F.pow(F.lit(8.0), "level")
    first, last = F.floor(F.col("page_start") / width), F.floor(F.col("page_end") / width)
    return rows.withColumn("bin", F.explode(F.sequence(first, last)))


def bins_of(first: Column, last: Column, least: Column) -> Column:
    """level and bin of the bins of each level from least on that meet a range of pages which is no wider than these."""
    levels = F.filter(F.array(*map(F.lit, range(len(BITS)))), lambda k: k >= least)
    return F.flatten(F.transform(levels, lambda k: F.transform(F.sequence(F.floor(first / F.pow(F.lit(8.0), k)), F.floor(last / F.pow(F.lit(8.0), k))), lambda x: F.struct(k.alias("level"), x.alias("bin")))))


def covering(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of points (doc, page, ...) with each span (doc, id, page_start, page_end, lft) that holds the page.

    Spans lie in bins by their width, at most two each, and a point in one bin of each width, so what meets is a span near
    the page: the work grows with points and covers, not with the spans of a document. The range is a residual.
    """
    a, b, page = F.col("page_start"), F.col("page_end"), F.col("page").cast("bigint")
    held = binned(spans.select("doc", "id", "page_start", "page_end", "lft"))
    cells = points.withColumn("at", F.explode(bins_of(page, page, F.lit(0)))).select(*points.columns, "at.level", "at.bin")
    return cells.join(held, ["doc", "level", "bin"]).filter((a <= page) & (page <= b)).drop("level", "bin")


def smallest_cover(spans: DataFrame, points: DataFrame) -> DataFrame:
    """doc, page, id of the shortest span that holds the page, the first in order on ties; null without one."""
    pages = points.select("doc", "page").distinct()
    found = covering(spans, pages).groupBy("doc", "page").agg(F.min_by("id", F.struct(F.col("page_end") - F.col("page_start"), "lft")).alias("id"))
    return pages.join(found, ["doc", "page"], "left")


def deepest_cover(spans: DataFrame, points: DataFrame) -> DataFrame:
    """doc, page, id of the spans that hold the page and have no descendant that does.

    Nested-set numbers of the covers of a page: a cover has a descendant among them if the next one in the order of lft ends before it does.
    """
    ends = spans.select("doc", "id", "rgt")
    held = covering(spans, points.select("doc", "page").distinct()).join(ends, ["doc", "id"])
    after = F.lead("rgt").over(Window.partitionBy("doc", "page").orderBy("lft"))
    return held.withColumn("after", after).filter("after is null or after > rgt").select("doc", "page", "id")


def overlapping(spans: DataFrame) -> DataFrame:
    """doc, id, other: spans whose page ranges meet, neither within the other's subtree.

    The narrower span of a pair is looked up in the bins of the wider one's width; of two bins that both lie in the first counts.
    """
    x = spans.select("doc", "id", "page_start", "page_end", "lft", "rgt")
    wide = binned(x).select("doc", "level", "bin", F.col("id").alias("other"), F.col("page_start").alias("s"), F.col("page_end").alias("e"), F.col("lft").alias("l"), F.col("rgt").alias("r"))
    narrow = x.filter("page_start > 0 and page_end >= page_start").withColumn("own", _level(F.col("page_start"), F.col("page_end")))
    narrow = narrow.withColumn("at", F.explode(bins_of(F.col("page_start"), F.col("page_end"), F.col("own")))).select(*x.columns, "own", "at.level", "at.bin")
    apart = ~((F.col("lft") <= F.col("l")) & (F.col("rgt") >= F.col("r"))) & ~((F.col("l") <= F.col("lft")) & (F.col("r") >= F.col("rgt")))
    first = F.col("bin") == F.floor(F.greatest("page_start", "s") / F.pow(F.lit(8.0), "level"))
    pairs = narrow.join(wide, ["doc", "level", "bin"]).filter((F.col("page_start") <= F.col("e")) & (F.col("s") <= F.col("page_end")) & first & apart)
    one, back = F.struct(F.col("id").alias("id"), F.col("other").alias("other")), F.struct(F.col("other").alias("id"), F.col("id").alias("other"))
    return pairs.select("doc", F.explode(F.when(F.col("own") < F.col("level"), F.array(one, back)).otherwise(F.array(one))).alias("pair")).select("doc", "pair.id", "pair.other")


def internal(cue: Column, kind: Column, n: Column, page_count: Column) -> Column:
    """A mention is internal if it has a see or refer cue or the form page no., and the page exists."""
    return ((cue != "") | F.contains(F.lower(kind), F.lit("no"))) & (n >= 1) & (n <= F.coalesce(F.nullif(page_count, F.lit(0)), F.lit(2**31 - 1)))


def mentions(sections: DataFrame, text: str = "markdown") -> DataFrame:
    """doc, id, anchor, cue, kind, n for every page mention in the sections' text, which is searched once: the parts are those of the anchor."""
    found = sections.select("doc", "id", F.explode(F.regexp_extract_all(F.col(text), F.lit(T.PAGE_REFERENCE), F.lit(0))).alias("anchor"))
    part = lambda g: F.regexp_extract("anchor", T.PAGE_REFERENCE, g)
    return found.select("doc", "id", "anchor", part(1).alias("cue"), part(2).alias("kind"), part(3).cast("int").alias("n"))


def internal_mentions(sections: DataFrame, page_counts: DataFrame) -> DataFrame:
    """doc, id, anchor, n of the internal mentions, written, for texts are read and searched once, whatever then reads the mentions more often."""
    found = mentions(sections).join(page_counts, "doc").filter(internal(F.col("cue"), F.col("kind"), F.col("n"), F.col("page_count")))
    return segments.settle(found.select("doc", "id", "anchor", "n"), "mentions")


def edges(sections: DataFrame, spans: DataFrame, page_counts: DataFrame) -> DataFrame:
    """doc, from_id, to_id, target_page, anchor, occurrences: internal mentions resolved to the smallest cover, not to itself."""
    found = internal_mentions(sections, page_counts)
    target = smallest_cover(spans, found.select("doc", F.col("n").alias("page"))).filter("id is not null").select("doc", F.col("page").alias("n"), F.col("id").alias("to_id"))
    rows = found.join(target, ["doc", "n"]).filter("id <> to_id")
    return rows.groupBy("doc", F.col("id").alias("from_id"), "to_id", F.col("n").alias("target_page"), T.strip(F.col("anchor")).alias("anchor")).agg(F.count("*").alias("occurrences"))


def replace_outgoing(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges after new ones took the place of all that leave the changed sections (doc, id)."""
    gone = changed.select("doc", F.col("id").alias("from_id"))
    return old.join(gone, ["doc", "from_id"], "left_anti").unionByName(new.join(gone, ["doc", "from_id"], "left_semi"))


def without_nodes(found: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the sections gone (doc, id)."""
    return found.join(gone.select("doc", F.col("id").alias("from_id")), ["doc", "from_id"], "left_anti").join(gone.select("doc", F.col("id").alias("to_id")), ["doc", "to_id"], "left_anti")
