"""Edits of page and section bodies, with reports of what they make stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import clean, lint, refs, segments


def occurrences(text: Column, find: Column) -> Column:
    """How often find stands in text, without overlaps; null where find is null or empty."""
    return F.when(F.length(find) > 0, (F.length(text) - F.length(F.replace(text, find))) / F.length(find)).cast("int")


def replaced_once(text: Column, find: Column, new: Column) -> Column:
    """text with its only occurrence of find replaced; null where there is none or more than one, or nothing to put in."""
    return F.when((occurrences(text, find) == 1) & new.isNotNull(), F.replace(text, find, new))


def edited_sections(sections: DataFrame, edits: DataFrame) -> DataFrame:
    """sections (doc, id, markdown) after edits (doc, id, find, new), with found, the occurrences of find.

    A body changes only where find stands in it exactly once; found is null for rows without an edit.
    """
    body = F.coalesce("markdown", F.lit(""))
    rows = sections.join(edits.select("doc", "id", "find", "new"), ["doc", "id"], "left")
    new = F.coalesce(replaced_once(body, F.col("find"), F.col("new")), F.col("markdown"))
    return rows.withColumns({"found": occurrences(body, F.col("find")), "markdown": new}).drop("find", "new")


def edited_pages(pages: DataFrame, edits: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, page_no, markdown and owners of the pages (doc, page_no, adopted, baseline) that edits (doc, page_no, find, new) change.

    The text edited is the adopted one, else the baseline. owners are the deepest sections (ids, sorted) that were
    built from the page and are stale now.
    """
    old = T.canonical(F.col("adopted"), F.col("baseline"))
    rows = pages.join(edits.select("doc", "page_no", "find", "new"), ["doc", "page_no"]).select("doc", "page_no", replaced_once(old, F.col("find"), F.col("new")).alias("markdown"))
    rows = rows.filter("markdown is not null")
    owners = refs.deepest_cover(spans, rows.select("doc", F.col("page_no").alias("page"))).groupBy("doc", F.col("page").alias("page_no")).agg(F.array_sort(F.collect_set("id")).alias("owners"))
    return rows.join(owners, ["doc", "page_no"], "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))


#: Pages of a cell, and of the widest section that is built in one.
CELL = 64

#: Rows of a broadcast side at most; each holds a name and a few numbers.
BROADCAST_ROWS = 500_000


def _in_cells(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, id, overlaps and own, the pages of each section as `clean.lined` gives them: sections (doc, id, page_start, page_end, overlaps) of CELL pages at most.

    A section lies in the cell of its first page. A page goes to its own cell, and to the one before if a section there
    reaches it; so a text is dealt once, however many sections it lies in, and all else is done in the cell.
    """
    spark, page = sections.sparkSession, F.col("page_no")
    cell = lambda c: F.floor(c / CELL)
    placed = sections.withColumn("cell", cell(F.col("page_start")))
    reach = placed.groupBy("doc", "cell").agg(F.max("page_end").alias("reach"))
    reach = segments.settle(reach.select("doc", "cell", "reach", F.explode(F.sequence("cell", cell(F.col("reach")))).alias("at")), "reach")
    n = reach.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * CELL // segments.ROWS)
    texts = pages.withColumn("at", cell(page)).join(F.broadcast(reach) if n <= BROADCAST_ROWS else reach, ["doc", "at"]).filter(page <= F.col("reach")).select("doc", "cell", "page_no", "markdown")
    rows = texts.unionByName(placed.select("doc", "cell", F.struct("id", "page_start", "page_end", "overlaps").alias("section")), allowMissingColumns=True).repartition(parts, "doc", "cell")
    lines = clean.lined(rows, "doc", "cell", "page_no", "section")
    own = F.array_sort(F.collect_list(F.when(page.isNotNull(), F.struct("page_no", "lines", "varying", "signed", "forms"))))
    cells = lines.groupBy("doc", "cell").agg(own.alias("pages"), F.collect_list("section").alias("sections"))
    held = lambda s: F.filter("pages", lambda p: (p["page_no"] >= s["page_start"]) & (p["page_no"] <= s["page_end"]))
    each = F.explode(F.transform("sections", lambda s: F.struct(s["id"].alias("id"), s["overlaps"].alias("overlaps"), held(s).alias("own"))))
    return cells.select("doc", each.alias("s")).select("doc", "s.*").filter(F.size("own") > 0)


@segments.tidied
def rebuilt(sections: DataFrame, pages: DataFrame, fraction: float = 0.30) -> DataFrame:
    """doc, id, markdown and overlaps of sections (doc, id, page_start, page_end, lft, rgt) built anew from pages (doc, page_no, markdown).

    Each section's pages are cleaned as a text of their own, blank ones passed over, the others joined by an empty
    line, and table separators repaired. overlaps are sections of the same pages that are no kin (ids, sorted).
    Sections without a page range, or without any page in it, are left out. Wide sections, where there are any, are cleaned
    page by page and then put together.
    """
    meets = refs.overlapping(sections).groupBy("doc", "id").agg(F.array_sort(F.collect_set("other")).alias("overlaps"))
    ranged = sections.filter("doc is not null and id is not null and page_start > 0 and page_end >= page_start").select("doc", "id", "page_start", "page_end").join(meets, ["doc", "id"], "left")
    ranged = segments.settle(ranged.withColumn("overlaps", F.coalesce("overlaps", F.array().cast("array<string>"))), "ranged")
    is_wide = F.col("page_end") - F.col("page_start") >= CELL
    kept = clean.cleaned_together(_in_cells(ranged.filter(~is_wide), pages), ["doc", "id", "overlaps"], fraction)
    texts = kept.select("doc", "id", "overlaps", F.array_join(F.filter("texts", lambda x: x != ""), "\n\n").alias("markdown"))
    wide = ranged.filter(is_wide)
    if not wide.isEmpty():
        covers = refs.covering(wide.withColumn("lft", F.lit(0)), pages.select("doc", F.col("page_no").alias("page"))).select("doc", "id", F.col("page").alias("page_no"))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("markdown") != "", F.struct("page_no", "markdown")))), lambda x: x["markdown"]), "\n\n")
        built = clean.cleaned_spans(covers, pages, fraction).groupBy("doc", "id").agg(body.alias("markdown"))
        texts = texts.unionByName(built.join(wide.select("doc", "id", "overlaps"), ["doc", "id"]))
    return lint.repaired(texts, ["doc", "id", "overlaps"]).select("doc", "id", "markdown", "overlaps")


def approved(documents: DataFrame, edges: DataFrame, chosen: DataFrame, sections: DataFrame, spans: DataFrame, page_counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (doc, status) with the chosen ones Graphed, and edges with all that leave the chosen ones' sections found anew."""
    mark = chosen.select("doc").distinct().withColumn("__new", F.lit("Graphed"))
    status = documents.join(mark, "doc", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")
    own = sections.join(mark, "doc", "left_semi")
    return status, refs.replace_outgoing(edges, refs.edges(own, spans, page_counts), own.select("doc", "id"))


def drift(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, id, state of each section (doc, id, markdown, wiki_id): no_page, drift (trimmed texts differ) or same. pages: wiki_id, content."""
    rows = sections.join(pages.select("wiki_id", "content", F.lit(True).alias("there")), "wiki_id", "left")
    differs = T.strip(F.coalesce("content", F.lit(""))) != T.strip(F.coalesce("markdown", F.lit("")))
    return rows.select("doc", "id", F.when(F.col("there").isNull(), "no_page").when(differs, "drift").otherwise("same").alias("state"))


def lint_summary(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lint (JSON of the issues in order, null where there are none), lint_count and line, the issues as one line of context."""
    found = lint.issues(texts, keys)
    ordered = F.array_sort(F.collect_list(F.struct(F.when(F.col("line") == 0, 2**31 - 1).otherwise(F.col("line")).alias("at"), "code", "line")))
    rows = texts.select(*keys).join(found.groupBy(*keys).agg(ordered.alias("found")), keys, "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<at:bigint,code:string,line:bigint>>")))
    line = F.array_join(F.transform("found", lambda x: F.when(x["line"] > 0, F.concat(x["code"], F.lit(" (line "), x["line"].cast("string"), F.lit(")"))).otherwise(x["code"])), "; ")
    as_json = F.to_json(F.transform("found", lambda x: F.struct(x["code"].alias("code"), x["line"].alias("line"))))
    return rows.select(*keys, F.when(F.size("found") > 0, as_json).alias("lint"), F.size("found").alias("lint_count"), line.alias("line"))


def scopes(attachments: DataFrame, documents: DataFrame, pages: DataFrame, sections: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """session, document, project: what the attachments (session, place, kind, name) of a session point at.

    The first attachment that still exists wins for the document, be it the document itself, a page or a section
    of one; the project is the first attached one that there is (projects: project; else those that documents name), else the document's.
    """
    known = documents.select(F.lit("document").alias("kind"), F.col("doc").alias("name"), "doc")
    known = known.unionByName(pages.select(F.lit("page").alias("kind"), F.col("page").alias("name"), "doc")).unionByName(sections.select(F.lit("section").alias("kind"), F.col("id").alias("name"), "doc"))
    projects = (documents if projects is None else projects).filter("project is not null").select(F.lit("project").alias("kind"), F.col("project").alias("name"), F.col("project").alias("own")).distinct()
    rows = attachments.join(known, ["kind", "name"], "left").join(projects, ["kind", "name"], "left")
    first = rows.groupBy("session").agg(F.min_by("doc", F.when(F.col("doc").isNotNull(), F.col("place"))).alias("document"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("place"))).alias("explicit"))
    of = documents.select(F.col("doc").alias("document"), "project")
    return first.join(of, "document", "left").select("session", "document", F.coalesce("explicit", "project").alias("project"))


def mutation_batches(mutations: DataFrame, layers: DataFrame) -> DataFrame:
    """turn, documents (distinct, sorted), layers (distinct, as first touched) and count. mutations: turn, place, tool, doc; layers: tool, at, layer."""
    of = mutations.join(layers, "tool", "left").withColumns({"layer": F.coalesce("layer", F.lit("document")), "at": F.coalesce("at", F.lit(0))})
    first = of.groupBy("turn", "layer").agg(F.min(F.struct("place", "at")).alias("first")).groupBy("turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "layer"))), lambda x: x["layer"]).alias("layers"))
    per = mutations.groupBy("turn").agg(F.array_sort(F.collect_set("doc")).alias("documents"), F.count("*").alias("count"))
    return per.join(first, "turn")


def assets_of_pages(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """doc, page_no, asset: the first asset (doc, place, asset, page_number, page_id) of each page, by its number or by its id page_001."""
    by_number = assets.filter("page_number is not null").select("doc", F.col("page_number").cast("bigint").alias("page_no"), "place", "asset")
    by_id = assets.filter(F.col("page_id").rlike(r"^page_[0-9]{3,}$")).select("doc", F.substring("page_id", 6, 9).cast("bigint").alias("page_no"), "place", "asset", "page_id")
    by_id = by_id.filter(F.col("page_id") == F.format_string("page_%03d", "page_no")).drop("page_id")
    first = by_number.unionByName(by_id).groupBy("doc", "page_no").agg(F.min_by("asset", "place").alias("asset"))
    return pages.select("doc", F.col("page_no").cast("bigint").alias("page_no")).join(first, ["doc", "page_no"], "left")
