"""Projection of a section tree into wiki pages: placement, order, routes, contents, links and leftovers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import lint, refs, segments, tree


def siblings(numbered: DataFrame) -> DataFrame:
    """doc, id, title, wiki_parent and place (from 0) of every included section under its nearest included ancestor."""
    rows = numbered.filter("include").join(tree.included_ancestor(numbered), ["doc", "id"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc", "wiki_parent").orderBy("lft")) - 1)


def slugs(placed: DataFrame) -> DataFrame:
    """placed with slug, unique among siblings: the title's, else -2, -3, ... past those that are taken.

    Siblings of one base are numbered by a window. A title may itself be another's numbered slug: only siblings
    whose bases are the same up to such numbers then, and can so meet, are walked in order, one group at a time:
    siblings of one parent whose titles differ in trailing numbers alone, and among which a title is such a number's.
    """

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group, taken, last, out = group.sort_values("place"), set(), {}, []
        for base in group["base"]:
            name, n = base, last.get(base, 2)  # numbers before the last one are taken for good
            while name in taken:
                name, n = f"{base}-{n}", n + 1
            last[base] = max(n - 1, 2)
            taken.add(name)
            out.append(name)
        return group.assign(slug=out)[["doc", "id", "slug"]]

    ids, docs = (placed.schema[c].dataType.simpleString() for c in ("id", "doc"))
    base, up = T.slug(F.col("title")), F.coalesce(F.col("wiki_parent").cast("string"), F.lit(""))
    rows = placed.select("doc", "id", up.alias("up"), "place", base.alias("base")).withColumn("stem", F.regexp_replace("base", "(-[0-9]+)+$", ""))
    rows = segments.settle(rows, "slugs")
    bases = rows.select("doc", "up", "stem", "base").distinct()
    numbers = bases.filter(F.col("base").rlike("-[0-9]+$")).withColumn("base", F.regexp_replace("base", "-[0-9]+$", ""))
    meet = numbers.join(bases, ["doc", "up", "stem", "base"], "left_semi").select("doc", "up", "stem").distinct()
    k = F.row_number().over(Window.partitionBy("doc", "up", "base").orderBy("place"))
    apart = rows.join(meet, ["doc", "up", "stem"], "left_anti").withColumn("k", k)
    apart = apart.select("doc", "id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "k")).alias("slug"))
    walked = rows.join(meet, ["doc", "up", "stem"], "left_semi").groupBy("doc", "up", "stem").applyInPandas(walk, f"doc {docs}, id {ids}, slug string")
    return placed.join(apart.unionByName(walked), ["doc", "id"])


@segments.tidied
def routes(named: DataFrame) -> DataFrame:
    """doc, id, route: the document's slug and those of the ancestors, joined by slashes."""
    named = segments.settle(named.select("doc", "id", "wiki_parent", "slug"), "named")
    top = named.filter("wiki_parent is null").select("doc", "id", F.concat_ws("/", T.slug(F.col("doc").cast("string")), "slug").alias("route"))

    def below(level: DataFrame) -> DataFrame:
        up = level.select("doc", F.col("id").alias("wiki_parent"), F.col("route").alias("r"))
        return named.join(up, ["doc", "wiki_parent"]).select("doc", "id", F.concat_ws("/", "r", "slug").alias("route"))

    return tree.descend(top, below)


def contents(sections: DataFrame, placed: DataFrame) -> DataFrame:
    """doc, id, content: the body; for a group without one the list of its direct included children; else the title."""
    child = placed.filter("wiki_parent is not null").groupBy("doc", F.col("wiki_parent").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("listing")
    )
    rows = sections.filter("include").join(child, ["doc", "id"], "left")
    body = F.coalesce("markdown", F.lit(""))
    content = F.when(T.strip(body) != "", body).when(F.col("is_group"), F.coalesce("listing", F.lit(""))).otherwise(F.concat(F.lit("# "), "title"))
    return rows.select("doc", "id", content.alias("content"))


def linked(sections: DataFrame, spans: DataFrame, named_routes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """doc, id, markdown, links: internal page mentions replaced by links to the route of their smallest included cover.

    Targets come from a join; the text itself is rewritten batch by batch from a map of page to route.
    """
    segments.bounded_batches(sections.sparkSession)
    found = refs.internal_mentions(sections, page_counts)
    cover = refs.smallest_cover(spans, found.select("doc", F.col("n").alias("page"))).filter("id is not null").join(named_routes, ["doc", "id"])
    to = found.select("doc", "id", "n").distinct().join(cover.select("doc", F.col("page").alias("n"), F.col("id").alias("to"), "route"), ["doc", "n"]).filter("id <> to")
    maps = to.groupBy("doc", "id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n").cast("string"), "route"))).alias("targets"))
    rows = sections.select("doc", "id", "markdown").join(maps, ["doc", "id"], "left")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = re.compile(T.PAGE_REFERENCE)
        for batch in batches:
            texts, counts = [], []
            for text, targets in zip(batch["markdown"], batch["targets"]):
                known = dict(targets) if targets is not None else {}
                links = 0

                def link(m: re.Match) -> str:
                    nonlocal links
                    route = known.get(str(int(m[3]))) if m[1] or "no" in m[2].lower() else None
                    links += route is not None
                    return m[0] if route is None else f"[{m[0]}](/{route})"

                texts.append(pattern.sub(link, text) if known and text else text)
                counts.append(links)
            yield batch[["doc", "id"]].assign(markdown=texts, links=counts)

    doc, key = (sections.schema[c].dataType.simpleString() for c in ("doc", "id"))
    return rows.mapInPandas(rewrite, f"doc {doc}, id {key}, markdown string, links int")


def body(markdown: Column, is_group: Column, title: Column) -> Column:
    """A page's own content: the trimmed body, else its title as a heading; a group without a body has none."""
    own = T.strip(F.coalesce(markdown, F.lit("")))
    return F.when(own != "", own).when(is_group, "").otherwise(F.concat(F.lit("# "), title, F.lit("\n")))


def listings(children: DataFrame) -> DataFrame:
    """doc, id and listing: the included direct children (doc, parent, lft, title, route) of each section as links, in order, under a heading."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("lft", "title", "route"))), lambda x: F.concat(F.lit("- ["), x["title"], F.lit("](/"), x["route"], F.lit(")\n")))
    return children.filter("parent is not null").groupBy("doc", F.col("parent").alias("id")).agg(F.concat(F.lit("## Contents\n\n"), F.array_join(items, "")).alias("listing"))


def generated(sections: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """doc, id, title, is_group, wiki_parent, place, slug, route, content, links of the page of every included section of a numbered tree.

    A group without a body lists its included direct children. Where sections have a page range and page_counts are given,
    internal page mentions become links to the smallest included section that covers the page.
    """
    placed = siblings(sections)
    named = segments.settle(slugs(placed).select("doc", "id", "wiki_parent", "place", "slug"), "named")
    rows = placed.select("doc", "id", "parent", "lft", "title", "is_group", "markdown").join(routes(named), ["doc", "id"])
    full = rows.join(listings(rows), ["doc", "id"], "left").join(named, ["doc", "id"])
    own = body(F.col("markdown"), F.col("is_group"), F.col("title"))
    full = full.withColumn("content", F.when((own == "") & F.col("is_group"), F.coalesce("listing", F.lit(""))).otherwise(own))
    pages = full.select("doc", "id", "title", "is_group", "wiki_parent", "place", "slug", "route", "content")
    if page_counts is None:
        return pages.withColumn("links", F.lit(0))
    pages = segments.settle(pages, "pages")
    new = linked(pages.withColumnRenamed("content", "markdown"), sections.filter("include"), pages.select("doc", "id", "route"), page_counts)
    return pages.drop("content").join(new.withColumnRenamed("markdown", "content"), ["doc", "id"])


def page_id(doc: Column, section: Column) -> Column:
    """The id of the page first made for a section: the same whenever it is made."""
    return F.concat(F.lit("w-"), F.substring(F.sha2(F.concat_ws("\x1f", doc.cast("string"), section), 256), 1, 16))


#: What generation sets of a page; its id, and when it was first made, stay.
PAGE_FIELDS = ("title", "is_group", "parent_id", "place", "slug", "route", "content")


def merged(stored: DataFrame, sections: DataFrame, pages: DataFrame, version: int) -> DataFrame:
    """The stored wiki after generation: wiki_id, doc, PAGE_FIELDS, created, section and action.

    stored: wiki_id, doc, PAGE_FIELDS, created. sections (doc, id, wiki_id, lft) are all sections of the documents that
    are generated; wiki_id points at the page made for a section before. pages: what `generated` gives for them.

    A page is updated in place where its section points at it and it is still there, so its id stays; of several sections that
    point at one page the first has it. Other sections get a page of their own id, the same one at every run. Pages of these
    documents that no included section has are stale: action delete. Pages of other documents stay untouched (keep). A page
    that would change in nothing is same, so generating twice changes nothing.
    """
    there = stored.select(F.col("wiki_id").alias("pointer"), F.lit(True).alias("there"))
    asked = pages.join(sections.select("doc", "id", F.col("wiki_id").alias("pointer"), "lft"), ["doc", "id"]).join(there, "pointer", "left")
    held = asked.filter("there").groupBy("pointer").agg(F.min(F.struct("doc", "lft", "id")).alias("first"))
    asked = asked.join(held, "pointer", "left")
    first = F.col("there") & (F.col("first.doc") == F.col("doc")) & (F.col("first.id") == F.col("id"))
    keyed = asked.withColumn("wiki_id", F.when(first, F.col("pointer")).otherwise(page_id(F.col("doc"), F.col("id")))).drop("pointer", "there", "first", "lft")
    keyed = segments.settle(keyed, "keyed")
    up = keyed.select("doc", F.col("id").alias("wiki_parent"), F.col("wiki_id").alias("parent_id"))
    new = keyed.join(up, ["doc", "wiki_parent"], "left").select("wiki_id", F.col("doc").alias("n_doc"), F.col("id").alias("section"), *[F.col(c).alias(f"n_{c}") for c in PAGE_FIELDS])
    docs = sections.select("doc").distinct().withColumn("ours", F.lit(True))
    both = stored.join(docs, "doc", "left").join(new, "wiki_id", "full_outer")
    same = F.lit(True)
    for c in PAGE_FIELDS:
        same = same & F.col(c).eqNullSafe(F.col(f"n_{c}"))
    is_new, gone = F.col("created").isNull(), F.col("n_doc").isNull()
    action = F.when(is_new, "insert").when(gone & F.col("ours"), "delete").when(gone, "keep").when(same, "same").otherwise("update")
    return both.select(
        "wiki_id", F.coalesce("n_doc", "doc").alias("doc"), *[F.when(gone, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c) for c in PAGE_FIELDS],
        F.coalesce("created", F.lit(version)).alias("created"), "section", action.alias("action"),
    )


def pointers(sections: DataFrame, merge: DataFrame) -> DataFrame:
    """sections with wiki_id at the page that a merge gave them; null for those that have none any more."""
    to = merge.filter("section is not null").select("doc", F.col("section").alias("id"), F.col("wiki_id").alias("__to"))
    return sections.join(to, ["doc", "id"], "left").withColumn("wiki_id", F.col("__to")).drop("__to")


#: Where previews link to.
PREVIEW = "section-preview/"


def preview(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """doc, id, title, breadcrumb, markdown, shown, page_refs_resolved, include, lint: each section of a numbered tree as its page would look.

    sections have page_start, page_end, markdown and include; documents: doc, title, project (null: shown as Project), page_count (null or 0: unknown).
    A group without a body lists its included children. Page mentions are linked to previews of the smallest included cover.
    The breadcrumb is the project, the document's title and the titles of the section's path.
    """
    route = F.concat(F.lit(PREVIEW), F.col("id").cast("string"))
    rows = sections.select("doc", "id", "parent", "lft", "title", "is_group", "include", "path", "markdown").withColumn("route", route)
    own = body(F.col("markdown"), F.col("is_group"), F.col("title"))
    full = rows.join(listings(rows.filter("include")), ["doc", "id"], "left")
    full = full.select("doc", "id", "title", "path", "include", F.when((own == "") & F.col("is_group"), F.coalesce("listing", F.lit(""))).otherwise(own).alias("markdown"))
    full = segments.settle(full, "previews")
    spans = sections.filter("include").select("doc", "id", "page_start", "page_end", "lft")
    shown = linked(full, spans, spans.select("doc", "id", route.alias("route")), documents.select("doc", "page_count"))
    found = lint.issues(full.select("doc", "id", "markdown"), ["doc", "id"]).groupBy("doc", "id").agg(F.array_sort(F.collect_list(F.struct("line", "code"))).alias("lint"))
    out = full.join(shown.select("doc", "id", F.col("markdown").alias("shown"), F.col("links").alias("page_refs_resolved")), ["doc", "id"]).join(found, ["doc", "id"], "left")
    out = out.join(documents.select("doc", F.col("title").alias("document"), "project"), "doc", "left")
    crumbs = F.concat(F.array(F.coalesce("project", F.lit("Project")), F.col("document")), F.col("path"))
    return out.select("doc", "id", "title", crumbs.alias("breadcrumb"), "markdown", "shown", "page_refs_resolved", "include", F.coalesce("lint", F.array().cast("array<struct<line:bigint,code:string>>")).alias("lint"))


def stale(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Wiki pages (doc, wiki_id, depth) that no included section links to, deepest first."""
    live = sections.filter("include and wiki_id is not null").select("wiki_id")
    return pages.join(live, "wiki_id", "left_anti").orderBy(F.desc("depth"), "wiki_id")


def by_chapter(sections: DataFrame) -> DataFrame:
    """One page per level-1 ancestor in first-seen order: doc, title, page_start, page_end, body with headings by depth."""
    part = F.concat(F.expr("repeat('#', size(path))"), F.lit(" "), "title", F.lit("\n\n"), F.coalesce("markdown", F.lit("")))
    return sections.groupBy("doc", F.col("path")[0].alias("title")).agg(
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", part.alias("x")))), lambda x: x["x"]), "\n\n").alias("body")
    )


def sync_status(sections: DataFrame) -> DataFrame:
    """doc, id, reason: why a section's page cannot be synced alone, null where it can."""
    reason = F.when(~F.col("include"), "excluded").when(F.col("wiki_id").isNull(), "no_wiki_document").when(F.col("is_group") & (T.strip(F.coalesce("markdown", F.lit(""))) == ""), "needs_regenerate")
    return sections.select("doc", "id", reason.alias("reason"))
