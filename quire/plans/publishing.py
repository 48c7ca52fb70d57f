"""Queries on what is published and kept: wiki merges, stored trees, streams, previews, project graphs, parse documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import clean, graph, runs, segments, tree, wiki
from quire.plans.structure import _PLACED
from quire.plans.views import PAGES, SPANS, TREE
from quire.sources import canonical, stored
from quire.sources import tables as S
from quire.streaming import edges as edge_stream
from quire.streaming import fragments as fragment_stream


def wiki_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wiki after generation: some pages are there as generated, some differ, some are gone, some are stale, one is another document's."""
    s = tree.nested_set(S.tree(spark, sf_dir)).withColumn("markdown", F.when(F.col("id").startswith("o:"), F.concat(F.lit(" Order "), "title", F.lit("\n"))))
    pages = segments.settle(wiki.generated(s), "generated")
    pointer, kept = F.concat_ws("-", F.lit("p"), "doc", "id"), (F.col("lft") % 3 != 0) & (F.col("lft") % 5 != 0)
    s = s.withColumn("wiki_id", F.when(F.col("lft") % 3 != 0, pointer)).select("doc", "id", "wiki_id", "lft", "title", "include")
    up = s.select("doc", F.col("id").alias("wiki_parent"), F.when(kept, pointer).otherwise(wiki.page_id(F.col("doc"), F.col("id"))).alias("parent_id"))
    there = s.filter(kept).select("doc", "id", "wiki_id", "lft").join(pages, ["doc", "id"]).join(up, ["doc", "wiki_parent"], "left")
    there = there.withColumn("title", F.when(F.col("lft") % 2 == 0, F.col("title")).otherwise("Old"))
    excluded = s.filter(kept & ~F.col("include")).select("wiki_id", "doc", "title").unionByName(spark.createDataFrame([("other", -1, "Other")], "wiki_id string, doc bigint, title string"))
    blank = {c: F.lit(None).cast(t) for c, t in (("is_group", "boolean"), ("parent_id", "string"), ("place", "int"), ("slug", "string"), ("route", "string"), ("content", "string"))}
    before = there.select("wiki_id", "doc", *wiki.PAGE_FIELDS).unionByName(excluded.withColumns(blank)).withColumn("created", F.lit(1))
    found = wiki.merged(before, s, pages, 2)
    return found.select("wiki_id", "doc", "action", F.col("created").cast("bigint").alias("created"), "title", "parent_id", F.col("place").cast("bigint").alias("place"), "route", F.md5("content").alias("digest"))


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of included sections with a page range: contents of groups, own bodies, and links from page mentions."""
    s = _previewed(spark, sf_dir)
    found = wiki.generated(s, S.page_counts(spark, sf_dir))
    return found.select("doc", "id", "slug", "route", F.col("links").cast("bigint").alias("links"), F.length("content").cast("bigint").alias("n_chars"))


def replaced_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees stored by document, every third of them replaced, twice over, by one with other titles; every sixth comes out empty."""
    path, rows = segments.new_folder(spark, "trees"), S.tree(spark, sf_dir)
    stored.replace(rows, path, rows.select("doc"))
    new = rows.filter("doc % 3 = 0 and doc % 2 = 1").withColumn("title", F.concat(F.lit("New "), "title"))
    for _ in range(2):
        stored.replace(new, path, rows.filter("doc % 3 = 0").select("doc"))
    return stored.read(spark, path, rows.schema).select("doc", "id", "parent", "title")


def streamed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference edges kept up by a stream: sections come with a first text, then with their own."""
    folder = segments.new_folder(spark, "edges")
    texts = S.span_texts(spark, sf_dir).select("doc", "id", F.lit(1).alias("at"), "markdown")
    S.spans(spark, sf_dir).select("doc", "id", F.lit(0).alias("at"), F.lit("See page 1 and page no. 2.").alias("markdown")).write.parquet(f"{folder}/changes")
    texts.write.mode("append").parquet(f"{folder}/changes")
    edge_stream.create(spark, f"{folder}/edges")
    changes = edge_stream.changes(spark, f"{folder}/changes", texts.schema, files_per_trigger=int(spark.conf.get("spark.sql.shuffle.partitions")))
    stream = edge_stream.kept_up(changes, f"{folder}/edges", f"{folder}/checkpoint", S.spans(spark, sf_dir), S.page_counts(spark, sf_dir))
    stream.trigger(availableNow=True).start().awaitTermination()
    found = stored.read(spark, f"{folder}/edges", spark.createDataFrame([], edge_stream.EDGES).schema)
    return found.withColumn("target_page", F.col("target_page").cast("bigint"))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as calls, their turns as fragments of three indexes; ids and names come with some turns alone."""
    c, n = S.read(spark, sf_dir, "conversations"), F.col("turn")
    return c.select(
        F.concat(F.lit("call"), F.col("conv_id").cast("string")).alias("call"), F.when(n % 3 != 0, n % 3).cast("bigint").alias("index"), n.cast("bigint").alias("seq"),
        F.when(n % 4 < 2, F.concat_ws("-", "conv_id", "turn")).when(n % 4 == 2, "").alias("id"), F.when(n % 2 == 0, F.col("role")).alias("name"), F.when(n % 5 != 4, F.col("text")).alias("arguments"),
    )


def joined_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fragment_stream.together(_fragments(spark, sf_dir))
    return found.select("call", "index", "id", "name", F.md5("arguments").alias("digest"), "fragments")


def _previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as a numbered tree; every other chapter has no text of its own."""
    s, group = S.span_texts(spark, sf_dir), F.col("parent").isNull()
    line = F.when(group, F.array("id")).otherwise(F.array("parent", "id"))
    return s.select(
        "doc", "id", "parent", "page_start", "page_end", "lft", "rgt", F.col("id").alias("title"), group.alias("is_group"), (F.col("lft") % 4 != 2).alias("include"), line.alias("line"), line.alias("path"),
        F.when(~(group & (F.col("page_start") % 8 == 1)), F.col("markdown")).alias("markdown"),
    )


def section_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = S.page_counts(spark, sf_dir).select("doc", "page_count", F.concat(F.lit("Title of "), "doc").alias("title"), F.when(~F.col("doc").endswith("1"), F.lit("Library")).alias("project"))
    found = wiki.preview(_previewed(spark, sf_dir), documents)
    return found.select("doc", "id", F.array_join("breadcrumb", " > ").alias("breadcrumb"), F.md5("markdown").alias("digest"), F.length("shown").cast("bigint").alias("n_chars"), F.col("page_refs_resolved").cast("bigint").alias("resolved"), "include", F.size("lint").cast("bigint").alias("lint"))


def _project_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as projects: source n is a document of nation n, so some nations have none."""
    from quire.plans import structure

    nations = S.read(spark, sf_dir, "nation").select(F.col("n_name").alias("project"), F.col("n_nationkey").cast("bigint").alias("number"))
    documents = S.page_counts(spark, sf_dir).select("doc", F.upper("doc").alias("title"), F.substring("doc", 4, 9).try_cast("bigint").alias("number")).join(nations, "number", "left")
    spans, found = structure._edges(spark, sf_dir)
    return nations, graph.payload(documents, spans.withColumn("title", F.col("id")), graph.reference_weights(found))


def project_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project_graph(spark, sf_dir)[1]


def project_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.payload_counts(*_project_graph(spark, sf_dir))


def stitched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that start or end with table rows of two or three columns, or are a table as a whole, for several pages in a row."""
    k, table = F.col("doc_id") % 11, F.concat(F.lit("|"), F.col("doc_id").cast("string"), F.lit("|x|"))
    headed = F.concat(F.lit("|a|b|\n|---|---|\n"), table)
    wide = F.lit("|1|2|3|\n|4|5|6|")
    text = (
        F.when(k < 3, table).when(k == 3, headed).when(k == 4, F.concat("truth", F.lit("\n"), headed, F.lit("\n"))).when(k == 5, F.concat(F.lit("\n\n"), table, F.lit("\n"), "truth", F.lit("\n"), table))
        .when(k == 6, F.concat(wide, F.lit("\n"), "truth")).when(k == 7, F.concat("truth", F.lit("\n"), wide)).when(k == 8, F.concat(headed, F.lit("\n"), table, F.lit("\n"), "truth")).when(k == 9, wide).otherwise(F.col("truth"))
    )
    found = clean.stitched(S.pages(spark, sf_dir).select("doc", "page_no", text.alias("markdown")))
    return found.select("doc", "page_no", F.length("markdown").cast("bigint").alias("n_chars"), F.md5("markdown").alias("digest"))


#: Lines that one task makes into parse documents, about.
_LINES = 100_000


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested parse documents: two lines a page as blocks, a section for each return flag, which refers to some block that there is not.

    Lines and orders are dealt by run, once, to as many tasks as their number asks for: lines become pages and these a
    document where they are, and sections follow from the document's own lines.
    """
    li, o = S.read(spark, sf_dir, "lineitem"), S.read(spark, sf_dir, "orders")
    text = lambda c: F.col(c).cast("string")
    named_run = lambda key: F.concat(F.lit("r-"), text(key))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // _LINES))
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus").repartition(parts, named_run("l_orderkey"))
    # in order, the first line of a number is the least one, and the lines of a page follow each other: numbers 2k - 1 and 2k, and 0 on the first
    held = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")))
    rows = li.filter("l_orderkey is not null").groupBy("l_orderkey", named_run("l_orderkey").alias("run")).agg(held.alias("held"))
    rows = rows.select("l_orderkey", "run", F.filter("held", lambda x, i: (i == 0) | ~x["l_linenumber"].eqNullSafe(F.get("held", i - 1)["l_linenumber"])).alias("held"))
    none, number = lambda t: F.lit(None).cast(t), lambda c: c.cast("string")

    def line(x):
        page, n, named = F.call_function("div", x["l_linenumber"] - 1, F.lit(2)).cast("int") + 1, x["l_linenumber"].cast("int"), F.concat(F.lit("part "), number(x["l_partkey"]))
        block = F.struct(
            F.concat_ws("-", F.lit("b"), text("l_orderkey"), number(x["l_linenumber"])).alias("id"), F.concat_ws("-", F.lit("p"), text("l_orderkey"), number(page)).alias("page_id"), F.when(x["l_linestatus"] == "F", "table").otherwise("paragraph").alias("type"), named.alias("text"),
            F.when(x["l_quantity"] > 25, F.concat(F.lit("**"), named, F.lit("** "))).otherwise(" ").alias("markdown"), none("int").alias("level"), none("array<double>").alias("bbox"), none("double").alias("confidence"), (-n).alias("reading_order"),
        )
        return F.struct(page.alias("page"), x["l_returnflag"].alias("flag"), n.alias("n"), block.alias("block"))

    rows = rows.select("l_orderkey", "run", F.transform("held", line).alias("lines"))
    starts = F.filter(F.transform("lines", lambda x, i: F.when((i == 0) | ~x["page"].eqNullSafe(F.get("lines", i - 1)["page"]), i)), lambda i: i.isNotNull())
    rows = rows.select("l_orderkey", "run", "lines", starts.alias("starts"))

    def page(i):
        first = F.get("lines", i)
        blocks = F.sort_array(F.filter(F.slice("lines", i + 1, F.lit(3)), lambda x: x["page"].eqNullSafe(first["page"]))["block"])
        return F.struct(first["block"]["page_id"].alias("id"), first["page"].alias("page_number"), none("double").alias("width"), none("double").alias("height"), none("double").alias("rotation"), F.struct(none("string").alias("source_text")).alias("metadata"), blocks.alias("blocks"))

    def section(flag):
        held = F.filter("lines", lambda x: x["flag"].eqNullSafe(flag))
        ids = F.sort_array(F.transform(held, lambda x: F.when(x["n"] == 5, F.concat(F.lit("lost-"), x["block"]["id"])).otherwise(x["block"]["id"])))
        return F.struct(F.concat_ws("-", F.lit("s"), text("l_orderkey"), flag).alias("id"), flag.alias("title"), F.array(flag).alias("heading_path"), F.lit(1).alias("level"), F.array_min(held["page"]).alias("page_start"), F.array_max(held["page"]).alias("page_end"), ids.alias("block_ids"), none("string").alias("markdown"))

    whole = rows.select("run", F.transform("starts", page).alias("pages"), F.sort_array(F.transform(F.array_distinct(F.col("lines.flag")), section)).alias("sections"))
    doc = F.struct(F.concat(F.lit("d-"), text("o_custkey")).alias("id"), none("string").alias("filename"), none("string").alias("sha256"), none("int").alias("page_count"))
    o = o.select("o_orderkey", "o_custkey", "o_orderpriority").repartition(parts, named_run("o_orderkey")).select(named_run("o_orderkey").alias("run"), doc.alias("document"), F.col("o_orderpriority").alias("profile_name"))
    return whole.join(o, "run").select("document", F.struct(F.col("run").alias("id"), "profile_name").alias("parse_run"), "pages", "sections")


def parse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the parse documents, loaded twice over, so each is there once."""
    docs = _parsed(spark, sf_dir)
    return canonical.graph(docs.union(docs))


def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canonical.pages(_parsed(spark, sf_dir))
    return found.select("run", "page_id", F.col("page_number").cast("bigint").alias("page_number"), "markdown")


def refused_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sections that cannot be created, and why."""
    nodes, c = S.tree(spark, sf_dir), F.col("c_custkey")
    text = lambda n: n.cast("string")
    new = S.read(spark, sf_dir, "customer").select(
        F.when(c % 11 == 0, -c).otherwise(F.col("c_nationkey")).cast("bigint").alias("doc"), F.concat(F.when(c % 5 == 0, "c:").otherwise("n:"), text(c)).alias("id"),
        F.when(c % 3 == 0, F.concat(F.lit("s:"), "c_mktsegment")).when(c % 3 == 1, "gone").alias("parent"), F.when(c % 7 == 0, " \n").otherwise(F.col("c_name")).alias("title"), F.when(c % 4 == 0, F.col("c_mktsegment")).when(c % 4 == 1, " ").alias("section_type"),
    )
    return tree.refused(nodes, new, spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "type_name string"))


def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of a run with what was observed of their rows as they passed."""
    folder, count = segments.new_folder(spark, "stages"), F.count("*")
    pages, one = runs.measured(S.pages(spark, sf_dir).select("doc", "page_no", F.col("truth").alias("markdown")), "pages", f"{folder}/1", rows=count, characters=F.sum(F.length("markdown")))
    lines, two = runs.measured(clean.page_lines(pages), "lines", f"{folder}/2", rows=count, blank=F.sum((T.strip(F.col("line")) == "").cast("int")))
    _, three = runs.measured(clean.boilerplate(pages, 0.10), "boilerplate", f"{folder}/3", rows=count, most=F.max("pages_with"))
    return runs.progress_report(spark, "r", [one, two, three]).select("stage", "metric", F.col("value").cast("bigint").alias("value"))


_SLUGGED = _PLACED + r""", based AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM placed), slugged AS (SELECT *, base || CASE WHEN row_number() OVER (PARTITION BY doc, wiki_parent, base ORDER BY place) = 1 THEN '' ELSE '-' || row_number() OVER (PARTITION BY doc, wiki_parent, base ORDER BY place) END AS slug FROM based),
  routed AS (SELECT a.*, concat_ws('/', a.doc::VARCHAR, c.slug, b.slug, a.slug) AS route FROM slugged a LEFT JOIN slugged b ON b.doc = a.doc AND b.id = a.wiki_parent LEFT JOIN slugged c ON c.doc = a.doc AND c.id = b.wiki_parent),
  listing AS (SELECT n.doc, n.parent AS id, '## Contents' || chr(10) || chr(10) || string_agg('- [' || r.title || '](/' || r.route || ')' || chr(10), '' ORDER BY n.lft) AS items FROM routed r JOIN nested n USING (doc, id) WHERE n.parent IS NOT NULL GROUP BY 1, 2),
  gen AS (SELECT r.doc, r.id, r.title, r.wiki_parent, r.place, r.route, n.lft, CASE WHEN n.level = 3 THEN 'Order ' || n.title WHEN n.d > 0 THEN coalesce(items, '') ELSE '# ' || n.title || chr(10) END AS content FROM routed r JOIN nested n USING (doc, id) LEFT JOIN listing USING (doc, id)),
  keys AS (SELECT doc, id, lft, include, title, lft % 3 <> 0 AND lft % 5 <> 0 AS kept, CASE WHEN lft % 3 <> 0 AND lft % 5 <> 0 THEN 'p-' || doc || '-' || id ELSE 'w-' || left(sha256(doc || chr(31) || id), 16) END AS key FROM nested)"""
_TEXTS = SPANS + """, sec AS (SELECT doc, id, parent, page_start, page_end, lft, parent IS NULL AS is_group, lft % 4 <> 2 AS include, parent IS NULL AND page_start % 8 = 1 AS bare, CASE WHEN NOT (parent IS NULL AND page_start % 8 = 1) THEN trim(markdown, E' \\n\\t\\r') END AS markdown FROM spans_v),
in_cover AS (SELECT p.doc, p.page, arg_min(s.id, {'w': s.page_end - s.page_start, 'l': s.lft}) AS id FROM (SELECT DISTINCT doc, n AS page FROM internal_v) p JOIN sec s ON s.include AND s.doc = p.doc AND p.page BETWEEN s.page_start AND s.page_end GROUP BY 1, 2),
hits AS (SELECT i.doc, i.id, c.id AS target FROM internal_v i JOIN sec s ON s.doc = i.doc AND s.id = i.id AND NOT s.bare JOIN in_cover c ON c.doc = i.doc AND c.page = i.n WHERE c.id <> i.id)"""
_STITCH = PAGES + r""", texts AS (SELECT doc, page_no, CASE WHEN k < 3 THEN t WHEN k = 3 THEN h WHEN k = 4 THEN truth || chr(10) || h || chr(10) WHEN k = 5 THEN chr(10) || chr(10) || t || chr(10) || truth || chr(10) || t WHEN k = 6 THEN w || chr(10) || truth WHEN k = 7 THEN truth || chr(10) || w WHEN k = 8 THEN h || chr(10) || t || chr(10) || truth WHEN k = 9 THEN w ELSE truth END AS md
    FROM (SELECT *, doc_id % 11 AS k, '|' || doc_id || '|x|' AS t, '|a|b|' || chr(10) || '|---|---|' || chr(10) || '|' || doc_id || '|x|' AS h, '|1|2|3|' || chr(10) || '|4|5|6|' AS w FROM pages_v)),
  split AS (SELECT *, string_split(regexp_replace(regexp_replace(md, '^\n+', ''), '\s+$', ''), chr(10)) AS ls FROM texts),
  flags AS (SELECT *, list_transform(ls, lambda x: regexp_matches(x, '^\s*\|.*\|\s*$')) AS f FROM split),
  edge AS (SELECT *, CASE WHEN list_contains(f, false) THEN list_position(f, false) - 1 ELSE len(f) END AS lead_n, CASE WHEN list_contains(f, false) THEN list_position(list_reverse(f), false) - 1 ELSE len(f) END AS tail_n FROM flags),
  cols AS (SELECT *, CASE WHEN lead_n > 0 THEN len(string_split(trim(trim(ls[1]), '|'), '|')) END AS lead_c, CASE WHEN tail_n > 0 THEN len(string_split(trim(trim(ls[len(ls) - tail_n + 1]), '|'), '|')) END AS tail_c FROM edge),
  meet AS (SELECT *, coalesce(tail_c = lead(lead_c) OVER (PARTITION BY doc ORDER BY page_no), false) AS meets, lead_n = len(ls) AS whole FROM cols),
  walk AS (SELECT doc, page_no, meets AS joins FROM meet WHERE page_no = 1 UNION ALL SELECT m.doc, m.page_no, m.meets AND NOT (m.whole AND w.joins) FROM walk w JOIN meet m ON m.doc = w.doc AND m.page_no = w.page_no + 1),
  paired AS (SELECT m.*, w.joins, coalesce(lag(w.joins) OVER p, false) AS given, lead(CASE WHEN lead_n >= 2 AND regexp_matches(ls[2], '^\s*\|[\s:|-]+\|\s*$') THEN ls[3:lead_n] ELSE ls[1:lead_n] END) OVER p AS more FROM meet m JOIN walk w USING (doc, page_no) WINDOW p AS (PARTITION BY m.doc ORDER BY m.page_no)),
  left_ AS (SELECT *, CASE WHEN given THEN trim(array_to_string(ls[lead_n + 1:], chr(10)), E' \n\t') ELSE md END AS own FROM paired),
  out_ AS (SELECT doc, page_no, CASE WHEN joins THEN trim(regexp_replace(own, '\s+$', '') || chr(10) || array_to_string(more, chr(10)), E' \n\t') ELSE own END AS markdown FROM left_)"""

ORACLES = {
    "wiki_merge": f"WITH {_SLUGGED}" + """ SELECT k.key AS wiki_id, g.doc, CASE WHEN NOT k.kept THEN 'insert' WHEN g.lft % 2 = 0 THEN 'same' ELSE CASE WHEN g.title = 'Old' THEN 'same' ELSE 'update' END END AS action, CASE WHEN k.kept THEN 1 ELSE 2 END::BIGINT AS created, g.title, p.key AS parent_id, g.place, g.route, md5(g.content) AS digest
        FROM gen g JOIN keys k USING (doc, id) LEFT JOIN keys p ON p.doc = g.doc AND p.id = g.wiki_parent
        UNION ALL SELECT key, doc, 'delete', 1, title, NULL, NULL, NULL, NULL FROM keys WHERE kept AND NOT include
        UNION ALL SELECT 'other', -1, 'keep', 1, 'Other', NULL, NULL, NULL, NULL""",
    "wiki_pages": f"WITH {_TEXTS}" + r""", anc AS (SELECT s.doc, s.id, s.lft, CASE WHEN p.include THEN s.parent END AS up FROM sec s LEFT JOIN sec p ON p.doc = s.doc AND p.id = s.parent WHERE s.include),
        routed AS (SELECT a.*, concat_ws('/', a.doc, a.up, a.id) AS route FROM anc a), items AS (SELECT s.doc, s.parent AS id, sum(length('- [](/)' || s.id || r.route || chr(10))) + 13 AS n FROM routed r JOIN sec s USING (doc, id) WHERE s.parent IS NOT NULL GROUP BY 1, 2),
        linked AS (SELECT h.doc, h.id, count(*) AS links, sum(length('[](/' || r.route || ')')) AS more FROM hits h JOIN routed r ON r.doc = h.doc AND r.id = h.target GROUP BY 1, 2)
        SELECT s.doc, s.id, s.id AS slug, r.route, coalesce(links, 0) AS links, (CASE WHEN s.bare THEN coalesce(i.n, 0) ELSE length(s.markdown) END + coalesce(more, 0))::BIGINT AS n_chars FROM sec s JOIN routed r USING (doc, id) LEFT JOIN items i ON i.doc = s.doc AND i.id = s.id LEFT JOIN linked l ON l.doc = s.doc AND l.id = s.id""",
    "replaced_trees": f"WITH {TREE} SELECT doc, id, parent, CASE WHEN doc % 3 = 0 THEN 'New ' || title ELSE title END AS title FROM tree_v WHERE doc % 6 <> 0",
    "streamed_edges": f"WITH {SPANS} SELECT doc, from_id, to_id, target_page::BIGINT AS target_page, anchor, occurrences FROM edges_v",
    "section_preview": f"WITH {_TEXTS}" + r""", items AS (SELECT doc, parent AS id, '## Contents' || chr(10) || chr(10) || string_agg('- [' || id || '](/section-preview/' || id || ')' || chr(10), '' ORDER BY lft) AS list FROM sec WHERE include AND parent IS NOT NULL GROUP BY 1, 2),
        linked AS (SELECT doc, id, count(*) AS links, sum(length('[](/section-preview/' || target || ')')) AS more FROM hits GROUP BY 1, 2), body AS (SELECT s.*, CASE WHEN bare THEN coalesce(list, '') ELSE markdown END AS content FROM sec s LEFT JOIN items USING (doc, id))
        SELECT b.doc, b.id, concat_ws(' > ', CASE WHEN b.doc LIKE '%1' THEN 'Project' ELSE 'Library' END, 'Title of ' || b.doc, b.parent, b.id) AS breadcrumb, md5(content) AS digest, (length(content) + coalesce(more, 0))::BIGINT AS n_chars, coalesce(links, 0) AS resolved, include, 0::BIGINT AS lint FROM body b LEFT JOIN linked USING (doc, id)""",
    "stitched_pages": f"WITH RECURSIVE {_STITCH} SELECT doc, page_no, length(markdown) AS n_chars, md5(markdown) AS digest FROM out_",
    "refused_sections": f"WITH {TREE}" + """, new AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN -c_custkey ELSE c_nationkey END::BIGINT AS doc, CASE WHEN c_custkey % 5 = 0 THEN 'c:' ELSE 'n:' END || c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 's:' || c_mktsegment WHEN 1 THEN 'gone' END AS parent, c_custkey % 7 = 0 AS blank, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS kind FROM customer),
        r AS (SELECT n.doc, n.id, CASE WHEN blank THEN 'blank title' WHEN n.doc NOT IN (SELECT doc FROM tree_v) THEN 'unknown document' WHEN n.parent IS NOT NULL AND u.id IS NULL THEN 'unknown parent' WHEN o.id IS NOT NULL THEN 'id taken' WHEN kind NOT IN ('BUILDING', 'MACHINERY') THEN 'unknown type' END AS reason
          FROM new n LEFT JOIN tree_v u ON u.doc = n.doc AND u.id = n.parent LEFT JOIN tree_v o ON o.doc = n.doc AND o.id = n.id) SELECT * FROM r WHERE reason IS NOT NULL""",
    "stage_metrics": f"WITH {PAGES}" + r""", ln AS (SELECT doc, page_no, unnest(string_split(regexp_replace(truth, '\n$', ''), chr(10))) AS line FROM pages_v), n AS (SELECT doc, count(*) AS n FROM pages_v GROUP BY 1),
        b AS (SELECT doc, form, count(*) AS pages_with FROM (SELECT DISTINCT doc, page_no, lower(trim(regexp_replace(line, '[#*_`>\-\s]+', ' ', 'g'))) AS form FROM ln) JOIN n USING (doc) WHERE form <> '' AND length(form) <= 90 GROUP BY doc, form, n HAVING count(*) >= greatest(3, floor(0.10 * n)))
        SELECT 'pages' AS stage, 'rows' AS metric, count(*)::BIGINT AS value FROM pages_v UNION ALL SELECT 'pages', 'characters', sum(length(truth))::BIGINT FROM pages_v UNION ALL SELECT 'lines', 'rows', count(*) FROM ln UNION ALL SELECT 'lines', 'blank', sum((trim(line) = '')::INT)::BIGINT FROM ln
        UNION ALL SELECT 'boilerplate', 'rows', count(*) FROM b UNION ALL SELECT 'boilerplate', 'most', coalesce(max(pages_with), 0) FROM b""",
}
_FRAGMENTS = """WITH f AS (SELECT 'call' || conv_id AS call, (turn % 3)::BIGINT AS index, turn, CASE WHEN turn % 4 < 2 THEN conv_id || '-' || turn END AS id, CASE WHEN turn % 2 = 0 THEN role END AS name, CASE WHEN turn % 5 <> 4 THEN text ELSE '' END AS part FROM conversations)
        SELECT call, index, coalesce(arg_max(id, turn) FILTER (WHERE id IS NOT NULL), '') AS id, coalesce(arg_max(name, turn) FILTER (WHERE coalesce(name, '') <> ''), '') AS name, md5(string_agg(part, '' ORDER BY turn)) AS digest, count(*) AS fragments FROM f GROUP BY 1, 2"""
_PROJECTS = SPANS + """, w AS (SELECT doc, from_id, to_id, sum(occurrences)::BIGINT AS weight FROM edges_v GROUP BY 1, 2, 3), ends AS (SELECT doc, from_id AS id, weight FROM w UNION ALL SELECT doc, to_id, weight FROM w), deg AS (SELECT doc, id, sum(weight)::BIGINT AS degree FROM ends GROUP BY 1, 2),
own AS (SELECT n_name AS project, doc FROM counts_v JOIN nation ON n_nationkey = TRY_CAST(substr(doc, 4) AS BIGINT)),
rows_v AS (SELECT project, doc, 'document' AS part, 'doc:' || doc AS source, NULL AS target, upper(doc) AS label, NULL::BIGINT AS value FROM own
  UNION ALL SELECT project, s.doc, 'node', s.id, NULL, section_type, coalesce(degree, 0) FROM spans_v s JOIN own USING (doc) LEFT JOIN deg ON deg.doc = s.doc AND deg.id = s.id
  UNION ALL SELECT project, s.doc, 'structure', CASE WHEN parent IS NULL THEN 'doc:' || s.doc ELSE s.id END, coalesce(parent, s.id), CASE WHEN parent IS NULL THEN 'HAS_SECTION' ELSE 'PART_OF' END, NULL FROM spans_v s JOIN own USING (doc)
  UNION ALL SELECT project, w.doc, 'reference', from_id, to_id, NULL, weight FROM w JOIN own USING (doc))"""
_BLOCKS = """b AS (SELECT 'r-' || l_orderkey AS run, 'd-' || o_custkey AS doc, 'p-' || l_orderkey || '-' || ((l_linenumber - 1) // 2 + 1) AS page, (l_linenumber - 1) // 2 + 1 AS page_no, 'b-' || l_orderkey || '-' || l_linenumber AS block, 's-' || l_orderkey || '-' || l_returnflag AS section, l_linestatus = 'F' AS is_table, l_linenumber AS n,
  CASE WHEN l_quantity > 25 THEN '**' || 'part ' || l_partkey || '**' ELSE 'part ' || l_partkey END AS shown
  FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) = 1) JOIN orders ON o_orderkey = l_orderkey)"""
ORACLES |= {
    "joined_fragments": _FRAGMENTS,
    "project_graph": f"WITH {_PROJECTS} SELECT * FROM rows_v",
    "project_graph_counts": f"WITH {_PROJECTS} SELECT n_name AS project, count(*) FILTER (WHERE part = 'document') AS documents, count(*) FILTER (WHERE part = 'node') AS nodes, count(*) FILTER (WHERE part IN ('structure', 'reference')) AS edges, count(DISTINCT CASE WHEN part = 'node' THEN label END) AS types FROM nation LEFT JOIN rows_v ON project = n_name GROUP BY 1",
    "parse_graph": f"WITH {_BLOCKS}" + """, e AS (SELECT run, 'DOCUMENT_HAS_PAGE' AS type, doc AS source, page AS target FROM b UNION SELECT run, 'PAGE_HAS_BLOCK', page, block FROM b UNION SELECT run, 'BLOCK_PART_OF_SECTION', block, section FROM b WHERE n <> 5 UNION SELECT run, 'SECTION_HAS_TABLE', section, block FROM b WHERE n <> 5 AND is_table)
        SELECT run, run || ':edge:' || type || ':' || source || ':' || target AS edge_id, type, source, target FROM e""",
    "parse_pages": f"WITH {_BLOCKS} SELECT run, page AS page_id, any_value(page_no)::BIGINT AS page_number, string_agg(shown, chr(10) || chr(10) ORDER BY -n) AS markdown FROM b GROUP BY 1, 2",
}

QUERIES = {
    f.__name__: f
    for f in (
        wiki_merge, wiki_pages, replaced_trees, streamed_edges, joined_fragments, section_preview, project_graph, project_graph_counts, stitched_pages, parse_graph, parse_pages, refused_sections, stage_metrics,
    )
}
