"""Queries on edits: of trees, bodies, pages and the wiki, and what they make stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import editing, graph, refs, tree, wiki
from quire.plans.views import PAGES, SPANS, TABLE_LINES, TREE
from quire.sources import tables as S

_BODY = "case when id like 'c:%' then concat('Top of ', id, '\\n\\n ## part TWO \\nrest ', id, '\\n') end"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with bodies of two parts for customers, and page ranges, some unset."""
    place = F.coalesce(F.substring("id", 3, 20).try_cast("bigint"), F.lit(0))
    t = S.tree(spark, sf_dir).withColumns({"markdown": F.expr(_BODY), "page_start": F.when(place % 7 > 0, place % 7), "page_end": F.when(place % 7 > 0, place % 7 + place % 3)})
    return tree.nested_set(t)


def _customers(found: DataFrame) -> DataFrame:
    return found.filter("level = 2").select("doc", "id", "parent", F.col("sort_order").cast("bigint").alias("sort_order"))


def tree_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    at = nodes.filter("id like 'c:%0'").select("doc", "id", F.lit("# Part two").alias("heading"), F.concat("id", F.lit("+")).alias("new_id"))
    return tree.split(nodes, at).select("doc", "id", "title", F.md5("markdown").alias("digest"), F.col("lft").cast("bigint").alias("lft"), F.col("rgt").cast("bigint").alias("rgt"))


def tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings of sort_order 0 merged into the one of least id."""
    nodes = _nodes(spark, sf_dir)
    group = nodes.filter("level = 2 and sort_order = 0").select("doc", "parent", "id")
    keep = group.groupBy("doc", "parent").agg(F.min("id").alias("keep"))
    found = tree.merge(nodes, group.join(keep, ["doc", "parent"]).select("doc", "keep", "id"))
    return found.filter("level = 2").select("doc", "id", "page_start", "page_end", F.md5("markdown").alias("digest"), ((F.col("rgt") - F.col("lft") - 1) / 2).cast("bigint").alias("children"))


def tree_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of sort_order 1 moved to the start of their document's first segment."""
    nodes = _nodes(spark, sf_dir)
    first = nodes.filter("level = 1").groupBy("doc").agg(F.min("id").alias("parent"))
    return _customers(tree.move(nodes, nodes.filter("level = 2 and sort_order = 1").select("doc", "id").join(first, "doc").select("doc", "id", "parent", F.lit(0).alias("index"))))


def tree_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    listed = nodes.filter("level = 2").groupBy("doc", "parent").agg(F.sort_array(F.collect_list("id"), False).alias("siblings"))
    return _customers(tree.reorder(nodes, listed.select("doc", "siblings")))


def tree_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    names = nodes.filter("level = 1").select("doc", "id", F.concat(F.lit("New "), "title").alias("title"))
    return tree.rename(nodes, names).select("doc", "id", F.concat_ws(" > ", "path").alias("path"))


def tree_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row at place 1 and one at the end of each segment, and one under a parent that there is not."""
    nodes = _nodes(spark, sf_dir)
    new = nodes.filter("level = 1").select("doc", F.col("id").alias("parent"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).cast("int").alias("index"), F.lit(c).alias("lost")) for a, b, c in (("n", 1, False), ("z", None, False), ("x", 0, True))])).alias("w"))
    new = new.select("doc", F.concat("w.a", F.lit(":"), "parent").alias("id"), F.when(F.col("w.lost"), F.lit("gone")).otherwise(F.col("parent")).alias("parent"), F.lit("New").alias("title"), F.lit(True).alias("include"), "w.index")
    return _customers(tree.create(nodes.drop("level", "path", "line", "is_group", "lft", "rgt"), new))


def tree_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.rendered(tree.nested_set(S.tree(spark, sf_dir))).select("doc", F.md5("outline").alias("digest"))


def section_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = S.span_texts(spark, sf_dir)
    edits = spans.filter("lft % 3 <> 0").select("doc", "id", F.when(F.col("lft") % 2 == 0, "refer to").otherwise("and ").alias("find"), F.lit("consult").alias("new"))
    return editing.edited_sections(spans.select("doc", "id", "markdown"), edits).select("doc", "id", F.col("found").cast("bigint").alias("found"), F.md5("markdown").alias("digest"))


def page_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.pages(spark, sf_dir)
    edits = p.filter("page_no % 2 = 0").select("doc", "page_no", F.lit(" zzz").alias("find"), F.lit("").alias("new"))
    found = editing.edited_pages(p.select("doc", "page_no", F.col("vlm").alias("adopted"), "baseline"), edits, S.spans(spark, sf_dir))
    return found.select("doc", "page_no", F.md5("markdown").alias("digest"), F.array_join("owners", ",").alias("owners"))


def rebuilt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections built from the whole texts of their pages, each with a line that all have, and some with a table without a separator."""
    table = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n|k"), F.col("doc_id").cast("string"), F.lit("|b|\n|"), F.col("doc_id").cast("string"), F.lit("|2|"))).otherwise("")
    text = F.concat("truth", F.lit("\nCommon line"), table, F.lit("\nPage 3 of 9"))
    p = S.page_texts(spark, sf_dir).select("doc", "page_no", F.when(F.col("doc_id") % 5 != 0, text).alias("markdown"))
    found = editing.rebuilt(S.spans(spark, sf_dir), p)
    return found.select("doc", "id", F.md5("markdown").alias("digest"), F.array_join("overlaps", ",").alias("shared_with"))


def approved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after documents whose name ends in 0 or 3 were approved: old ones with 100 occurrences more, those found anew without."""
    spans, counts, texts = S.spans(spark, sf_dir), S.page_counts(spark, sf_dir), S.span_texts(spark, sf_dir)
    old = refs.edges(texts, spans, counts).withColumn("occurrences", F.col("occurrences") + 100)
    chosen = counts.filter("doc like '%0' or doc like '%3'")
    status, edges = editing.approved(counts.select("doc", F.lit("Review").alias("status")), old, chosen, texts, spans, counts)
    return edges.groupBy("doc").agg(F.count("*").alias("edges"), F.sum("occurrences").alias("occurrences")).join(status, "doc", "right").na.fill(0)


def edges_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference edges after every third half was deleted, so edges go that leave it and that lead to it."""
    spans = S.spans(spark, sf_dir)
    found = refs.edges(S.span_texts(spark, sf_dir), spans, S.page_counts(spark, sf_dir))
    return refs.without_nodes(found, spans.filter("parent is not null and page_start % 3 = 0")).select("doc", "from_id", "to_id", F.col("target_page").cast("bigint").alias("target_page"), "occurrences")


def graph_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame([("type0", 3), ("type1", 2), ("type2", 1), ("unused", 0)], "type_name string, creation int")
    return graph.legend(S.spans(spark, sf_dir), types).select("type_name", "nodes", F.col("creation").cast("bigint").alias("creation"))


def _wiki_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = S.span_texts(spark, sf_dir)
    return spans.select("doc", "id", "markdown", "lft", F.when(F.col("lft") % 3 != 0, F.concat_ws(":", "doc", "id")).alias("wiki_id"), (F.col("lft") % 4 != 2).alias("include"), F.col("parent").isNull().alias("is_group"))


def wiki_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _wiki_sections(spark, sf_dir)
    pages = s.filter("wiki_id is not null and lft % 5 <> 0").select("wiki_id", F.concat(F.lit(" "), "markdown", F.when(F.col("lft") % 2 == 0, "\n").otherwise(" more")).alias("content"))
    return editing.drift(s, pages)


def wiki_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _wiki_sections(spark, sf_dir)
    pages = s.filter("wiki_id is not null").select("doc", "wiki_id", F.when(F.col("is_group"), 1).otherwise(2).alias("depth"))
    return wiki.stale(pages, s).select("doc", "wiki_id", F.col("depth").cast("bigint").alias("depth"))


def wiki_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _wiki_sections(spark, sf_dir).withColumn("markdown", F.when(F.col("lft") % 5 == 0, " \n").otherwise(F.col("markdown")))
    return wiki.sync_status(s)


def lint_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = editing.lint_summary(S.tables(spark, sf_dir), ["key"])
    return found.select("key", "lint", F.col("lint_count").cast("bigint").alias("lint_count"), "line")


def attachment_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attachments of a user's session; customers as documents, their orders as pages and sections."""
    e, c, o = (S.read(spark, sf_dir, t) for t in ("events", "customer", "orders"))
    n = F.col("event_id")
    kind = F.when(n % 4 == 0, "project").when(n % 4 == 1, "document").when(n % 4 == 2, "page").otherwise("section")
    name = F.when(n % 4 == 0, F.concat(F.lit("p"), (n % 9).cast("string"))).when(n % 4 == 1, F.concat(F.lit("d"), (n % 300).cast("string"))).otherwise(F.concat(F.lit("k"), (n % 4000).cast("string")))
    attached = e.select(F.col("user_id").alias("session"), n.alias("place"), kind.alias("kind"), name.alias("name"))
    documents = c.select(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("doc"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("p"), (F.col("c_custkey") % 5).cast("string"))).alias("project"))
    held = o.select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("doc"), (F.col("o_orderkey") % 2).alias("odd"))
    return editing.scopes(attached, documents, held.filter("odd = 0").select(F.col("key").alias("page"), "doc"), held.filter("odd = 1").select(F.col("key").alias("id"), "doc"))


def mutation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.read(spark, sf_dir, "events")
    layers = spark.createDataFrame([("view", 0, "section"), ("view", 1, "wiki"), ("click", 0, "tree"), ("purchase", 0, "wiki")], "tool string, at int, layer string")
    mutations = e.select(F.col("user_id").alias("turn"), F.col("event_id").alias("place"), F.col("event_type").alias("tool"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("d"), (F.col("event_id") % 7).cast("string"))).alias("doc"))
    found = editing.mutation_batches(mutations, layers)
    return found.select("turn", F.array_join("documents", ",").alias("documents"), F.array_join("layers", ",").alias("layers"), "count")


def page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as assets, some known by page number and some by page id alone; five pages an order."""
    li, o = S.read(spark, sf_dir, "lineitem"), S.read(spark, sf_dir, "orders")
    number = (F.col("l_partkey") % 6).cast("int")
    assets = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("place"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("asset"), F.when(F.col("l_linenumber") % 2 == 0, number).alias("page_number"), F.when(F.col("l_linenumber") % 2 == 1, F.format_string("page_%03d", number)).alias("page_id"))
    pages = o.select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page_no"))
    return editing.assets_of_pages(pages, assets)


_EDITED = TREE + f""", bodies AS (SELECT *, CASE WHEN id LIKE 'c:%' THEN 'Top of ' || id || chr(10) || chr(10) || ' ## part TWO ' || chr(10) || 'rest ' || id || chr(10) END AS markdown,
  CASE WHEN p % 7 > 0 THEN p % 7 END AS page_start, CASE WHEN p % 7 > 0 THEN p % 7 + p % 3 END AS page_end FROM (SELECT *, coalesce(TRY_CAST(substr(id, 3) AS BIGINT), 0) AS p FROM nested))"""
_WIKI = SPANS + """, sec AS (SELECT doc, id, markdown, lft, CASE WHEN lft % 3 <> 0 THEN doc || ':' || id END AS wiki_id, lft % 4 <> 2 AS include, parent IS NULL AS is_group FROM spans_v)"""
_DEEPEST = "held AS (SELECT p.doc, p.page_no AS page, s.id, s.lft, s.rgt FROM pages_v p JOIN spans_v s ON s.doc = p.doc AND p.page_no BETWEEN page_start AND page_end), deepest AS (SELECT doc, page, id FROM held h WHERE NOT EXISTS (SELECT 1 FROM held i WHERE i.doc = h.doc AND i.page = h.page AND i.lft > h.lft AND i.rgt < h.rgt))"
_OVERLAP = "meets AS (SELECT a.doc, a.id, string_agg(b.id, ',' ORDER BY b.id) AS shared_with FROM spans_v a JOIN spans_v b ON a.doc = b.doc AND a.page_start <= b.page_end AND b.page_start <= a.page_end AND NOT (a.lft <= b.lft AND a.rgt >= b.rgt) AND NOT (b.lft <= a.lft AND b.rgt >= a.rgt) GROUP BY 1, 2)"
_ISSUES = TABLE_LINES + """, every_issue AS (
  SELECT key, CASE WHEN n = 1 THEN 'lone_pipe_row' WHEN pos = 0 AND NOT has_sep THEN 'missing_separator' WHEN has_sep AND pos >= 2 AND NOT sep AND cells <> header THEN 'ragged_row' END AS code, line_no + 1 AS line FROM blocks_v
  UNION ALL SELECT key, 'unclosed_fence', 0 FROM fenced GROUP BY key HAVING sum(fence::INT) % 2 = 1),
issues_v AS (SELECT key, code, line, CASE WHEN line = 0 THEN 2147483647 ELSE line END AS spot FROM every_issue WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY spot) <= 8)"""

ORACLES = {
    "tree_split": f"WITH {_EDITED}" + """, parts AS (SELECT doc, id, title, level, k1, k2, k3, k4, markdown, false AS tail FROM bodies
            UNION ALL SELECT doc, id || '+', 'part TWO', 2, k1, k2, k3, '~', markdown, true FROM bodies WHERE id LIKE 'c:%0'),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY k1, k2, k3, k4) AS m2, CASE WHEN tail THEN 1 WHEN level = 1 THEN count(*) OVER (PARTITION BY doc, k1) WHEN level = 2 THEN count(*) FILTER (WHERE NOT tail) OVER (PARTITION BY doc, k3) ELSE 1 END - 1 AS d2 FROM parts)
        SELECT doc, id, title, md5(CASE WHEN tail THEN '## part TWO ' || chr(10) || 'rest ' || left(id, -1) WHEN id LIKE 'c:%0' THEN 'Top of ' || id ELSE markdown END) AS digest, 2 * m2 - level AS lft, 2 * m2 - level + 2 * d2 + 1 AS rgt FROM n""",
    "tree_merge": f"WITH {_EDITED}" + """, g AS (SELECT *, CASE WHEN sort_order = 0 THEN min(id) OVER (PARTITION BY doc, parent, sort_order) ELSE id END AS keep FROM bodies WHERE level = 2),
        one AS (SELECT doc, keep AS id, min(page_start) AS page_start, max(page_end) AS page_end, md5(CASE WHEN any_value(sort_order) = 0 THEN string_agg(trim(markdown, E' \n'), chr(10) || chr(10) ORDER BY id) ELSE any_value(markdown) END) AS digest FROM g GROUP BY 1, 2),
        kids AS (SELECT g.doc, g.keep AS id, count(*) AS children FROM g JOIN bodies b ON b.doc = g.doc AND b.parent = g.id GROUP BY 1, 2)
        SELECT one.*, coalesce(children, 0) AS children FROM one LEFT JOIN kids USING (doc, id)""",
    "tree_move": f"WITH {_EDITED}" + """, firsts AS (SELECT doc, min(id) AS target FROM bodies WHERE level = 1 GROUP BY 1),
        placed AS (SELECT b.doc, b.id, CASE WHEN sort_order = 1 THEN target ELSE parent END AS parent, CASE WHEN sort_order = 1 THEN -0.5 ELSE row_number() OVER (PARTITION BY b.doc, parent, sort_order = 1 ORDER BY sort_order, id) - 1 END AS place FROM bodies b JOIN firsts USING (doc) WHERE level = 2)
        SELECT doc, id, parent, row_number() OVER (PARTITION BY doc, parent ORDER BY place, id) - 1 AS sort_order FROM placed""",
    "tree_reorder": f"WITH {_EDITED} SELECT doc, id, parent, row_number() OVER (PARTITION BY doc, parent ORDER BY id DESC) - 1 AS sort_order FROM bodies WHERE level = 2",
    "tree_rename": f"WITH {_EDITED} SELECT doc, id, CASE level WHEN 1 THEN 'New ' || title WHEN 2 THEN 'New ' || title || ' > ' || title ELSE 'New ' || substr(k1, 3) || ' > ' || substr(k1, 3) || ' > ' || title END AS path FROM bodies",
    "tree_create": f"WITH {_EDITED}" + """, placed AS (SELECT doc, id, parent, row_number() OVER (PARTITION BY doc, parent ORDER BY sort_order, id) - 1 AS place FROM bodies WHERE level = 2
            UNION ALL SELECT doc, 'n:' || id, id, 0.5 FROM bodies WHERE level = 1 UNION ALL SELECT doc, 'z:' || id, id, 1000000 FROM bodies WHERE level = 1)
        SELECT doc, id, parent, row_number() OVER (PARTITION BY doc, parent ORDER BY place, id) - 1 AS sort_order FROM placed""",
    "tree_outline": f"WITH {TREE} SELECT doc, md5(string_agg(repeat('  ', level - 1) || title, chr(10) ORDER BY lft)) AS digest FROM nested GROUP BY doc",
    "section_edits": f"WITH {SPANS}" + """, e AS (SELECT *, CASE WHEN lft % 3 <> 0 THEN CASE WHEN lft % 2 = 0 THEN 'refer to' ELSE 'and ' END END AS find FROM spans_v),
        f AS (SELECT *, (length(markdown) - length(replace(markdown, find, ''))) // length(find) AS found FROM e)
        SELECT doc, id, found, md5(CASE WHEN found = 1 THEN replace(markdown, find, 'consult') ELSE markdown END) AS digest FROM f""",
    "page_edits": f"WITH {SPANS}, {_DEEPEST}" + """, t AS (SELECT doc, page_no, coalesce(nullif(vlm, ''), nullif(baseline, ''), '') AS old FROM pages_v WHERE page_no % 2 = 0)
        SELECT t.doc, t.page_no, md5(replace(any_value(old), ' zzz', '')) AS digest, coalesce(string_agg(d.id, ',' ORDER BY d.id), '') AS owners FROM t LEFT JOIN deepest d ON d.doc = t.doc AND d.page = t.page_no WHERE length(old) - length(replace(old, ' zzz', '')) = 4 GROUP BY t.doc, t.page_no""",
    "rebuilt_sections": f"WITH {SPANS}, {_OVERLAP}" + r""", held AS (SELECT s.doc, s.id, p.page_no, p.doc_id, CASE WHEN p.doc_id % 5 <> 0 THEN truth || chr(10) || 'Common line' || CASE WHEN p.doc_id % 3 = 0 THEN chr(10) || '|k' || p.doc_id || '|b|' || chr(10) || '|' || p.doc_id || '|2|' ELSE '' END || chr(10) || 'Page 3 of 9' ELSE '' END AS markdown
          FROM spans_v s JOIN pages_v p ON p.doc = s.doc AND p.page_no BETWEEN s.page_start AND s.page_end),
        ln AS (SELECT doc, id, page_no, doc_id, unnest(range(len(string_split(markdown, chr(10))))) AS k, unnest(string_split(markdown, chr(10))) AS line FROM held),
        fm AS (SELECT *, lower(trim(regexp_replace(line, '[#*_`>\-\s]+', ' ', 'g'))) AS form FROM ln), ct AS (SELECT doc, id, count(*) AS n FROM held GROUP BY 1, 2),
        common AS (SELECT doc, id, form FROM (SELECT DISTINCT doc, id, page_no, form FROM fm) JOIN ct USING (doc, id) WHERE form <> '' AND length(form) <= 90 GROUP BY doc, id, form, n HAVING count(*) >= greatest(3, floor(0.30 * n))),
        kept AS (SELECT * FROM fm f WHERE NOT regexp_matches(line, '(?i)\bpage\s*\d+\s*of\s*\d+') AND NOT EXISTS (SELECT 1 FROM common c WHERE c.doc = f.doc AND c.id = f.id AND c.form = f.form)),
        page AS (SELECT doc, id, page_no, trim(replace(string_agg(line, chr(10) ORDER BY k), '|k' || any_value(doc_id) || '|b|', '|k' || any_value(doc_id) || '|b|' || chr(10) || '|---|---|'), E' \n\t\r') AS body FROM kept GROUP BY 1, 2, 3),
        built AS (SELECT s.doc, s.id, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY page_no) FILTER (WHERE body <> ''), '') AS markdown FROM (SELECT DISTINCT doc, id FROM held) s LEFT JOIN page USING (doc, id) GROUP BY 1, 2)
        SELECT doc, id, md5(markdown) AS digest, coalesce(shared_with, '') AS shared_with FROM built LEFT JOIN meets USING (doc, id)""",
    "approved_edges": f"WITH {SPANS}" + """, st AS (SELECT doc, CASE WHEN doc LIKE '%0' OR doc LIKE '%3' THEN 'Graphed' ELSE 'Review' END AS status FROM counts_v)
        SELECT st.doc, count(e.from_id) AS edges, coalesce(sum(e.occurrences + CASE WHEN status = 'Review' THEN 100 ELSE 0 END), 0)::BIGINT AS occurrences, any_value(status) AS status FROM st LEFT JOIN edges_v e ON e.doc = st.doc GROUP BY st.doc""",
    "edges_without": f"WITH {SPANS} SELECT e.doc, from_id, to_id, target_page::BIGINT AS target_page, occurrences FROM edges_v e JOIN spans_v a ON a.doc = e.doc AND a.id = from_id JOIN spans_v b ON b.doc = e.doc AND b.id = to_id WHERE NOT (a.parent IS NOT NULL AND a.page_start % 3 = 0) AND NOT (b.parent IS NOT NULL AND b.page_start % 3 = 0)",
    "graph_legend": f"WITH {SPANS} SELECT section_type AS type_name, count(*) AS nodes, (3 - right(section_type, 1)::INT)::BIGINT AS creation FROM spans_v WHERE section_type IS NOT NULL GROUP BY 1",
    "wiki_drift": f"WITH {_WIKI} SELECT doc, id, CASE WHEN wiki_id IS NULL OR lft % 5 = 0 THEN 'no_page' WHEN lft % 2 = 1 THEN 'drift' ELSE 'same' END AS state FROM sec",
    "wiki_stale": f"WITH {_WIKI} SELECT doc, wiki_id, CASE WHEN is_group THEN 1 ELSE 2 END::BIGINT AS depth FROM sec WHERE wiki_id IS NOT NULL AND NOT include",
    "wiki_sync": f"WITH {_WIKI} SELECT doc, id, CASE WHEN NOT include THEN 'excluded' WHEN wiki_id IS NULL THEN 'no_wiki_document' WHEN is_group AND lft % 5 = 0 THEN 'needs_regenerate' END AS reason FROM sec",
    "lint_context": f"WITH {_ISSUES}" + """ SELECT t.key, CASE WHEN count(code) > 0 THEN '[' || string_agg('{"code":"' || code || '","line":' || line || '}', ',' ORDER BY spot) || ']' END AS lint, count(code) AS lint_count,
        coalesce(string_agg(code || CASE WHEN line > 0 THEN ' (line ' || line || ')' ELSE '' END, '; ' ORDER BY spot), '') AS line FROM tables_v t LEFT JOIN issues_v i ON i.key = t.key GROUP BY t.key""",
    "attachment_scopes": """WITH a AS (SELECT user_id AS session, event_id AS place, event_id % 4 AS k, event_id AS n FROM events),
        d AS (SELECT 'd' || c_custkey AS doc, CASE WHEN c_custkey % 3 <> 0 THEN 'p' || c_custkey % 5 END AS project FROM customer),
        r AS (SELECT a.*, CASE WHEN k = 1 THEN d.doc WHEN k >= 2 THEN 'd' || o.o_custkey END AS doc, CASE WHEN k = 0 AND ('p' || n % 9) IN (SELECT project FROM d WHERE project IS NOT NULL) THEN 'p' || n % 9 END AS own
          FROM a LEFT JOIN d ON k = 1 AND d.doc = 'd' || n % 300 LEFT JOIN orders o ON k >= 2 AND o.o_orderkey = n % 4000 AND o.o_orderkey % 2 = k - 2),
        f AS (SELECT session, arg_min(doc, place) FILTER (WHERE doc IS NOT NULL) AS document, arg_min(own, place) FILTER (WHERE own IS NOT NULL) AS explicit FROM r GROUP BY 1)
        SELECT session, document, coalesce(explicit, project) AS project FROM f LEFT JOIN d ON d.doc = f.document""",
    "mutation_batches": """WITH l(tool, spot, layer) AS (VALUES ('view', 0, 'section'), ('view', 1, 'wiki'), ('click', 0, 'tree'), ('purchase', 0, 'wiki')),
        t AS (SELECT user_id AS turn, coalesce(layer, 'document') AS layer, min({'p': event_id, 'a': coalesce(spot, 0)}) AS first FROM events LEFT JOIN l ON tool = event_type GROUP BY 1, 2),
        y AS (SELECT turn, string_agg(layer, ',' ORDER BY first) AS layers FROM t GROUP BY 1)
        SELECT user_id AS turn, coalesce(string_agg(DISTINCT 'd' || event_id % 7, ',' ORDER BY 'd' || event_id % 7) FILTER (WHERE event_id % 5 <> 0), '') AS documents, any_value(layers) AS layers, count(*) AS count FROM events JOIN y ON turn = user_id GROUP BY 1""",
    "page_assets": "SELECT o_orderkey AS doc, p AS page_no, arg_min(l_orderkey || '-' || l_linenumber, l_linenumber) AS asset FROM orders CROSS JOIN range(1, 6) r(p) LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_partkey % 6 = p GROUP BY 1, 2",
}

QUERIES = {
    f.__name__: f
    for f in (
        tree_split, tree_merge, tree_move, tree_reorder, tree_rename, tree_create, tree_outline, section_edits, page_edits, rebuilt_sections, approved_edges, edges_without, graph_legend, wiki_drift, wiki_stale, wiki_sync,
        lint_context, attachment_scopes, mutation_batches, page_assets,
    )
}
