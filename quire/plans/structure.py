"""Queries on sections, trees, page references, graphs and the wiki projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import explore, graph, refs, sectionize, tree, wiki
from quire.plans.views import MARKDOWN, SPANS, TREE
from quire.sources import tables as S


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in names})


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(sectionize.levels(sectionize.headings(S.markdown(spark, sf_dir))).select("doc", "pos", "title", "level"), "pos", "level")


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sectionize.paths(sectionize.levels(sectionize.headings(S.markdown(spark, sf_dir))))
    return _long(found.select("doc", "pos", F.concat_ws(" > ", "path").alias("path")), "pos")


def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sectionize.sections(S.markdown(spark, sf_dir))
    return _long(found.select("doc", "idx", "title", "level", F.concat_ws(" > ", "path").alias("path"), "page_start", "page_end", F.md5("markdown").alias("digest")), "idx", "level", "page_start", "page_end")


def section_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sectionize.parents(sectionize.sections(S.markdown(spark, sf_dir)))
    return _long(found.select("doc", "idx", "parent_idx"), "idx", "parent_idx")


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sectionize.blocks(S.markdown(spark, sf_dir))
    return _long(found.groupBy("doc", "page_no", "type").agg(F.count("*").alias("blocks"), F.sum(F.length("markdown")).alias("n_chars")), "n_chars")


def block_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sectionize.block_sections(sectionize.numbered_blocks(sectionize.blocks(S.markdown(spark, sf_dir))))
    return _long(found, "section")


def nested_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.nested_set(S.tree(spark, sf_dir))
    return _long(found.select("doc", "id", "level", F.concat_ws(" > ", "path").alias("path"), "is_group", "lft", "rgt"), "level", "lft", "rgt")


def subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.subtree_sizes(tree.nested_set(S.tree(spark, sf_dir)))


def included_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.included_ancestor(tree.nested_set(S.tree(spark, sf_dir)))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree.nested_set(S.tree(spark, sf_dir))
    left = tree.delete(nodes, nodes.filter("id like 'c:%' and sort_order = 0"))
    return _long(left.select("doc", "id", "lft", "rgt"), "lft", "rgt")


def cascade_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree.nested_set(S.tree(spark, sf_dir))
    return tree.include(nodes, nodes.filter("id like 'c:%' and sort_order = 1"), False).select("doc", "id", "include")


def smallest_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = S.numbers(spark, sf_dir).select("doc", (F.col("page_no") * 2).alias("page"))
    return refs.smallest_cover(S.spans(spark, sf_dir), points)


def deepest_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.deepest_cover(S.spans(spark, sf_dir), S.numbers(spark, sf_dir).select("doc", F.col("page_no").alias("page")))


def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.overlapping(S.spans(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spans = S.spans(spark, sf_dir)
    return spans, refs.edges(S.span_texts(spark, sf_dir), spans, S.page_counts(spark, sf_dir))


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_edges(spark, sf_dir)[1], "target_page")


def graph_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.reference_weights(_edges(spark, sf_dir)[1])
    return found.select("doc", "from_id", "to_id", "weight", F.size("anchors").cast("bigint").alias("anchors"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, found = _edges(spark, sf_dir)
    return graph.nodes(spans, graph.reference_weights(found))


def graph_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.structure(S.spans(spark, sf_dir))


def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, found = _edges(spark, sf_dir)
    near = graph.neighbours(graph.sound_edges(found, spans))
    return near.select("doc", "id", F.array_join("neighbours", ",").alias("neighbours"))


def section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sectionize.sections(S.markdown(spark, sf_dir)).withColumn("path", F.concat_ws(" > ", "path"))
    return _long(explore.search(found, "1. notes").select("doc", "idx", "title"), "idx")


def _wiki(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = tree.nested_set(S.tree(spark, sf_dir)).withColumn("markdown", F.when(F.col("id").startswith("o:"), F.concat(F.lit("Order "), "title")))
    return nodes, wiki.siblings(nodes)


def wiki_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_wiki(spark, sf_dir)[1].select("doc", "id", "wiki_parent", "place"), "place")


def wiki_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.routes(wiki.slugs(_wiki(spark, sf_dir)[1]))


def wiki_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, placed = _wiki(spark, sf_dir)
    return wiki.contents(nodes, placed).select("doc", "id", F.md5("content").alias("digest"))


def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = S.spans(spark, sf_dir)
    named = spans.select("doc", "id", F.concat_ws("/", "doc", "id").alias("route"))
    return _long(wiki.linked(S.span_texts(spark, sf_dir), spans, named, S.page_counts(spark, sf_dir)).select("doc", "id", "links", F.length("markdown").alias("n_chars")), "links", "n_chars")


def wiki_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wiki.by_chapter(sectionize.sections(S.markdown(spark, sf_dir)))
    return _long(found.select("doc", "title", "page_start", "page_end", F.length("body").alias("n_chars")), "page_start", "page_end", "n_chars")


_HEADS = MARKDOWN + r""", lines_v AS (
  SELECT doc, page_no, unnest(range(len(string_split(regexp_replace(markdown, '\n$', ''), chr(10))))) AS line_no, unnest(string_split(regexp_replace(markdown, '\n$', ''), chr(10))) AS line FROM markdown_v),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_no, line_no) AS pos, regexp_extract(line, '^(#{1,6})\s+(.*\S)\s*$', 1) AS marks FROM lines_v),
heads AS (SELECT doc, pos, page_no, trim(regexp_extract(line, '^(#{1,6})\s+(.*\S)\s*$', 2), '*_ ') AS title, length(marks) AS depth FROM placed WHERE marks <> ''),
first_level AS (SELECT *, CASE WHEN regexp_extract(title, '^(\d+(\.\d+)*)\.?\s+\S', 1) <> '' THEN least(6, len(string_split(regexp_extract(title, '^(\d+(\.\d+)*)\.?\s+\S', 1), '.'))) ELSE depth END AS level0 FROM heads),
chapters AS (SELECT *, CASE WHEN level0 = 1 THEN TRY_CAST(regexp_extract(title, '^\d+') AS BIGINT) END AS chapter, contains(title, '*') OR regexp_matches(title, '^\d+\.\s+\d') AS listlike FROM first_level),
levels_v AS (SELECT *, CASE WHEN chapter IS NOT NULL AND NOT (NOT listlike AND chapter > coalesce(max(CASE WHEN NOT listlike THEN chapter END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) THEN 2 ELSE level0 END AS level FROM chapters)"""
#: The view has levels 1 to 3 alone; ancestors are the nearest earlier heading of a lower level, taken step by step.
_PATHS = _HEADS + """, up AS (SELECT a.doc, a.pos, max(b.pos) AS parent_pos FROM levels_v a LEFT JOIN levels_v b ON b.doc = a.doc AND b.pos < a.pos AND b.level < a.level GROUP BY 1, 2),
paths_v AS (SELECT l.doc, l.pos, l.page_no, l.title, l.level, concat_ws(' > ', g.title, p.title, l.title) AS path
  FROM levels_v l JOIN up USING (doc, pos) LEFT JOIN levels_v p ON p.doc = l.doc AND p.pos = up.parent_pos LEFT JOIN up u2 ON u2.doc = l.doc AND u2.pos = up.parent_pos LEFT JOIN levels_v g ON g.doc = l.doc AND g.pos = u2.parent_pos)"""
_SECTIONS = _PATHS + r""", owned AS (SELECT l.doc, l.pos, l.page_no, l.line, l.marks, max(h.pos) AS head FROM placed l JOIN heads h ON h.doc = l.doc AND h.pos <= l.pos GROUP BY ALL),
bodies AS (SELECT doc, head AS pos, max(page_no) AS page_end, trim(coalesce(string_agg(CASE WHEN marks = '' THEN line END, chr(10) ORDER BY pos), ''), E' \n\t') AS body FROM owned GROUP BY ALL),
raw AS (SELECT * FROM paths_v JOIN bodies USING (doc, pos)),
folded AS (SELECT *, CASE WHEN regexp_matches(title, '^(\d+(\.\d+)*)\.?\s+\S') THEN min(pos) OVER (PARTITION BY doc, lower(title)) ELSE pos END AS owner FROM raw),
survivors AS (SELECT doc, pos, NOT coalesce(level = lag(level) OVER w AND lower(title) = lower(lag(title) OVER w), false) AS starts FROM folded WHERE owner = pos WINDOW w AS (PARTITION BY doc ORDER BY pos)),
groups AS (SELECT doc, pos AS owner, max(CASE WHEN starts THEN pos END) OVER (PARTITION BY doc ORDER BY pos) AS head FROM survivors),
sections_v AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY head) - 1 AS idx, title, level, path, page_start, page_end, markdown FROM (
  SELECT f.doc, g.head, arg_min(f.title, f.pos) AS title, arg_min(f.level, f.pos) AS level, arg_min(f.path, f.pos) AS path, min(f.page_no) AS page_start, max(f.page_end) AS page_end, coalesce(string_agg(CASE WHEN body <> '' THEN body END, chr(10) ORDER BY f.pos), '') AS markdown
  FROM folded f JOIN groups g USING (doc, owner) GROUP BY f.doc, g.head))"""
_BLOCKS = MARKDOWN + r""", lines_v AS (SELECT doc, page_no, unnest(range(len(string_split(markdown, chr(10))))) AS line_no, unnest(string_split(markdown, chr(10))) AS line FROM markdown_v),
kinds AS (SELECT *, CASE WHEN trim(line) = '' THEN NULL WHEN regexp_matches(line, '^#{1,6}\s+.+') THEN 'heading' WHEN starts_with(trim(line), '|') AND ends_with(trim(line), '|') AND length(trim(line)) >= 2 THEN 'table' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s+') THEN 'list' ELSE 'paragraph' END AS type FROM lines_v),
marked AS (SELECT *, type IS NOT NULL AND (type = 'heading' OR type IS DISTINCT FROM lag(type) OVER (PARTITION BY doc, page_no ORDER BY line_no)) AS starts FROM kinds),
blocks_v AS (SELECT doc, page_no, ord, type, string_agg(line, chr(10) ORDER BY line_no) AS markdown FROM (SELECT *, sum(starts::INT) OVER (PARTITION BY doc, page_no ORDER BY line_no) AS ord FROM marked) WHERE type IS NOT NULL GROUP BY ALL)"""
_ANCESTOR = """SELECT n.doc, n.id, (SELECT arg_max(u.id, u.lft) FROM nested u WHERE u.doc = n.doc AND u.include AND u.lft < n.lft AND u.rgt > n.rgt) AS wiki_parent FROM nested n WHERE n.include"""
_PLACED = TREE + f""", anc AS ({_ANCESTOR}), placed AS (SELECT a.doc, a.id, a.wiki_parent, n.title, n.lft, n.level, row_number() OVER (PARTITION BY a.doc, a.wiki_parent ORDER BY n.lft) - 1 AS place FROM anc a JOIN nested n USING (doc, id))"""

ORACLES = {
    "heading_levels": f"WITH {_HEADS} SELECT doc, pos, title, level FROM levels_v",
    "heading_paths": f"WITH {_PATHS} SELECT doc, pos, path FROM paths_v",
    "section_tree": f"WITH {_SECTIONS} SELECT doc, idx, title, level, path, page_start, page_end, md5(markdown) AS digest FROM sections_v",
    "section_parents": f"WITH {_SECTIONS} SELECT a.doc, a.idx, max(b.idx) AS parent_idx FROM sections_v a LEFT JOIN sections_v b ON b.doc = a.doc AND b.idx < a.idx AND a.path = b.path || ' > ' || a.title GROUP BY 1, 2",
    "markdown_blocks": f"WITH {_BLOCKS} SELECT doc, page_no, type, count(*) AS blocks, sum(length(markdown))::BIGINT AS n_chars FROM blocks_v GROUP BY ALL",
    "block_sections": f"WITH {_BLOCKS}" + r""", s AS (SELECT *, sum((type = 'heading')::INT) OVER (PARTITION BY doc ORDER BY page_no, ord) AS section FROM blocks_v)
        SELECT doc, section::BIGINT AS section, coalesce(max(CASE WHEN type = 'heading' THEN regexp_replace(markdown, '^#+\s+', '') END), 'Preamble') AS title, min(page_no) AS page_start, max(page_no) AS page_end, count(*) AS blocks FROM s GROUP BY 1, 2""",
    "nested_set": f"WITH {TREE} SELECT n.doc, n.id, n.level, CASE n.level WHEN 1 THEN n.title WHEN 2 THEN n.title || ' > ' || n.title ELSE substr(n.k1, 3) || ' > ' || substr(n.k1, 3) || ' > ' || n.title END AS path, d > 0 AS is_group, lft, rgt FROM nested n",
    "subtree_sizes": f"WITH {TREE} SELECT doc, id, d + 1 AS nodes FROM nested",
    "included_ancestor": f"WITH {TREE} {_ANCESTOR}",
    "cascade_delete": f"WITH {TREE}, kept AS (SELECT * FROM nested WHERE NOT (level = 2 AND sort_order = 0) AND NOT (level = 3 AND k2 = 0)), again AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY m) AS m2, CASE level WHEN 1 THEN count(*) OVER (PARTITION BY doc, k1) WHEN 2 THEN count(*) OVER (PARTITION BY doc, k3) ELSE 1 END - 1 AS d2 FROM kept) SELECT doc, id, 2 * m2 - level AS lft, 2 * m2 - level + 2 * d2 + 1 AS rgt FROM again",
    "cascade_include": f"WITH {TREE} SELECT doc, id, CASE WHEN level > 1 AND k2 = 1 THEN false ELSE include END AS include FROM nested",
    "smallest_cover": f"WITH {SPANS} SELECT p.doc, p.page_no * 2 AS page, (SELECT arg_min(id, (page_end - page_start) * 1000000 + lft) FROM spans_v s WHERE s.doc = p.doc AND p.page_no * 2 BETWEEN page_start AND page_end) AS id FROM pages_v p",
    "deepest_cover": f"WITH {SPANS}, held AS (SELECT p.doc, p.page_no AS page, s.id, s.lft, s.rgt FROM pages_v p JOIN spans_v s ON s.doc = p.doc AND p.page_no BETWEEN page_start AND page_end) SELECT doc, page, id FROM held h WHERE NOT EXISTS (SELECT 1 FROM held i WHERE i.doc = h.doc AND i.page = h.page AND i.lft > h.lft AND i.rgt < h.rgt)",
    "span_overlap": f"WITH {SPANS} SELECT a.doc, a.id, b.id AS other FROM spans_v a JOIN spans_v b ON a.doc = b.doc AND a.page_start <= b.page_end AND b.page_start <= a.page_end AND NOT (a.lft <= b.lft AND a.rgt >= b.rgt) AND NOT (b.lft <= a.lft AND b.rgt >= a.rgt)",
    "reference_edges": f"WITH {SPANS} SELECT doc, from_id, to_id, target_page::BIGINT AS target_page, anchor, occurrences FROM edges_v",
    "graph_weights": f"WITH {SPANS} SELECT doc, from_id, to_id, sum(occurrences)::BIGINT AS weight, count(DISTINCT anchor) AS anchors FROM edges_v GROUP BY 1, 2, 3",
    "graph_nodes": f"WITH {SPANS}, ends AS (SELECT doc, from_id AS id, occurrences FROM edges_v UNION ALL SELECT doc, to_id, occurrences FROM edges_v), deg AS (SELECT doc, id, sum(occurrences)::BIGINT AS degree FROM ends GROUP BY 1, 2) SELECT s.doc, s.id, s.section_type, s.page_end - s.page_start + 1 AS span, coalesce(degree, 0) AS degree FROM spans_v s LEFT JOIN deg USING (doc, id)",
    "graph_structure": f"WITH {SPANS} SELECT doc, CASE WHEN parent IS NULL THEN 'doc:' || doc ELSE id END AS source, coalesce(parent, id) AS target, CASE WHEN parent IS NULL THEN 'HAS_SECTION' ELSE 'PART_OF' END AS kind FROM spans_v",
    "graph_neighbours": f"WITH {SPANS}, ends AS (SELECT doc, from_id AS id, to_id AS n FROM edges_v UNION SELECT doc, to_id, from_id FROM edges_v UNION SELECT doc, from_id, from_id FROM edges_v UNION SELECT doc, to_id, to_id FROM edges_v) SELECT doc, id, string_agg(n, ',' ORDER BY n) AS neighbours FROM ends GROUP BY 1, 2",
    "section_search": f"WITH {_SECTIONS} SELECT doc, idx, title FROM sections_v WHERE contains(lower(title), '1. notes') OR contains(lower(path), '1. notes')",
    "wiki_placement": f"WITH {_PLACED} SELECT doc, id, wiki_parent, place FROM placed",
    "wiki_routes": f"WITH {_PLACED}"
    + r""", based AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM placed), slugged AS (SELECT *, base || CASE WHEN row_number() OVER (PARTITION BY doc, wiki_parent, base ORDER BY place) = 1 THEN '' ELSE '-' || row_number() OVER (PARTITION BY doc, wiki_parent, base ORDER BY place) END AS slug FROM based)
        SELECT a.doc, a.id, concat_ws('/', a.doc::VARCHAR, c.slug, b.slug, a.slug) AS route FROM slugged a LEFT JOIN slugged b ON b.doc = a.doc AND b.id = a.wiki_parent LEFT JOIN slugged c ON c.doc = a.doc AND c.id = b.wiki_parent""",
    "wiki_contents": f"WITH {_PLACED}, listing AS (SELECT doc, wiki_parent AS id, string_agg('- ' || title, chr(10) ORDER BY place) AS items FROM placed WHERE wiki_parent IS NOT NULL GROUP BY 1, 2) SELECT n.doc, n.id, md5(CASE WHEN level = 3 THEN 'Order ' || title WHEN d > 0 THEN coalesce(items, '') ELSE '# ' || title END) AS digest FROM nested n LEFT JOIN listing USING (doc, id) WHERE n.include",
    "wiki_links": f"WITH {SPANS}, hit AS (SELECT i.doc, i.id, i.anchor, c.id AS target FROM internal_v i JOIN cover_v c ON c.doc = i.doc AND c.page = i.n WHERE c.id <> i.id) SELECT s.doc, s.id, count(h.target) AS links, length(any_value(s.markdown)) + coalesce(sum(length('[](/' || h.doc || '/' || h.target || ')')), 0)::BIGINT AS n_chars FROM spans_v s LEFT JOIN hit h USING (doc, id) GROUP BY 1, 2",
    "wiki_chapters": f"WITH {_SECTIONS}" + r""" SELECT doc, string_split(path, ' > ')[1] AS title, min(page_start) AS page_start, max(page_end) AS page_end, (sum(len(string_split(path, ' > ')) + 3 + length(title) + length(markdown)) + 2 * (count(*) - 1))::BIGINT AS n_chars FROM sections_v GROUP BY 1, 2""",
}

QUERIES = {
    f.__name__: f
    for f in (
        heading_levels, heading_paths, section_tree, section_parents, markdown_blocks, block_sections, nested_set, subtree_sizes, included_ancestor, cascade_delete, cascade_include, smallest_cover, deepest_cover,
        span_overlap, reference_edges, graph_weights, graph_nodes, graph_structure, graph_neighbours, section_search, wiki_placement, wiki_routes, wiki_contents, wiki_links, wiki_chapters,
    )
}
