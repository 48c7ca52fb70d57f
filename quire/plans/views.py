"""The views of `quire.sources.tables` as common table expressions for the oracle."""


def exact_mean(x: str) -> str:
    """The mean of x to three digits, halves up, from whole numbers of billionths."""
    return f"((2 * sum(round(({x}) * 1e9)::HUGEINT) + count({x}) * 1000000) // (2 * count({x}) * 1000000))::DOUBLE / 1000"


PAGES = """pages_v AS (
  SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'visual' ELSE 'text' END AS kind,
    CASE WHEN doc_id % 4 = 0 THEN substr(truth, 1, length(truth) // 2) ELSE replace(truth, ' of ', ' ') || ' zzz' END AS baseline,
    CASE WHEN doc_id % 6 <> 0 THEN truth || chr(10) || 'zz yy xx' END AS cleanup,
    CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 3 <> 0 THEN truth END AS vlm,
    CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 6) / 5.0::DOUBLE END AS judge_score
  FROM (SELECT coalesce(source, '') AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no, doc_id, text AS truth FROM documents))"""

MARKDOWN = PAGES + """, markdown_v AS (
  SELECT doc, page_no, CASE WHEN page_no % 3 = 1 THEN '# **' || ((page_no - 1) // 3 + 1) || '. Chapter**'
    WHEN page_no % 3 = 2 THEN '## ' || ((page_no - 1) // 3 + 1) || '.1 Part'
    WHEN page_no % 2 = 0 THEN '# 1. Notes ' || page_no ELSE '### Remarks' END || chr(10) || truth AS markdown FROM pages_v)"""

TABLES = """tables_v AS (
  SELECT key, CASE WHEN key % 11 = 0 THEN '```' || chr(10) ELSE '' END || 'Orders' || chr(10) || '|key|status|priority|' || chr(10)
    || CASE WHEN key % 3 <> 0 THEN '|---|---|---|' || chr(10) ELSE '' END || body || CASE WHEN key % 5 = 0 THEN chr(10) || chr(10) || '|alone|' || chr(10) || 'end' ELSE '' END AS markdown
  FROM (SELECT o_custkey AS key, string_agg('|' || o_orderkey || '|' || o_orderstatus || CASE WHEN o_orderkey % 7 = 0 THEN '|' ELSE '|' || o_orderpriority || '|' END, chr(10) ORDER BY o_orderkey) AS body FROM orders GROUP BY 1))"""

#: Lines of tables_v with their block, as `quire.operators.lint` has them.
TABLE_LINES = TABLES + """, lines_v AS (
  SELECT key, unnest(string_split(markdown, chr(10))) AS line, unnest(range(len(string_split(markdown, chr(10))))) AS line_no FROM tables_v),
fenced AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence, sum(regexp_matches(line, '^\\s*(```|~~~)')::INT) OVER (PARTITION BY key ORDER BY line_no) % 2 = 1 AS inside FROM lines_v),
rows_v AS (SELECT *, starts_with(trim(line), '|') AND NOT inside AND NOT fence AS is_row FROM fenced),
started AS (SELECT *, is_row AND NOT coalesce(lag(is_row) OVER (PARTITION BY key ORDER BY line_no), false) AS starts FROM rows_v),
numbered AS (SELECT *, CASE WHEN is_row THEN sum(starts::INT) OVER (PARTITION BY key ORDER BY line_no) END AS block FROM started),
cells_v AS (SELECT *, row_number() OVER (PARTITION BY key, block ORDER BY line_no) - 1 AS pos, count(*) OVER (PARTITION BY key, block) AS n,
  regexp_matches(line, '^\\s*\\|?[\\s:|-]*-[\\s:|-]*\\|?\\s*$') AS sep, len(string_split(trim(line, '|'), '|')) AS cells FROM numbered WHERE block IS NOT NULL),
blocks_v AS (SELECT *, bool_or(pos = 1 AND sep) OVER (PARTITION BY key, block) AS has_sep, max(CASE WHEN pos = 0 THEN cells END) OVER (PARTITION BY key, block) AS header FROM cells_v)"""

TREE = """tree_v AS (
  SELECT DISTINCT c_nationkey::BIGINT AS doc, 's:' || c_mktsegment AS id, NULL AS parent, c_mktsegment AS title, 0::BIGINT AS sort_order, true AS include FROM customer
  UNION ALL SELECT c_nationkey, 'c:' || c_custkey, 's:' || c_mktsegment, c_mktsegment, c_custkey % 4, c_custkey % 3 <> 0 FROM customer
  UNION ALL SELECT c_nationkey, 'o:' || o_orderkey, 'c:' || c_custkey, o_orderpriority, 0, o_orderkey % 2 = 0 FROM orders JOIN customer ON o_custkey = c_custkey),
ranked AS (
  SELECT t.*, CASE left(t.id, 1) WHEN 's' THEN 1 WHEN 'c' THEN 2 ELSE 3 END AS level,
    CASE left(t.id, 1) WHEN 's' THEN t.id WHEN 'c' THEN t.parent ELSE u.parent END AS k1,
    CASE left(t.id, 1) WHEN 's' THEN -1 WHEN 'c' THEN t.sort_order ELSE u.sort_order END AS k2,
    CASE left(t.id, 1) WHEN 's' THEN '' WHEN 'c' THEN t.id ELSE t.parent END AS k3, CASE left(t.id, 1) WHEN 'o' THEN t.id ELSE '' END AS k4
  FROM tree_v t LEFT JOIN tree_v u ON u.doc = t.doc AND u.id = t.parent),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY k1, k2, k3, k4) AS m,
  CASE level WHEN 1 THEN count(*) OVER (PARTITION BY doc, k1) WHEN 2 THEN count(*) OVER (PARTITION BY doc, k3) ELSE 1 END - 1 AS d FROM ranked),
nested AS (SELECT *, 2 * m - level AS lft, 2 * m - level + 2 * d + 1 AS rgt FROM numbered)"""

SPANS = PAGES + """, spans_v AS (
  SELECT doc, id, parent, page_start, page_end, lft, rgt, CASE WHEN doc_id % 4 <> 0 THEN 'type' || (doc_id % 3) END AS section_type,
    truth || ' See page ' || (1 + doc_id * 7 % 60) || ', and p. 4; refer to Page No. 12.' AS markdown
  FROM (SELECT doc, id, parent, page_start, page_end, lft, rgt, arg_min(doc_id, page_no) AS doc_id, string_agg(truth, chr(10) ORDER BY page_no) AS truth FROM (
    SELECT doc, page_no, doc_id, truth, 'c' || ((page_no - 1) // 4) AS id, NULL AS parent, 4 * ((page_no - 1) // 4) + 1 AS page_start, 4 * ((page_no - 1) // 4) + 4 AS page_end, 6 * ((page_no - 1) // 4) + 1 AS lft, 6 * ((page_no - 1) // 4) + 6 AS rgt FROM pages_v
    UNION ALL SELECT doc, page_no, doc_id, truth, 'h' || s, 'c' || ((s - 1) // 4), s, s + CASE WHEN s % 4 = 3 THEN 2 ELSE 1 END, 6 * ((s - 1) // 4) + CASE WHEN s % 4 = 3 THEN 4 ELSE 2 END, 6 * ((s - 1) // 4) + CASE WHEN s % 4 = 3 THEN 5 ELSE 3 END
      FROM (SELECT *, 2 * ((page_no - 1) // 2) + 1 AS s FROM pages_v UNION ALL SELECT *, page_no - 2 FROM pages_v WHERE page_no % 4 = 1 AND page_no > 1)) GROUP BY doc, id, parent, page_start, page_end, lft, rgt)),
counts_v AS (SELECT doc, max(page_no) AS page_count FROM pages_v GROUP BY 1),
mentions_v AS (SELECT s.doc, s.id, m[1] AS anchor, m[2] AS cue, m[3] AS kind, m[4]::INT AS n FROM (
  SELECT doc, id, unnest(list_transform(regexp_extract_all(markdown, '(?i)((?:see|refer(?:\\s+to)?)\\s+)?(page\\s*no\\.?|page|pg\\.?|p\\.)\\s*(\\d{1,4})\\b'), lambda x: [x, regexp_extract(x, '(?i)^((?:see|refer(?:\\s+to)?)\\s+)', 1), regexp_extract(x, '(?i)(page\\s*no\\.?|page|pg\\.?|p\\.)\\s*\\d', 1), regexp_extract(x, '(\\d{1,4})$', 1)])) AS m FROM spans_v) s),
internal_v AS (SELECT * FROM mentions_v JOIN counts_v USING (doc) WHERE (cue <> '' OR contains(lower(kind), 'no')) AND n BETWEEN 1 AND page_count),
cover_v AS (SELECT p.doc, p.page, arg_min(s.id, {'w': s.page_end - s.page_start, 'l': s.lft}) AS id FROM (SELECT DISTINCT doc, n AS page FROM internal_v) p JOIN spans_v s ON s.doc = p.doc AND p.page BETWEEN s.page_start AND s.page_end GROUP BY 1, 2),
edges_v AS (SELECT i.doc, i.id AS from_id, c.id AS to_id, i.n AS target_page, trim(i.anchor) AS anchor, count(*) AS occurrences FROM internal_v i JOIN cover_v c ON c.doc = i.doc AND c.page = i.n WHERE i.id <> c.id GROUP BY ALL)"""
