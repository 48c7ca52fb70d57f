"""Queries on page fidelity, running furniture and markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import clean, lint, score
from quire.plans.views import PAGES, TABLE_LINES, exact_mean
from quire.sources import tables as S

KEYS = ["doc", "page_no"]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.pages(spark, sf_dir).withColumn("markdown", F.col("baseline"))
    return score.page_scores(pages.select("doc", "page_no", "kind", "truth", "markdown", "judge_score"), KEYS)


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score.overlap(S.pages(spark, sf_dir), KEYS, "truth", "baseline")
    return found.select(*KEYS, F.round("text_recall", 6).alias("text_recall"), F.round("extra_ratio", 6).alias("extra_ratio"))


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return rows.select(*KEYS, F.round("text_recall", 3).alias("text_recall"), F.round("extra_ratio", 3).alias("extra_ratio"), "table_score", "composite", "verdict", F.size("notes").cast("bigint").alias("notes"))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("doc", "verdict").agg(F.count("*").alias("pages"), T.exact_mean(F.col("composite")).alias("mean_composite"))


def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.canonical(F.col("vlm"), F.col("baseline"))
    return S.pages(spark, sf_dir).select(*KEYS, F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"))


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.boilerplate(S.pages(spark, sf_dir).withColumn("markdown", F.col("truth")), 0.10)


def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.furniture(S.pages(spark, sf_dir).withColumn("markdown", F.col("truth")), 0.10)


def finalized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.pages(spark, sf_dir).withColumn("markdown", F.concat("truth", F.lit("\nPage 3 of 9\n|Prepared by A|Issued by B|\n|---|---|\n")))
    rows = clean.finalized(pages.select("doc", "page_no", "markdown"), 0.10)
    return rows.select(*KEYS, F.md5("markdown").alias("digest"), "changed")


def table_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.issues(S.tables(spark, sf_dir), ["key"]).select("key", "code", F.col("line").cast("bigint").alias("line"))


def repaired_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.repaired(S.tables(spark, sf_dir), ["key"]).select("key", F.md5("markdown").alias("digest"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tables(spark, sf_dir).select("key", score.table_cells(F.col("markdown")).cast("bigint").alias("cells"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.plain_text(F.col("html"))
    return S.read(spark, sf_dir, "pages").select("page_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"), F.regexp_count("html", F.lit("<br>")).cast("bigint").alias("breaks"))


def expected_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "documents").select("doc_id", score.expected_headings(F.col("text")).cast("bigint").alias("headings"))


_TOKENS = r"""regexp_extract_all(regexp_replace(lower(coalesce({}, '')), '[#*_`>\-|]', ' ', 'g'), '[a-z0-9]+')"""
_SCORES = PAGES + f""", toks AS (
  SELECT doc, page_no, unnest({_TOKENS.format('truth')}) AS token, 1 AS t, 0 AS p FROM pages_v
  UNION ALL SELECT doc, page_no, unnest({_TOKENS.format('baseline')}), 0, 1 FROM pages_v),
per AS (SELECT doc, page_no, token, sum(t) AS t, sum(p) AS p FROM toks GROUP BY ALL),
sums AS (SELECT doc, page_no, sum(least(t, p)) AS shared_n, sum(t) AS t, sum(p) AS p FROM per GROUP BY ALL),
overlap_v AS (SELECT v.doc, v.page_no, CASE WHEN coalesce(t, 0) = 0 THEN 1.0::DOUBLE ELSE shared_n::DOUBLE / t END AS text_recall, CASE WHEN coalesce(p, 0) = 0 THEN 0.0::DOUBLE ELSE (p - shared_n)::DOUBLE / p END AS extra_ratio FROM pages_v v LEFT JOIN sums USING (doc, page_no)),
terms AS (SELECT v.doc, v.page_no, v.kind, v.judge_score, o.text_recall, o.extra_ratio,
  CASE WHEN (SELECT count(*) FROM (SELECT unnest(string_split(v.truth, chr(10))) AS ln) WHERE len(regexp_extract_all(ln, '\\S {{2,}}')) >= 2) >= 3 THEN 0.0::DOUBLE END AS table_score
  FROM pages_v v JOIN overlap_v o USING (doc, page_no)),
weighed AS (SELECT *, CASE WHEN kind = 'visual' THEN
    CASE WHEN judge_score IS NULL AND table_score IS NULL THEN 0 ELSE round((coalesce(judge_score * 0.85, 0) + coalesce(table_score * 0.15, 0)) / (CASE WHEN judge_score IS NULL THEN 0 ELSE 0.85 END + CASE WHEN table_score IS NULL THEN 0 ELSE 0.15 END), 3) END
  ELSE round((0.4::DOUBLE * text_recall + 0.15::DOUBLE * (1 - extra_ratio) + coalesce(0.15 * table_score, 0) + coalesce(0.3::DOUBLE * judge_score, 0)) / (0.55::DOUBLE + CASE WHEN table_score IS NULL THEN 0 ELSE 0.15 END + CASE WHEN judge_score IS NULL THEN 0 ELSE 0.3::DOUBLE END), 3) END AS composite FROM terms),
scores_v AS (SELECT *, CASE WHEN composite >= 0.9 THEN 'pass' WHEN composite >= 0.7 THEN 'escalate' ELSE 'review' END AS verdict,
  CASE WHEN kind = 'visual' THEN (judge_score IS NULL)::BIGINT ELSE (text_recall < 0.85)::BIGINT + (extra_ratio > 0.25)::BIGINT + coalesce((table_score = 0)::BIGINT, 0) END AS notes FROM weighed)"""
_LINES = PAGES + r""", lines_v AS (
  SELECT doc, page_no, unnest(string_split(regexp_replace(truth, '\n$', ''), chr(10))) AS line FROM pages_v),
n_v AS (SELECT doc, count(*) AS n FROM pages_v GROUP BY 1)"""

ORACLES = {
    "token_overlap": f"WITH {_SCORES} SELECT doc, page_no, round(text_recall, 6) AS text_recall, round(extra_ratio, 6) AS extra_ratio FROM overlap_v",
    "page_scores": f"WITH {_SCORES} SELECT doc, page_no, round(text_recall, 3) AS text_recall, round(extra_ratio, 3) AS extra_ratio, table_score, composite::DOUBLE AS composite, verdict, notes FROM scores_v",
    "verdict_counts": f"WITH {_SCORES} SELECT doc, verdict, count(*) AS pages, {exact_mean("composite")} AS mean_composite FROM scores_v GROUP BY ALL",
    "canonical_text": f"WITH {PAGES} SELECT doc, page_no, length(coalesce(nullif(vlm, ''), nullif(baseline, ''), '')) AS n_chars, md5(coalesce(nullif(vlm, ''), nullif(baseline, ''), '')) AS digest FROM pages_v",
    "boilerplate_lines": f"WITH {_LINES}" + r""", forms AS (SELECT DISTINCT doc, page_no, lower(trim(regexp_replace(line, '[#*_`>\-\s]+', ' ', 'g'))) AS form FROM lines_v)
        SELECT doc, form, count(*) AS pages_with FROM forms JOIN n_v USING (doc) WHERE form <> '' AND length(form) <= 90 GROUP BY doc, form, n HAVING count(*) >= greatest(3, floor(0.10 * n))""",
    "furniture_lines": f"WITH {_LINES}" + r""", forms AS (SELECT DISTINCT doc, page_no, trim(regexp_replace(regexp_replace(lower(line), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS form FROM lines_v)
        SELECT doc, form, count(*) AS pages_with FROM forms JOIN n_v USING (doc) WHERE length(form) >= 6 AND n >= 3 GROUP BY doc, form, n HAVING count(*) >= greatest(2, round_even(0.10 * n, 0))""",
    "finalized_pages": f"WITH {PAGES}" + r""", old AS (SELECT doc, page_no, truth || E'\nPage 3 of 9\n|Prepared by A|Issued by B|\n|---|---|\n' AS markdown FROM pages_v),
        lines_v AS (SELECT doc, page_no, unnest(range(len(string_split(markdown, chr(10))))) AS k, unnest(string_split(markdown, chr(10))) AS line FROM old),
        forms AS (SELECT *, lower(trim(regexp_replace(line, '[#*_`>\-\s]+', ' ', 'g'))) AS form FROM lines_v),
        n_v AS (SELECT doc, count(*) AS n FROM old GROUP BY 1),
        common AS (SELECT doc, form FROM (SELECT DISTINCT doc, page_no, form FROM forms) JOIN n_v USING (doc) WHERE form <> '' AND length(form) <= 90 GROUP BY doc, form, n HAVING count(*) >= greatest(3, floor(0.10 * n))),
        kept AS (SELECT * FROM forms f WHERE NOT regexp_matches(line, '(?i)\bpage\s*\d+\s*of\s*\d+') AND NOT (line LIKE '|Prepared by%') AND line <> '|---|---|' AND NOT EXISTS (SELECT 1 FROM common c WHERE c.doc = f.doc AND c.form = f.form)),
        new AS (SELECT doc, page_no, regexp_replace(string_agg(line, chr(10) ORDER BY k), '\n$', '') AS markdown FROM kept GROUP BY ALL)
        SELECT o.doc, o.page_no, md5(CASE WHEN trim(coalesce(n.markdown, ''), E' \n\t') = '' THEN o.markdown ELSE n.markdown END) AS digest, trim(coalesce(n.markdown, ''), E' \n\t') <> '' AS changed FROM old o LEFT JOIN new n USING (doc, page_no)""",
    "table_issues": f"WITH {TABLE_LINES}" + """, found AS (
        SELECT key, CASE WHEN n = 1 THEN 'lone_pipe_row' WHEN pos = 0 AND NOT has_sep THEN 'missing_separator' WHEN has_sep AND pos >= 2 AND NOT sep AND cells <> header THEN 'ragged_row' END AS code, line_no + 1 AS line FROM blocks_v
        UNION ALL SELECT key, 'unclosed_fence', 0 FROM fenced GROUP BY key HAVING sum(fence::INT) % 2 = 1)
        SELECT key, code, line FROM found WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE WHEN line = 0 THEN 2147483647 ELSE line END) <= 8""",
    "repaired_tables": f"WITH {TABLE_LINES}" + """, every_line AS (SELECT key, line_no, 0 AS after, line FROM lines_v UNION ALL SELECT key, line_no, 1, '|' || repeat('---|', cells) FROM blocks_v WHERE pos = 0 AND n >= 2 AND NOT has_sep)
        SELECT key, md5(string_agg(line, chr(10) ORDER BY line_no, after)) AS digest FROM every_line GROUP BY key""",
    "table_cells": f"WITH {TABLE_LINES}" + r""" SELECT key, sum(CASE WHEN regexp_matches(line, '^\s*\|.*\|\s*$') AND NOT regexp_matches(line, '^\s*\|[\s:|-]+\|\s*$') THEN len(string_split(line, '|')) - 2 ELSE 0 END)::BIGINT AS cells FROM lines_v GROUP BY key""",
    "html_text": r"""SELECT page_id, length(t) AS n_chars, md5(t) AS digest, (length(html) - length(replace(html, '<br>', ''))) // 4 AS breaks FROM (
        SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[#*_`>|-]+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)""",
    "expected_headings": r"""SELECT doc_id, (SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS ln) WHERE length(trim(ln)) <= 100 AND length(regexp_replace(ln, '\P{L}', '', 'g')) >= 4 AND length(regexp_replace(ln, '\P{Lu}', '', 'g')) >= 0.75 * length(regexp_replace(ln, '\P{L}', '', 'g'))) AS headings FROM documents""",
}

QUERIES = {f.__name__: f for f in (token_overlap, page_scores, verdict_counts, canonical_text, boilerplate_lines, furniture_lines, finalized_pages, table_issues, repaired_tables, table_cells, html_text, expected_headings)}
