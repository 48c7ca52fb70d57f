"""Queries on records: candidate rules, artifacts, predicates and scalars, listings, patches and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import adopt, clean, explore, lint, runs, score, sectionize
from quire.plans import fidelity, retrieval, structure
from quire.plans.views import PAGES, SPANS, TABLES
from quire.sources import tables as S

KEYS = ["doc", "page_no"]


def older_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rule's route and decision of each page, and whether an escalation by the vlm would be kept."""
    c, rows = F.col, retrieval._candidates(spark, sf_dir)
    method = adopt.routed(c("kind"), c("baseline_recall"))
    new, recall = F.when(method == "vlm", c("vlm_composite")).otherwise(c("cleanup_composite")), F.when(method == "vlm", c("vlm_recall")).otherwise(c("cleanup_recall"))
    kept = adopt.kept_best(score.verdict(c("baseline_composite")), c("baseline_composite"), c("vlm_composite"))
    return rows.select(*KEYS, method.alias("method"), adopt.routed_adopted(method, c("baseline_composite"), c("baseline_recall"), new, recall).alias("adopted"), kept.alias("kept_best"))


def page_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of pages whose baseline carries the marks of a mangled page, table lint among them."""
    n = F.col("doc_id") % 7
    mark = F.when(n == 0, "\npicture intentionally omitted").when(n == 1, "\n--- Start of picture text").when(n == 2, "\n|  |  |  |\n").when(n == 3, F.repeat(F.lit("<br>"), F.lit(16))).when(n == 4, "\n\n|a|b|\n|1|2|\n\n|z|").otherwise("")
    p = S.pages(spark, sf_dir).withColumn("markdown", F.concat("baseline", mark)).select(*KEYS, F.lit("text").alias("kind"), "truth", "markdown", "judge_score")
    labels = lint.labels(lint.issues(p, KEYS), KEYS)
    p = p.join(labels, KEYS, "left").withColumn("lint_labels", F.coalesce("lint_labels", F.array().cast("array<string>")))
    return score.page_scores(p, KEYS, lint_labels=True).select(*KEYS, F.array_join("artifacts", ", ").alias("artifacts"), "composite", "verdict")


def content_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the baseline against the truth without running furniture."""
    p = S.pages(spark, sf_dir).select(*KEYS, F.concat(F.lit("Handbook page "), F.col("page_no").cast("string"), F.lit("\n"), "truth", F.lit("\nprinted copy")).alias("truth"), F.col("baseline").alias("parsed"))
    kept = clean.content_recall_input(p, clean.furniture(p.withColumn("markdown", F.col("truth"))))
    found = score.overlap(p.drop("truth").join(kept, KEYS), KEYS, "truth", "parsed")
    return found.select(*KEYS, F.round("text_recall", 6).alias("text_recall"))


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens_without_tags(F.col("html"))
    return S.read(spark, sf_dir, "pages").select("page_id", F.size(words).cast("bigint").alias("tokens"), F.md5(F.array_join(words, " ")).alias("digest"))


def outline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section paths with an outline that puts one title at level 8."""
    p = S.markdown(spark, sf_dir)
    outline = p.select("doc", F.lit(" REMARKS ").alias("title"), F.lit(8).alias("level")).distinct()
    found = sectionize.sections(p, outline)
    return found.select("doc", F.col("idx").cast("bigint").alias("idx"), "title", F.col("level").cast("bigint").alias("level"), F.concat_ws(" > ", "path").alias("path"))


def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates on lines made of parts' names."""
    k, name = F.col("p_partkey") % 12, F.col("p_name")
    number = F.col("p_size").cast("string")
    forms = [
        F.concat(F.lit("Pg. "), number, F.lit(" of 60")), F.concat(F.lit("see PAGE "), number, F.lit(" of 9")), F.concat(F.lit("MAN/a1/"), number), F.concat(F.lit("| Prepared by "), name, F.lit(" | Approved by x |")),
        F.concat(F.lit("|"), name, F.lit("|")), F.concat(F.lit("  | "), name), F.concat(number, F.lit(". "), number, F.lit(" "), name), F.concat(name, F.lit(" *")), F.concat(F.lit("I've just moved "), name),
        F.concat(F.lit("I will move "), name), F.concat(F.lit("Issue : "), number), F.concat(F.lit("**==> picture [9 x 9] intentionally omitted <==**"), F.repeat(F.lit("x"), F.col("p_size") * 5), F.lit("Start of picture text")),
    ]
    line = forms[-1]
    for i, form in enumerate(forms[:-1]):
        line = F.when(k == i, form).otherwise(line)
    rows = S.read(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    c = F.col("line")
    end = F.locate("<==**", c) + 5
    return rows.select(
        "p_partkey", T.is_varying(c).alias("varying"), T.is_sign_off(c).alias("sign_off"), T.is_table_line(c).alias("table_line"), T.is_pipe_line(c).alias("pipe_line"), c.rlike(T.TABLE_ROW).alias("table_row"),
        T.looks_like_list_item(c).alias("list_item"), c.rlike(T.CLAIM).alias("claim"), T.shown_text(c, end, "Start of picture text").alias("shown_text"),
    )


def scalar_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars on values made of parts."""
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    text = lambda c: c.cast("string")
    option = F.when(k % 6 == 0, "True").when(k % 6 == 1, "null").when(k % 6 == 2, text(size)).when(k % 6 == 3, F.concat(text(size), F.lit(".5"))).when(k % 6 == 4, "1e3").otherwise(name)
    obj = F.concat(F.lit('{"a":'), text(size), F.lit("}"))
    raws = [F.concat(F.lit("so:\n```json\n"), obj, F.lit("\n```\nend")), obj, F.concat(F.lit("it is "), obj, F.lit(" ok")), F.lit("{broken"), F.lit(""), F.concat(obj, F.lit(" ok")), F.lit("{'a':1}"), F.concat(obj, F.lit('{"b":2}')), F.concat(F.lit("[1,2] tail "), obj), F.concat(text(size), F.lit(" apples")), F.concat(F.lit("["), text(size), F.lit(", 2]"))]
    replies = [F.concat(F.lit('{"md":"'), name, F.lit('"}')), F.concat(F.lit('{"text":"t","content":"'), name, F.lit('"}')), F.concat(F.lit("  "), name, F.lit("\n")), F.lit(""), F.lit('{"other":1}'), F.concat(obj, F.lit(" ok")), F.lit("{'a':1}"), F.lit('{"md":null,"text":"t"}'), F.lit('"quoted"'), F.lit('{"text":5}'), F.lit("[1,2]")]
    raw, reply = (F.element_at(F.array(*forms), (k % 11 + 1).cast("int")) for forms in (raws, replies))
    listed = F.when(k % 5 == 0, '[{"a":1},{"a":2}]').when(k % 5 == 1, "not json").when(k % 5 == 2, "[1] x").when(k % 5 == 3, "{}")
    cost = F.when(k % 5 == 0, F.concat(F.lit('{"usage":{"cost":'), text(size), F.lit("}}"))).when(k % 5 == 1, F.concat(F.lit('{"usage":{"cost":0},"total_cost":'), text(size), F.lit("}"))).when(k % 5 == 2, '{"usage":{}}').when(k % 5 == 3, '{"cost":"bad"}').otherwise(F.concat(F.lit('{"cost_usd":'), text(size), F.lit("}")))
    cells = T.table_cells(F.concat(F.lit("| "), name, F.lit(" |x|\n|---|---|\n|y| "), text(size), F.lit(" |\nend")))
    pairs = F.map_from_arrays(F.array(F.lit("z"), F.lit("_p"), F.lit("b")), F.array(text(size), F.lit("s"), F.col("p_brand")))
    return S.read(spark, sf_dir, "part").select(
        k, T.file_slug(F.concat(F.lit(" __"), name, F.lit(" / "), F.col("p_brand"), F.lit("__ "))).alias("file_slug"), T.option_kind(option).alias("option_kind"), T.salvaged_json(raw).alias("salvaged"), T.json_object_or_empty(raw).alias("object"),
        T.reply_markdown(reply).alias("reply"), T.reply_cost(cost).alias("cost"), F.array_join(F.transform(cells, lambda x: F.concat_ws(":", text(x["row"]), text(x["column"]), x["text"])), ";").alias("cells"),
        T.sorted_json(T.without_private(pairs)).alias("sorted_json"), T.or_default(F.when(size > 25, F.lit("")).when(size > 9, name), "none").alias("setting"), T.data_url(F.encode(F.col("p_brand"), "utf-8")).alias("data_url"),
        T.json_length(listed).alias("listed"),
        F.to_json(T.warning(F.lit("w"), F.col("p_brand"), F.lit("info"), size.cast("int"), F.lit(None).cast("string"))).alias("warning"), T.utc(F.timestamp_seconds(size.cast("bigint") * 100_000)).alias("at"), T.run_id(F.col("p_brand")).rlike("^run_[A-Za-z0-9._-]{1,32}_[0-9a-f]{12}$").alias("run_id"),
    )


def session_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest events of one kind with their place, as a listing of active sessions has them."""
    e = S.read(spark, sf_dir, "events").filter("event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return e.select("event_id", "user_id", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id"))).cast("bigint").alias("place"))


def span_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one type (with a range) in their order, the body cut short where it is long."""
    rows = S.span_texts(spark, sf_dir).filter("section_type = 'type1' and page_start > 0")
    return rows.select("doc", "id", "lft", F.length(T.truncated(F.col("markdown"), 6000)).cast("bigint").alias("n_chars"), F.row_number().over(Window.partitionBy("doc").orderBy("page_start", "id")).cast("bigint").alias("place"))


def ordered_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by a flag and name, by a name in any case, and by a condition and key, within each nation."""
    s = S.read(spark, sf_dir, "supplier").withColumn("flag", F.col("s_suppkey") % 5 == 0)
    place = lambda *o: F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*o)).cast("bigint")
    return s.select("s_suppkey", place(F.desc("flag"), "s_name").alias("by_flag"), place(F.lower("s_name").desc(), "s_suppkey").alias("by_name"), place(F.col("s_suppkey") % 3 == 1, "s_suppkey").alias("by_condition"))


def first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts of each order with a large quantity, as first seen."""
    li = S.read(spark, sf_dir, "lineitem").filter("l_quantity >= 20")
    first = li.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("line"))
    return first.select("l_orderkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("line", "l_suppkey")).cast("bigint").alias("place"))


def patched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with columns patched where the patch is not null, and a default where there is no row at all."""
    o, li = S.read(spark, sf_dir, "orders"), S.read(spark, sf_dir, "lineitem")
    patch = li.filter("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_orderkey") % 2 == 0, "X").alias("o_orderstatus"), F.when(F.col("l_orderkey") % 3 == 0, F.lit(0.0)).alias("o_totalprice"))
    review = li.filter("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("review"))
    rows = runs.patched(o.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice")), patch, ["o_orderkey"])
    return rows.join(review, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), T.or_default(F.col("review"), "not_started").alias("review"))


def seeded_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections pointed to canonical types, and types with those seeds that were missing."""
    p = S.read(spark, sf_dir, "part")
    types = p.select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "t_").otherwise("k"), F.col("p_partkey").cast("string")).alias("type_name"), F.col("p_type").alias("label"), F.col("p_partkey").alias("creation"))
    sections = p.select(F.lit(1).alias("doc"), F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "t_").otherwise("k"), F.col("p_partkey").cast("string")).alias("section_type"))
    counted = explore.retyped(sections, explore.merged_types(types)).groupBy("section_type").agg(F.count("*").alias("sections"))
    seeds = p.select(F.concat(F.lit("k"), (F.col("p_partkey") * 3).cast("string")).alias("section_type"), F.lit(0).cast("bigint").alias("sections"))
    return explore.missing(counted, seeds, ["section_type"])


def project_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents: their own project, else that of their nation's import, else the default."""
    c, n = S.read(spark, sf_dir, "customer"), S.read(spark, sf_dir, "nation")
    own = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("own"), F.col("c_custkey").cast("string")))
    inherited = n.select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("imported"))
    return c.join(inherited, "c_nationkey", "left").select("c_custkey", F.coalesce(own, "imported", F.lit("Uncategorized")).alias("project"))


def warning_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of order lines after some pages were taken from the other run, per order: of no page or of page 1, all, and page numbers."""
    li = S.read(spark, sf_dir, "lineitem")
    local = li.filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_linenumber")).cast("bigint").alias("page_no"), F.lit("local").alias("run"))
    cloud = li.filter("l_linenumber > 3").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 3).cast("bigint").alias("page_no"), F.lit("cloud").alias("run"))
    taken = li.filter("l_linenumber = 2 and l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("doc"), F.lit(2).cast("bigint").alias("page_no"))
    all_ = adopt.merged_warnings(local, cloud, taken)
    shown = F.sum((F.col("page_no").isNull() | (F.col("page_no") == 1)).cast("bigint"))
    return all_.groupBy("doc").agg(F.count("*").alias("warnings"), shown.alias("shown"), F.array_join(F.array_sort(F.collect_set("page_no")), ",").alias("pages"))


def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids asked for that there are not."""
    o = S.read(spark, sf_dir, "orders")
    asked = o.select((F.col("o_orderkey") * 2).alias("id"))
    return asked.join(o.select(F.col("o_orderkey").alias("id")), "id", "left_anti")


def any_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts hold a table by the looser rule, on texts with gaps of one letter between."""
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, F.repeat(F.lit("a  b  c\n"), F.col("p_size") % 5)).when(k == 1, F.repeat(F.concat(F.lit("|x|"), size, F.lit("|\n")), F.col("p_size") % 5)).when(k == 2, F.concat(F.lit("Revision Description Issue\n"), F.repeat(F.concat(size, F.lit("\n")), F.col("p_size") % 7))).otherwise(F.repeat(F.lit("aa  bb  cc\n"), F.col("p_size") % 5))
    return S.read(spark, sf_dir, "part").select("p_partkey", score.source_has_any_table(text).alias("has_table"))


def unfenced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order tables within an outer fence, or none, or one of another kind."""
    fence = F.when(F.col("key") % 4 == 0, "```md\n").when(F.col("key") % 4 == 1, "```\n").when(F.col("key") % 4 == 2, "```sql\n")
    body = F.replace("markdown", F.lit("```"), F.lit("~"))
    return S.tables(spark, sf_dir).select("key", F.md5(clean.unfenced(F.coalesce(F.concat(fence, body, F.lit("\n```")), body))).alias("digest"))


_ART = """CASE doc_id % 7 WHEN 0 THEN chr(10) || 'picture intentionally omitted' WHEN 1 THEN chr(10) || '--- Start of picture text' WHEN 2 THEN chr(10) || '|  |  |  |' || chr(10) WHEN 3 THEN repeat('<br>', 16) WHEN 4 THEN chr(10) || chr(10) || '|a|b|' || chr(10) || '|1|2|' || chr(10) || chr(10) || '|z|' ELSE '' END"""
_MANGLED = fidelity._SCORES.replace("lower(coalesce(baseline, ''))", f"lower(coalesce(baseline || {_ART}, ''))").replace("SELECT v.doc, v.page_no, v.kind, v.judge_score", "SELECT v.doc, v.page_no, v.doc_id, v.baseline, 'text' AS kind, v.judge_score").replace(
    ">= 3 THEN 0.0::DOUBLE END AS table_score", ">= 3 THEN CASE WHEN doc_id % 7 IN (2, 4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS table_score"
)
_OUTLINED = structure._SECTIONS.replace("ELSE depth END AS level0", "WHEN lower(title) = 'remarks' THEN 8 ELSE depth END AS level0")

ORACLES = {
    "older_adoption": f"WITH {retrieval._CANDIDATES}, r AS (SELECT *, CASE WHEN kind = 'visual' OR br < 0.85 THEN 'vlm' ELSE 'cleanup' END AS method FROM cand) SELECT doc, page_no, method, CASE WHEN method = 'vlm' THEN coalesce(mc > bc, false) ELSE cr >= br - 0.12 END AS adopted, bc < 0.9 AND coalesce(mc > bc, false) AS kept_best FROM r",
    "page_artifacts": f"WITH {_MANGLED}, a AS (SELECT doc, page_no, composite, CASE doc_id % 7 WHEN 0 THEN 'picture omitted' WHEN 1 THEN 'picture-text wrapper' WHEN 2 THEN 'empty table cells, orphaned table row' WHEN 3 THEN 'flattened <br> blob' WHEN 4 THEN 'table missing separator row, orphaned table row' ELSE '' END AS artifacts FROM weighed), s AS (SELECT doc, page_no, artifacts, CASE WHEN artifacts <> '' THEN round((0.7::DOUBLE * composite::DOUBLE)::VARCHAR::DECIMAL(20, 17), 3)::DOUBLE ELSE composite::DOUBLE END AS composite FROM a) SELECT *, CASE WHEN composite >= 0.9 THEN 'pass' WHEN composite >= 0.7 THEN 'escalate' ELSE 'review' END AS verdict FROM s",
    "content_recall": f"WITH {PAGES}" + r""", cut AS (SELECT doc, page_no, 'Handbook page ' || page_no || chr(10) || truth || chr(10) || 'printed copy' AS truth, baseline AS parsed FROM pages_v),
        ln AS (SELECT doc, page_no, unnest(string_split(truth, chr(10))) AS line FROM cut),
        fm AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS form FROM ln), ct AS (SELECT doc, count(*) AS n FROM cut GROUP BY 1),
        furn AS (SELECT doc, form FROM (SELECT DISTINCT doc, page_no, form FROM fm) JOIN ct USING (doc) WHERE length(form) >= 6 AND n >= 3 GROUP BY doc, form, n HAVING count(*) >= greatest(2, round_even(0.5 * n, 0))),
        tk AS (SELECT doc, page_no, unnest(regexp_extract_all(regexp_replace(lower(line), '[#*_`>\-|]', ' ', 'g'), '[a-z0-9]+')) AS token, 1 AS t, 0 AS p FROM fm WHERE (doc, form) NOT IN (SELECT doc, form FROM furn)
          UNION ALL SELECT doc, page_no, unnest(regexp_extract_all(regexp_replace(lower(parsed), '[#*_`>\-|]', ' ', 'g'), '[a-z0-9]+')), 0, 1 FROM cut),
        pt AS (SELECT doc, page_no, token, sum(t) AS t, sum(p) AS p FROM tk GROUP BY ALL), sm AS (SELECT doc, page_no, sum(least(t, p)) AS b, sum(t) AS t FROM pt GROUP BY ALL)
        SELECT doc, page_no, round(CASE WHEN coalesce(t, 0) = 0 THEN 1.0::DOUBLE ELSE b::DOUBLE / t END, 6) AS text_recall FROM cut LEFT JOIN sm USING (doc, page_no)""",
    "page_tokens": r"""SELECT page_id, len(w) AS tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(lower(html), '<[^>]+>', ' ', 'g'), '[#*_`>\-|]', ' ', 'g'), '[a-z0-9]+') AS w FROM pages)""",
    "outline_levels": f"WITH {_OUTLINED} SELECT doc, idx, title, level, path FROM sections_v",
    "line_predicates": r"""WITH v AS (SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'Pg. ' || p_size || ' of 60' WHEN 1 THEN 'see PAGE ' || p_size || ' of 9' WHEN 2 THEN 'MAN/a1/' || p_size WHEN 3 THEN '| Prepared by ' || p_name || ' | Approved by x |' WHEN 4 THEN '|' || p_name || '|' WHEN 5 THEN '  | ' || p_name
          WHEN 6 THEN p_size || '. ' || p_size || ' ' || p_name WHEN 7 THEN p_name || ' *' WHEN 8 THEN 'I''ve just moved ' || p_name WHEN 9 THEN 'I will move ' || p_name WHEN 10 THEN 'Issue : ' || p_size ELSE '**==> picture [9 x 9] intentionally omitted <==**' || repeat('x', (p_size * 5)::INT) || 'Start of picture text' END AS line, p_partkey % 12 AS k, p_size FROM part)
        SELECT p_partkey, regexp_matches(line, '(?i)\bpg\.?\s*\d+\s*of\s*\d+|\bpage\s*\d+\s*of\s*\d+|^man/[a-z0-9/]+|\bver\.?\s*:|\bissue\s*:\s*\d|^\s*date\s*:') AS varying,
        regexp_matches(trim(line), '^\|.*\|$') AND list_sum(list_transform(['prepared by', 'issued by', 'approved by', 'reviewed by', 'authorized by'], lambda x: contains(lower(line), x)::INT)) >= 2 AS sign_off,
        starts_with(trim(line), '|') AND ends_with(trim(line), '|') AND length(trim(line)) >= 2 AS table_line, starts_with(trim(line), '|') AS pipe_line, regexp_matches(line, '^\s*\|.*\|\s*$') AS table_row, contains(line, '*') OR regexp_matches(line, '^\d+\.\s+\d') AS list_item,
        regexp_matches(line, '(?i)\bI(''ve| have)\s+(now\s+|just\s+|already\s+)?(moved|renamed|re-?tagged|re-?parsed|re-?classified|regenerated|embedded|toggled|set the (section )?type|created the (section )?type)\b') AS claim,
        contains(substr(line, strpos(line, '<==**') + 5, 200), 'Start of picture text') AS shown_text FROM v""",
    "scalar_values": r"""WITH o AS (SELECT *, '{"a":' || p_size || '}' AS obj FROM part),
        v AS (SELECT *, ['so:' || chr(10) || '```json' || chr(10) || obj || chr(10) || '```' || chr(10) || 'end', obj, 'it is ' || obj || ' ok', '{broken', '', obj || ' ok', '{''a'':1}', obj || '{"b":2}', '[1,2] tail ' || obj, p_size || ' apples', '[' || p_size || ', 2]'][p_partkey % 11 + 1] AS raw,
          ['{"md":"' || p_name || '"}', '{"text":"t","content":"' || p_name || '"}', '  ' || p_name || chr(10), '', '{"other":1}', obj || ' ok', '{''a'':1}', '{"md":null,"text":"t"}', '"quoted"', '{"text":5}', '[1,2]'][p_partkey % 11 + 1] AS rep,
          CASE p_partkey % 5 WHEN 0 THEN '[{"a":1},{"a":2}]' WHEN 1 THEN 'not json' WHEN 2 THEN '[1] x' WHEN 3 THEN '{}' END AS l FROM o),
        w AS (SELECT *, trim(CASE WHEN regexp_matches(raw, '(?s)```(?:json)?\s*(.*?)```') THEN regexp_extract(raw, '(?s)```(?:json)?\s*(.*?)```', 1) ELSE raw END, E' \n') AS body,
          CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS raw_json, CASE WHEN json_valid(rep) THEN rep ELSE 'null' END AS rep_json, CASE WHEN json_valid(l) THEN l ELSE 'null' END AS l_json FROM v)
        SELECT p_partkey, regexp_replace(regexp_replace(trim(' __' || p_name || ' / ' || p_brand || '__ '), '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS file_slug, CASE p_partkey % 6 WHEN 0 THEN 'bool' WHEN 1 THEN 'null' WHEN 2 THEN 'int' WHEN 3 THEN 'float' WHEN 4 THEN 'float' ELSE 'string' END AS option_kind,
        CASE WHEN json_valid(body) THEN body WHEN json_valid(regexp_extract(body, '(?s)\{.*\}')) THEN regexp_extract(body, '(?s)\{.*\}') END AS salvaged, CASE WHEN json_type(raw_json) = 'OBJECT' THEN raw ELSE '{}' END AS object,
        CASE WHEN json_type(rep_json) = 'OBJECT' THEN CASE WHEN list_contains(json_keys(rep_json), 'markdown') THEN coalesce(rep_json ->> '$.markdown', '') WHEN list_contains(json_keys(rep_json), 'md') THEN coalesce(rep_json ->> '$.md', '') WHEN list_contains(json_keys(rep_json), 'text') THEN coalesce(rep_json ->> '$.text', '') ELSE coalesce(rep_json ->> '$.content', '') END
          WHEN json_type(rep_json) = 'VARCHAR' THEN rep_json ->> '$' ELSE trim(rep, E' \n') END AS reply,
        CASE WHEN p_partkey % 5 IN (0, 1, 4) THEN p_size::DOUBLE ELSE 0.0 END AS cost, '0:0:' || p_name || ';0:1:x;1:0:y;1:1:' || p_size AS cells, '{"b":"' || p_brand || '","z":"' || p_size || '"}' AS sorted_json, CASE WHEN p_size > 9 AND p_size <= 25 THEN p_name ELSE 'none' END AS setting,
        'data:image/png;base64,' || base64(encode(p_brand)) AS data_url, CASE WHEN json_type(l_json) = 'ARRAY' THEN json_array_length(l_json) ELSE 0 END::BIGINT AS listed, '{"code":"w","severity":"info","message":"' || p_brand || '","page_number":' || p_size || '}' AS warning, strftime(make_timestamp(p_size::BIGINT * 100000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at, true AS run_id FROM w""",
    "session_listing": "SELECT event_id, user_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'click' QUALIFY place <= 50",
    "span_scan": f"WITH {SPANS} SELECT doc, id, lft, CASE WHEN length(markdown) > 6000 THEN 6012 ELSE length(markdown) END AS n_chars, row_number() OVER (PARTITION BY doc ORDER BY page_start, id) AS place FROM spans_v WHERE section_type = 'type1' AND page_start > 0",
    "ordered_suppliers": "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey % 5 = 0) DESC, s_name) AS by_flag, row_number() OVER (PARTITION BY s_nationkey ORDER BY lower(s_name) DESC, s_suppkey) AS by_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 = 1, s_suppkey) AS by_condition FROM supplier",
    "first_images": "SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_suppkey) AS place FROM lineitem WHERE l_quantity >= 20 GROUP BY 1, 2",
    "patched_orders": "SELECT o.o_orderkey, CASE WHEN p.l_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(CASE WHEN p.l_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END::DOUBLE, 2) AS o_totalprice, coalesce(nullif(r.l_returnflag, ''), 'not_started') AS review FROM orders o LEFT JOIN lineitem p ON p.l_orderkey = o.o_orderkey AND p.l_linenumber = 2 LEFT JOIN lineitem r ON r.l_orderkey = o.o_orderkey AND r.l_linenumber = 3",
    "seeded_types": r"""WITH t AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 't_' ELSE 'k' END || p_partkey AS type_name, first_value(CASE WHEN p_partkey % 2 = 0 THEN 't_' ELSE 'k' END || p_partkey) OVER (PARTITION BY lower(trim(regexp_replace(p_type, '\s+', ' ', 'g'))) ORDER BY p_partkey % 2 = 0, p_partkey) AS canonical FROM part),
        c AS (SELECT canonical AS section_type, count(*) AS sections FROM t GROUP BY 1) SELECT * FROM c UNION ALL SELECT 'k' || p_partkey * 3, 0 FROM part WHERE 'k' || p_partkey * 3 NOT IN (SELECT section_type FROM c)""",
    "project_backfill": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'own' || c_custkey WHEN n_nationkey % 3 <> 0 THEN n_name ELSE 'Uncategorized' END AS project FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "warning_union": """WITH taken AS (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2 AND l_orderkey % 2 = 0),
        w AS (SELECT l_orderkey AS doc, CASE WHEN l_suppkey % 4 <> 0 THEN l_linenumber END AS page_no FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT l_orderkey, l_linenumber - 3 + 100 FROM lineitem WHERE l_linenumber > 3),
        k AS (SELECT doc, CASE WHEN page_no > 100 THEN page_no - 100 ELSE page_no END AS page_no FROM w WHERE NOT (coalesce(page_no, 0) = 2 AND doc IN (SELECT l_orderkey FROM taken)))
        SELECT doc, count(*) AS warnings, sum((page_no IS NULL OR page_no = 1)::INT)::BIGINT AS shown, coalesce(string_agg(DISTINCT page_no, ',' ORDER BY page_no), '') AS pages FROM k GROUP BY 1""",
    "missing_ids": "SELECT o_orderkey * 2 AS id FROM orders WHERE o_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)",
    "any_tables": r"""WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN repeat('a  b  c' || chr(10), (p_size % 5)::INT) WHEN 1 THEN repeat('|x|' || p_size || '|' || chr(10), (p_size % 5)::INT) WHEN 2 THEN 'Revision Description Issue' || chr(10) || repeat(p_size || chr(10), (p_size % 7)::INT) ELSE repeat('aa  bb  cc' || chr(10), (p_size % 5)::INT) END AS t FROM part),
        c AS (SELECT p_partkey, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\s*\|.*\|\s*$') OR len(regexp_extract_all(x, '\S\s{2,}\S')) >= 2)) AS tabular, list_sum(list_transform(['revision', 'description', 'initiated by', 'approved by', 'page', 'issue'], lambda x: contains(lower(t), x)::INT)) AS heads,
          len(regexp_extract_all(t, '\b\d{1,2}/\d{4}\b')) AS dates, len(regexp_extract_all(t, '(?m)^\s*\d+\s*$')) AS numbers FROM v)
        SELECT p_partkey, tabular >= 3 OR (heads >= 3 AND (dates >= 3 OR numbers >= 4)) AS has_table FROM c""",
    "unfenced_pages": f"WITH {TABLES} SELECT key, md5(CASE key % 4 WHEN 2 THEN '```sql' || chr(10) || replace(markdown, '```', '~') || chr(10) || '```' ELSE replace(markdown, '```', '~') END) AS digest FROM tables_v",
}

QUERIES = {
    f.__name__: f
    for f in (
        older_adoption, page_artifacts, content_recall, page_tokens, outline_levels, line_predicates, scalar_values, session_listing, span_scan, ordered_suppliers, first_images, patched_orders, seeded_types, project_backfill,
        warning_union, missing_ids, any_tables, unfenced_pages,
    )
}
