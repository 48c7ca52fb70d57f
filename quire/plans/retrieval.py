"""Queries on adoption, runs, types, logs, sessions and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import adopt, explore, runs, score, segments, sessions
from quire.plans.views import PAGES, exact_mean
from quire.sources import tables as S

KEYS = ["doc", "page_no"]
#: Tokens in a row by which a passage is found in a document.
RUN = 8


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as sections: lft is the id, the type comes from the labels, some types are empty or missing."""
    d, lab = S.read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), S.read(spark, sf_dir, "labels")
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "")
    return d.join(lab, "doc_id", "left").select(F.coalesce("source", F.lit("")).alias("doc"), F.col("doc_id").alias("id"), F.col("doc_id").alias("lft"), kind.alias("section_type"), "lang")


def _types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("good", 1), ("toxic", 2), ("unused", 3)], "type_name string, creation int")


def type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.type_summary(_sections(spark, sf_dir), _types(spark))


def type_summary_in_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = _sections(spark, sf_dir)
    project = sections.filter("doc like '%1'").select("doc").distinct()
    return explore.type_summary(sections, _types(spark), project)


def sections_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = _sections(spark, sf_dir)
    titles = sections.filter("doc <> 'src3'").select("doc", F.concat(F.lit("Title of "), "doc").alias("title")).distinct()
    found = explore.sections_by_type(sections, titles, explore.UNTAGGED)
    return found.select("doc", "title", F.size("sections").cast("bigint").alias("sections"), F.md5(F.array_join("sections", ",")).alias("digest"))


def merged_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.read(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("t_"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("k"), F.col("p_partkey").cast("string")))
    types = p.select(name.alias("type_name"), F.concat(F.lit(" "), F.upper("p_brand"), F.lit("  "), F.col("p_type")).alias("label"), F.col("p_partkey").alias("creation"))
    return explore.merged_types(types)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with recall, extra and composite of each candidate, from one pass over the texts' tokens."""
    c, names = F.col, ("baseline", "cleanup", "vlm")
    pages = S.pages(spark, sf_dir).withColumns({"has_cleanup": c("cleanup").isNotNull(), "has_vlm": c("vlm").isNotNull()})
    out = score.overlaps(pages, [*KEYS, "kind", "has_cleanup", "has_vlm"], "truth", names)
    for name in names:
        recall, extra = c(f"{name}_recall"), c(f"{name}_extra")
        value = score.composite({"text_recall": recall, "not_hallucinated": 1 - extra}, {k: score.TEXT_WEIGHTS[k] for k in ("text_recall", "not_hallucinated")})
        value = value if name == "baseline" else F.when(c(f"has_{name}"), value)
        out = out.withColumn(f"{name}_composite", value).withColumns({f"{name}_recall": F.round(recall, 3), f"{name}_extra": F.round(extra, 3)})
    return out


def adopt_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    won = adopt.winner(c("baseline_composite"), c("baseline_recall"), c("cleanup_composite"), c("cleanup_recall"), c("vlm_composite"), c("kind"))
    return _candidates(spark, sf_dir).select(*KEYS, won.alias("winner"))


def canonical_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adopt.document_means(_candidates(spark, sf_dir), "vlm_composite", "baseline_composite")


def escalation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = adopt.escalation_reasons(F.col("baseline_recall"), F.col("baseline_extra"), F.lit(None).cast("double"), 0.95, 0.005)
    return _candidates(spark, sf_dir).select(*KEYS, F.array_join(reasons, ",").alias("reasons")).filter("reasons <> ''")


def hybrid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.settle(_candidates(spark, sf_dir), "candidates")
    side = lambda p: rows.select(*KEYS, F.lit(p).alias("markdown"), F.col(f"{p}_recall").alias("recall"), F.col(f"{p}_extra").alias("extra"), F.lit(None).cast("double").alias("tbl"))
    return adopt.hybrid(side("baseline"), side("cleanup").filter("page_no % 2 = 0")).select(*KEYS, "recall", "extra", "provenance")


def flagged_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select(*KEYS, F.col("baseline_composite").alias("composite"), score.verdict(F.col("baseline_composite")).alias("verdict"))
    return adopt.worst(rows, 3).select(*KEYS, F.col("place").cast("bigint").alias("place"))


def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adopt.sampled(S.pages(spark, sf_dir).select(*KEYS), 7)


def bakeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the mean composite of each candidate over flagged pages, and pages where the baseline wins."""
    rows = _candidates(spark, sf_dir).filter(score.verdict(F.col("baseline_composite")) != "pass")
    best = F.greatest(F.coalesce("cleanup_composite", F.lit(-1.0)), F.coalesce("vlm_composite", F.lit(-1.0)))
    wins = F.sum((F.col("baseline_composite") >= best).cast("bigint")).alias("baseline_wins")
    return rows.groupBy("doc").agg(*[T.exact_mean(F.col(f"{name}_composite")).alias(name) for name in ("baseline", "cleanup", "vlm")], wins)


def cost_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.read(spark, sf_dir, "lineitem")
    calls = li.select(F.concat("l_returnflag", "l_linestatus").alias("label"), F.col("l_quantity").alias("seconds"), F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).when(F.col("l_linenumber") != 1, F.col("l_extendedprice")).alias("cost"))
    return runs.cost_by_label(calls)


def run_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages and their lines as blocks, one run per order priority; some lines lose page, box or section."""
    o = S.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), "o_orderkey", "o_totalprice")
    li = S.read(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    blocks = li.select("run", F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("page_id"), key.alias("block_id"), F.when(F.col("l_returnflag") == "R", "table").otherwise("paragraph").alias("type"), F.when(F.col("l_linestatus") == "F", F.lit(1)).alias("bbox"))
    pages = o.select("run", F.col("o_orderkey").alias("page_id"), ((F.col("o_orderkey") % 100) / 100.0).alias("text_recall"), ((F.col("o_orderkey") % 7) / 10.0).alias("extra_ratio"))
    held = li.filter("l_linenumber <> 3").select("run", F.when(F.col("l_linenumber") == 5, F.concat(F.lit("x"), key)).otherwise(key).alias("block_id"))
    return runs.scorecard(blocks, pages, held)


def run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, their orders as runs, line numbers as pages."""
    o, li = S.read(spark, sf_dir, "orders"), S.read(spark, sf_dir, "lineitem")
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started_at"), F.col("l_linenumber").alias("page_no"))
    found = runs.overview(rows)
    return found.select("doc", F.size("runs").cast("bigint").alias("runs"), F.col("runs")[0].alias("newest"), F.array_join("page_numbers", ",").alias("page_numbers"))


def log_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return sessions.sequenced(e, "user_id", ["ts", "event_id"]).select("event_id", "user_id", F.col("idx_seq").cast("bigint").alias("idx_seq"))


def latest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.read(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    found = runs.latest(e.select("user_id", "event_type", "event_id", "at"), ["user_id", "event_type"], "at")
    return found.select("user_id", "event_type", "event_id", F.col("first_at.event_id").alias("first_event"))


def last_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.read(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return sessions.progress(e, "user_id", "value", "at")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: events by type as conditional sums, and the share that are not views."""
    e = S.read(spark, sf_dir, "events")
    other = F.sum((F.col("event_type") != "view").cast("bigint"))
    return e.groupBy("user_id").agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("types"), other.alias("semantic"), F.round(T.share(other, F.count("*")), 6).alias("share"))


def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    spec = F.when(k % 3 == 0, "all").when(k % 3 == 1, F.concat((k % 9 + 1).cast("string"), F.lit("-"), (k % 5 + 1).cast("string"), F.lit(", 2,99"))).otherwise(F.concat((k % 4).cast("string"), F.lit(",3-4")))
    found = runs.page_selection(o.select(k.alias("id"), (k % 6 + 1).cast("int").alias("page_count"), spec.alias("pages")))
    return found.select("id", F.col("page").cast("bigint").alias("page"), F.col("place").cast("bigint").alias("place"))


def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.titles(S.read(spark, sf_dir, "conversations"))


def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.replay(S.read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.col("place").cast("bigint").alias("place"))


def last_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_answers(S.read(spark, sf_dir, "conversations")).select("conv_id", F.md5("text").alias("digest"))


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.read(spark, sf_dir, "conversations").select("conv_id", "role")
    return sessions.changes(c, c.filter("conv_id % 9 <> 0").unionByName(c.filter("conv_id % 50 = 1"))).groupBy("conv_id", "role", "side").agg(F.count("*").alias("rows"))


def _runs(tokens: str, n: int) -> Column:
    """The runs of n tokens, joined by blanks; none where there are fewer."""
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token recall of each benchmark passage in the documents that hold any RUN tokens of it in a row.

    A passage of fewer tokens is looked up whole, at its own length; one without any gives no row. The lengths
    of such passages, at most RUN - 1 numbers, are collected.
    """
    b, d = S.read(spark, sf_dir, "benchmark"), S.read(spark, sf_dir, "documents")
    words = lambda df, key: df.select(key, T.tokens(F.col("text")).alias("tk"))
    items = words(b, "item_id").filter(F.size("tk") > 0)
    short = [r[0] for r in items.filter(F.size("tk") < RUN).select(F.size("tk")).distinct().collect()]
    looked_up = F.when(F.size("tk") < RUN, F.array(F.array_join("tk", " "))).otherwise(_runs("tk", RUN))
    wanted = items.select("item_id", F.explode(F.array_distinct(looked_up)).alias("gram"))
    held = words(d, "doc_id").select("doc_id", F.explode(F.array_distinct(F.concat(*[_runs("tk", n) for n in [RUN, *sorted(short)]]))).alias("gram"))
    hits = held.join(wanted, "gram").select("doc_id", "item_id").distinct()
    pairs = hits.join(d.select("doc_id", F.col("text").alias("parsed")), "doc_id").join(b.select("item_id", F.col("text").alias("truth")), "item_id")
    return score.overlap(pairs, ["doc_id", "item_id"], "truth", "parsed").select("doc_id", "item_id", F.round("text_recall", 6).alias("text_recall"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.read(spark, sf_dir, "part")
    title = F.concat(F.lit(" **"), (F.col("p_partkey") % 20).cast("string"), F.lit("."), (F.col("p_size") % 3).cast("string"), F.lit(". "), "p_name", F.lit("**_ "))
    clean = T.clean_title(title)
    row = F.concat(F.lit("| "), "p_brand", F.lit(r" \| x | "), "p_type", F.lit(" ||"))
    return p.select(
        "p_partkey",
        clean.alias("clean_title"),
        T.number_level(clean, F.lit(3)).cast("bigint").alias("level"),
        T.chapter(clean).alias("chapter"),
        T.slug(title).alias("slug"),
        T.label_form(F.concat(F.lit(" Straße  "), "p_brand")).alias("label"),
        T.cell_count(row).cast("bigint").alias("cells"),
        T.column_count(row).cast("bigint").alias("columns"),
        T.document_id(F.col("p_name").cast("binary")).alias("document_id"),
        T.block_label(F.when(F.col("p_size") > 25, "table").otherwise("text"), F.col("p_type")).alias("label_of_block"),
        T.block_markdown(F.lit("heading"), F.col("p_name"), (F.col("p_size") % 4 + 1).cast("int")).alias("heading"),
        T.path_depth(F.concat_ws(" > ", "p_brand", F.when(F.col("p_size") > 9, F.col("p_type")), F.lit(" "))).cast("bigint").alias("depth"),
        T.number_or(F.when(F.col("p_size") > 9, F.col("p_size").cast("string")).otherwise(F.lit("n/a")), -1.0).alias("number"),
        T.page_kind(F.col("p_name"), F.col("p_size") % 2, F.col("p_size")).alias("kind"),
        T.truncated(F.col("p_type"), 10).alias("short"),
    )


_TOKENS = r"""regexp_extract_all(regexp_replace(lower(coalesce({}, '')), '[#*_`>\-|]', ' ', 'g'), '[a-z0-9]+')"""
_PARTS = " UNION ALL ".join(
    f"SELECT doc, page_no, '{c}' AS name, unnest({_TOKENS.format(c)}) AS token, 0 AS t, 1 AS p FROM pages_v UNION ALL SELECT doc, page_no, '{c}', unnest({_TOKENS.format('truth')}), 1, 0 FROM pages_v" for c in ("baseline", "cleanup", "vlm")
)
_CANDIDATES = PAGES + f""", toks AS ({_PARTS}), per AS (SELECT doc, page_no, name, token, sum(t) AS t, sum(p) AS p FROM toks GROUP BY ALL),
sums AS (SELECT doc, page_no, name, sum(least(t, p)) AS common_n, sum(t) AS t, sum(p) AS p FROM per GROUP BY ALL),
rates AS (SELECT *, CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE common_n::DOUBLE / t END AS recall, CASE WHEN p = 0 THEN 0.0::DOUBLE ELSE (p - common_n)::DOUBLE / p END AS extra FROM sums),
wide AS (SELECT doc, page_no, name, round(recall, 3) AS recall, round(extra, 3) AS extra, round((0.4::DOUBLE * recall + 0.15::DOUBLE * (1 - extra)) / (0.4::DOUBLE + 0.15::DOUBLE), 3) AS composite FROM rates),
cand AS (SELECT v.doc, v.page_no, v.kind, b.recall AS br, b.extra AS be, b.composite AS bc, c.recall AS cr, c.extra AS ce, CASE WHEN v.cleanup IS NOT NULL THEN c.composite END AS cc, CASE WHEN v.vlm IS NOT NULL THEN m.composite END AS mc
  FROM pages_v v JOIN wide b ON b.doc = v.doc AND b.page_no = v.page_no AND b.name = 'baseline' JOIN wide c ON c.doc = v.doc AND c.page_no = v.page_no AND c.name = 'cleanup' JOIN wide m ON m.doc = v.doc AND m.page_no = v.page_no AND m.name = 'vlm')"""
_SECTIONS = "sections_v AS (SELECT coalesce(source, '') AS doc, doc_id AS id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN '' END AS section_type FROM documents LEFT JOIN labels USING (doc_id)), types_v(type_name) AS (VALUES ('good'), ('toxic'), ('unused'))"
_SUMMARY = "SELECT type_name, count(id) AS sections FROM types_v LEFT JOIN s ON section_type = type_name GROUP BY 1 UNION ALL SELECT '__untagged__', count(*) FROM s WHERE coalesce(section_type, '') = '' HAVING count(*) > 0"
_VERDICT = "CASE WHEN bc >= 0.9 THEN 'pass' WHEN bc >= 0.7 THEN 'escalate' ELSE 'review' END"

ORACLES = {
    "type_summary": f"WITH {_SECTIONS}, s AS (SELECT * FROM sections_v) {_SUMMARY}",
    "type_summary_in_project": f"WITH {_SECTIONS}, s AS (SELECT * FROM sections_v WHERE doc LIKE '%1') {_SUMMARY}",
    "sections_by_type": f"WITH {_SECTIONS} SELECT doc, CASE WHEN doc = 'src3' THEN doc ELSE 'Title of ' || doc END AS title, count(*) AS sections, md5(string_agg(id::VARCHAR, ',' ORDER BY id)) AS digest FROM sections_v WHERE coalesce(section_type, '') = '' GROUP BY doc",
    "merged_types": r"""WITH t AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 't_' ELSE 'k' END || p_partkey AS type_name, lower(trim(regexp_replace(upper(p_brand) || '  ' || p_type, '\s+', ' ', 'g'))) AS form, p_partkey AS creation FROM part)
        SELECT type_name, first_value(type_name) OVER (PARTITION BY form ORDER BY starts_with(type_name, 't_'), creation) AS canonical FROM t""",
    "adopt_best": f"WITH {_CANDIDATES} SELECT doc, page_no, CASE WHEN coalesce(mc > bc, false) AND (NOT coalesce(kind = 'text' AND cc IS NOT NULL AND cr >= br - 0.12, false) OR mc >= cc) THEN 'vlm' WHEN coalesce(kind = 'text' AND cc IS NOT NULL AND cr >= br - 0.12, false) THEN 'cleanup' ELSE 'baseline' END AS winner FROM cand",
    "canonical_mean": f"WITH {_CANDIDATES} SELECT doc, {exact_mean("coalesce(mc, bc)")} AS canonical_mean FROM cand GROUP BY doc",
    "escalation_reasons": f"WITH {_CANDIDATES} SELECT doc, page_no, concat_ws(',', CASE WHEN br < 0.95 THEN 'text_recall' END, CASE WHEN be > 0.005 THEN 'extra_text_ratio' END) AS reasons FROM cand WHERE br < 0.95 OR be > 0.005",
    "hybrid_pages": f"WITH {_CANDIDATES}, k AS (SELECT *, page_no % 2 = 0 AND cr >= least(0.95, br) AND ((cr > br AND ce <= greatest(be, 0.15)) OR (ce < be AND cr >= 0.95)) AS take FROM cand) SELECT doc, page_no, CASE WHEN take THEN cr ELSE br END AS recall, CASE WHEN take THEN ce ELSE be END AS extra, CASE WHEN take THEN 'cloud' ELSE 'local' END AS provenance FROM k",
    "flagged_worst": f"WITH {_CANDIDATES} SELECT doc, page_no, row_number() OVER (PARTITION BY doc ORDER BY bc, page_no) AS place FROM cand WHERE {_VERDICT} <> 'pass' QUALIFY place <= 3",
    "sampled_pages": f"WITH {PAGES} SELECT doc, page_no FROM pages_v QUALIFY (page_no - 1) % greatest(1, count(*) OVER (PARTITION BY doc) // 7) = 0",
    "bakeoff": f"WITH {_CANDIDATES} SELECT doc, {exact_mean("bc")} AS baseline, {exact_mean("cc")} AS cleanup, {exact_mean("mc")} AS vlm, sum((bc >= greatest(coalesce(cc, -1), coalesce(mc, -1)))::BIGINT)::BIGINT AS baseline_wins FROM cand WHERE {_VERDICT} <> 'pass' GROUP BY doc",
    "cost_by_label": "SELECT l_returnflag || l_linestatus AS label, count(*) AS calls, round(sum(l_quantity), 2) AS seconds, round(sum(CASE WHEN l_returnflag <> 'N' OR l_linenumber <> 1 THEN l_extendedprice ELSE 0 END), 2) AS cost, bool_and(l_returnflag <> 'N' OR l_linenumber <> 1) AS cost_known FROM lineitem GROUP BY 1",
    "run_scorecard": f"""WITH o AS (SELECT o_orderpriority AS run, o_orderkey FROM orders), li AS (SELECT o.run, l.* FROM lineitem l JOIN o ON l_orderkey = o_orderkey),
        b AS (SELECT run, count(*) AS block_count, sum((l_returnflag = 'R')::INT)::BIGINT AS table_count, sum((l_linenumber <> 7)::INT)::BIGINT AS placed, sum((l_linestatus = 'F')::INT)::BIGINT AS boxed, count(*) = count(DISTINCT l_orderkey || ':' || l_linenumber) AS unique_ids, sum((l_linenumber <> 3)::INT)::BIGINT AS refs, sum((l_linenumber = 5)::INT)::BIGINT AS dangling FROM li GROUP BY 1),
        p AS (SELECT run, count(*) AS page_count, {exact_mean("(o_orderkey % 100) / 100.0::DOUBLE")} AS text_recall_avg, round(min((o_orderkey % 100) / 100.0::DOUBLE), 3) AS text_recall_min, {exact_mean("(o_orderkey % 7) / 10.0::DOUBLE")} AS extra_ratio_avg FROM o GROUP BY 1)
        SELECT run, page_count, block_count, table_count, text_recall_avg, text_recall_min, extra_ratio_avg, round(placed / block_count, 3) AS block_page_coverage, round(boxed / block_count, 3) AS bbox_coverage, round((refs - dangling) / refs, 3) AS section_block_coverage, unique_ids, dangling AS dangling_refs FROM p JOIN b USING (run)""",
    "run_overview": "SELECT o_custkey AS doc, count(DISTINCT o_orderkey) AS runs, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS newest, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS page_numbers FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "log_sequence": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx_seq FROM events",
    "latest_reviews": "SELECT user_id, event_type, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_min(event_id, {'t': ts, 'e': event_id}) AS first_event FROM events GROUP BY 1, 2",
    "last_progress": "SELECT user_id, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY 1",
    "event_counts": "SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS types, sum((event_type <> 'view')::INT)::BIGINT AS semantic, round(sum((event_type <> 'view')::INT) / count(*), 6) AS share FROM events GROUP BY 1",
    "page_selection": """WITH s AS (SELECT o_orderkey AS id, o_orderkey % 6 + 1 AS n, CASE o_orderkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN (o_orderkey % 9 + 1) || '-' || (o_orderkey % 5 + 1) || ', 2,99' ELSE (o_orderkey % 4) || ',3-4' END AS spec FROM orders),
        parts AS (SELECT id, n, unnest(string_split(replace(CASE WHEN spec = 'all' THEN '1-' || n ELSE spec END, ' ', ''), ',')) AS part, unnest(range(len(string_split(spec, ',')))) AS k FROM s),
        ends AS (SELECT id, n, k, string_split(part, '-')[1]::INT AS a, coalesce(string_split(part, '-')[2], string_split(part, '-')[1])::INT AS b FROM parts),
        listed AS (SELECT id, n, k, unnest(CASE WHEN a <= b THEN range(a, b + 1) ELSE range(a, b - 1, -1) END) AS page, unnest(range(abs(b - a) + 1)) AS i FROM ends)
        SELECT id, page, row_number() OVER (PARTITION BY id ORDER BY min(k * 1000 + i)) AS place FROM listed WHERE page BETWEEN 1 AND n GROUP BY id, page""",
    "session_titles": "SELECT conv_id, left(string_split(arg_min(text, turn), chr(10))[1], 120) AS title FROM conversations WHERE role = 'user' GROUP BY 1",
    "session_replay": "SELECT conv_id, turn, role, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) WHERE place <= 40 AND role <> 'system'",
    "last_answers": "SELECT conv_id, md5(arg_max(text, turn)) AS digest FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY 1",
    "snapshot_changes": """WITH n AS (SELECT conv_id, role, count(*) AS a, CASE WHEN conv_id % 9 <> 0 THEN count(*) ELSE 0 END + CASE WHEN conv_id % 50 = 1 THEN count(*) ELSE 0 END AS b FROM conversations GROUP BY 1, 2)
        SELECT conv_id, role, CASE WHEN a > b THEN 'before' ELSE 'after' END AS side, abs(a - b) AS rows FROM n WHERE a <> b""",
    "benchmark_overlap": f"""WITH bt AS (SELECT item_id, {_TOKENS.format('text')} AS tk FROM benchmark), dt AS (SELECT doc_id, {_TOKENS.format('text')} AS tk FROM documents),
        bg AS (SELECT DISTINCT item_id, least(8, len(tk)) AS n, array_to_string(tk[i:i + least(8, len(tk)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(tk) - 7, 1) + 1)) AS i FROM bt WHERE len(tk) > 0)),
        dw AS (SELECT doc_id, unnest(tk) AS w, unnest(range(len(tk))) AS i FROM dt),
        dg AS (SELECT DISTINCT doc_id, n, g FROM (SELECT doc_id, 8 AS n, concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) AS g FROM dw WINDOW o AS (PARTITION BY doc_id ORDER BY i))),
        hits AS (SELECT DISTINCT doc_id, item_id FROM bg JOIN dg USING (n, g) UNION SELECT doc_id, item_id FROM (SELECT item_id, g FROM bg WHERE n < 8) s JOIN dt d ON contains(' ' || array_to_string(d.tk, ' ') || ' ', ' ' || s.g || ' ')),
        bc AS (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest(tk) AS token FROM bt) GROUP BY 1, 2), dc AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(tk) AS token FROM dt WHERE doc_id IN (SELECT doc_id FROM hits)) GROUP BY 1, 2)
        SELECT h.doc_id, h.item_id, round(sum(least(bc.n, coalesce(dc.n, 0)))::DOUBLE / sum(bc.n), 6) AS text_recall FROM hits h JOIN bc USING (item_id) LEFT JOIN dc ON dc.doc_id = h.doc_id AND dc.token = bc.token GROUP BY 1, 2""",
    "scalar_functions": r"""WITH t AS (SELECT *, ' **' || (p_partkey % 20) || '.' || (p_size % 3) || '. ' || p_name || '**_ ' AS title, (p_partkey % 20) || '.' || (p_size % 3) || '. ' || p_name AS clean FROM part)
        SELECT p_partkey, clean AS clean_title, 2::BIGINT AS level, p_partkey % 20 AS chapter, left(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug, 'strasse ' || lower(p_brand) AS label, 3::BIGINT AS cells, 3::BIGINT AS columns,
        'doc_' || left(sha256(p_name), 16) AS document_id, CASE WHEN p_size > 25 THEN 'Table' ELSE left(p_type, 80) END AS label_of_block, repeat('#', (p_size % 4 + 1)::INT) || ' ' || p_name AS heading,
        CASE WHEN p_size > 9 THEN 2 ELSE 1 END::BIGINT AS depth, CASE WHEN p_size > 9 THEN p_size::DOUBLE ELSE -1.0 END AS number, CASE WHEN p_size % 2 > 0 OR p_size >= 40 THEN 'visual' ELSE 'text' END AS kind,
        CASE WHEN length(p_type) > 10 THEN left(p_type, 10) || '…[truncated]' ELSE p_type END AS short FROM t""",
}

QUERIES = {
    f.__name__: f
    for f in (
        type_summary, type_summary_in_project, sections_by_type, merged_types, adopt_best, canonical_mean, escalation_reasons, hybrid_pages, flagged_worst, sampled_pages, bakeoff, cost_by_label, run_scorecard,
        run_overview, log_sequence, latest_reviews, last_progress, event_counts, page_selection, session_titles, session_replay, last_answers, snapshot_changes, benchmark_overlap, scalar_functions,
    )
}
