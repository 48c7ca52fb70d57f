"""Operators on small inputs with known answers."""

import random
import re

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import adopt, clean, editing, explore, lint, refs, runs, score, sectionize, tree, wiki
from quire.plans import retrieval
from quire.sources import canonical, tables


def pages(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "doc string, page_no bigint, markdown string")


def sections(spark, *texts):
    return [tuple(r) for r in sectionize.sections(pages(spark, *texts)).orderBy("idx").select("title", "level", "page_start", "page_end", "markdown").collect()]


def test_numbers_give_levels_and_paths(spark):
    """Dots count, not marks; a title without a number keeps its marks' level and hangs under the nearest lower one."""
    found = sectionize.sections(pages(spark, "### 4 Rivers\nlong\n# 4.2 Weirs\n##### Locks\nshut", "#### 4.2.1. Gates\n## 5. Lakes\ndeep")).orderBy("idx").collect()
    assert [(r["title"], r["level"], r["page_start"], r["page_end"]) for r in found] == [("4 Rivers", 1, 1, 1), ("4.2 Weirs", 2, 1, 1), ("Locks", 5, 1, 1), ("4.2.1. Gates", 3, 2, 2), ("5. Lakes", 1, 2, 2)]
    assert [r["path"] for r in found][2:] == [["4 Rivers", "4.2 Weirs", "Locks"], ["4 Rivers", "4.2 Weirs", "4.2.1. Gates"], ["5. Lakes"]]


def test_chapter_numbers_must_rise(spark):
    assert [(t, lv) for t, lv, *_ in sections(spark, "# 7. Tin\n# 9. Zinc", "# 8. Lead\n# 9. Iron\n# 10. Gold\n# 11. 3 rings")] == [("7. Tin", 1), ("9. Zinc", 1), ("8. Lead", 2), ("9. Iron", 2), ("10. Gold", 1), ("11. 3 rings", 2)]


def test_repeated_titles_fold(spark):
    """A numbered title's repeats fold into its first from anywhere; other titles only if they are neighbours of one level."""
    assert sections(spark, "# 2. Kilns\nfire", "# Notes\nn1", "# 2. KILNS\nash", "# notes\nn2") == [("2. Kilns", 1, 1, 3, "fire\nash"), ("Notes", 1, 2, 4, "n1\nn2")]
    assert [(t, m) for t, _, _, _, m in sections(spark, "# Notes\nn1\n## Notes\nn2\n# Notes\nn3")] == [("Notes", "n1"), ("Notes", "n2"), ("Notes", "n3")]


def test_text_without_heading_is_a_preamble(spark):
    assert sections(spark, "", "no marks here\nat all") == [("Preamble", 1, 1, 2, "no marks here\nat all")]


def test_outlines_give_levels_of_any_depth(spark):
    names = [(f"Step {chr(65 + i)}", i + 1) for i in range(8)]
    outline = spark.createDataFrame([("d", f"  {n.upper()} ", lv) for n, lv in names], "doc string, title string, level int")
    found = sectionize.sections(pages(spark, *[f"# _{n}_\nbody {lv}" for n, lv in names]), outline).orderBy("idx").collect()
    assert [r["level"] for r in found] == list(range(1, 9)) and found[7]["path"] == [n for n, _ in names]


def test_lines_end_at_any_line_end(spark):
    row = spark.createDataFrame([("a\r\nb\x0cc\u2028d\n",)], "t string").select(T.lines(F.col("t")).alias("l")).first()
    assert row["l"] == "a\r\nb\x0cc\u2028d\n".splitlines()


def test_furniture_goes_and_data_rows_stay(spark):
    rows = clean.cleaned(pages(spark, "Page 4 of 12\n|Reviewed by K|Issued by L|\n|---|---|\nwater", "|reviewed by|k|\n|---|---|")).orderBy("page_no").collect()
    assert [r["markdown"] for r in rows] == ["water", "|reviewed by|k|\n|---|---|"]


def test_finalizing_twice_changes_nothing(spark):
    first = clean.finalized(pages(spark, *[f"Mill handbook\nM-77\nwheel {w}\npg {i} of 4" for i, w in enumerate("wxyz", 1)]))
    assert first.filter("changed").count() == 4
    assert [r["markdown"] for r in first.orderBy("page_no").collect()] == ["wheel w", "wheel x", "wheel y", "wheel z"]
    assert clean.finalized(first.drop("changed")).filter("changed").count() == 0


def test_outer_fence(spark):
    rows = spark.createDataFrame([(1, "```markdown\nq\n```"), (2, "```\nr\ns\n```"), (3, "```yaml\nt: 1\n```"), (4, "```\nu\n```\nv\n```\nw\n```")], "k int, t string")
    assert [r[0] for r in rows.orderBy("k").select(clean.unfenced(F.col("t"))).collect()] == ["q", "r\ns", "```yaml\nt: 1\n```", "```\nu\n```\nv\n```\nw\n```"]


def codes(spark, text):
    return [(r["code"], r["line"]) for r in lint.issues(spark.createDataFrame([(1, text)], "key int, markdown string"), ["key"]).collect()]


def test_lint(spark):
    assert codes(spark, "|a|b|\n|1|2|") == [("missing_separator", 1)]
    assert codes(spark, "|a|b|c|\n|-|-|-|\n|1|2|\n|1|") == [("ragged_row", 3), ("ragged_row", 4)]
    assert codes(spark, "x\n|a|\ny") == [("lone_pipe_row", 2)]
    assert codes(spark, "```\nx") == [("unclosed_fence", 0)]
    assert codes(spark, "") == codes(spark, None) == []
    assert codes(spark, "```\n|a|b|\n|1|2|\n```") == []
    assert codes(spark, "|a|b|\n|---|---|\n|1 \\| 2|3|") == []
    assert len(codes(spark, "\n\n".join(["|x|"] * 20))) == 8


def test_repair_is_idempotent(spark):
    once = lint.repaired(spark.createDataFrame([(1, "|a|b|\n|1|2|\n\n|lone|")], "key int, markdown string"), ["key"])
    assert once.first()["markdown"] == "|a|b|\n|---|---|\n|1|2|\n\n|lone|"
    assert lint.repaired(once, ["key"]).first()["markdown"] == once.first()["markdown"]


def test_page_scores(spark):
    rows = spark.createDataFrame(
        [("d", 1, "text", "the fox jumps over it", "the fox jumps over it", None), ("d", 2, "text", "the fox jumps over the lazy dog again", "The fox.", None), ("d", 3, "visual", "", "", None), ("d", 4, "text", None, None, None)],
        "doc string, page_no int, kind string, truth string, markdown string, judge_score double",
    )
    found = {r["page_no"]: r for r in score.page_scores(rows, ["doc", "page_no"]).collect()}
    assert found[1]["verdict"] == "pass" and found[1]["text_recall"] == 1
    assert found[2]["text_recall"] < 0.85 and "low text recall" in found[2]["notes"]
    assert (found[3]["composite"], found[3]["verdict"]) == (0, "review")
    assert found[4]["text_recall"] == 1 and found[4]["extra_ratio"] == 0


def test_token_comparisons_group_nothing(spark):
    """Repeats count, an empty side has its fixed value, and no token is a row: no explosion, grouping or exchange, so memory does not grow with pages."""
    rows = spark.createDataFrame([("d", 1, "The *red* RED fox_trot", "red red red trot", "the red red fox trot"), ("d", 2, None, "stray", None), ("d", 3, "kept", "", "lost")], "doc string, page_no int, truth string, a string, b string")
    found = score.overlaps(rows, ["doc", "page_no"], "truth", ("a", "b"))
    assert [tuple(r)[1:] for r in found.orderBy("page_no").collect()] == [(1, 3 / 5, 1 / 4, 1.0, 0.0), (2, 1.0, 1.0, 1.0, 0.0), (3, 0.0, 0.0, 0.0, 1.0)]
    assert [tuple(r)[1:] for r in score.overlap(rows, ["doc", "page_no"], "truth", "a").orderBy("page_no").collect()] == [(1, 3 / 5, 1 / 4), (2, 1.0, 1.0), (3, 0.0, 0.0)]
    for one in (found, score.overlap(rows, ["doc", "page_no"], "truth", "a")):
        assert not any(x in one._jdf.queryExecution().executedPlan().toString() for x in ("Generate", "Aggregate", "Exchange"))


def test_smallest_cover(spark):
    spans = spark.createDataFrame([("d", "wide", 1, 10, 1), ("d", "tight", 5, 6, 2), ("d", "tie", 6, 7, 4), ("d", "open", None, None, 6)], "doc string, id string, page_start int, page_end int, lft int")
    points = spark.createDataFrame([("d", n) for n in (5, 6, 3, 11)], "doc string, page int")
    assert {r["page"]: r["id"] for r in refs.smallest_cover(spans, points).collect()} == {5: "tight", 6: "tight", 3: "wide", 11: None}


def test_references(spark):
    rows = [("d", "alpha", 1, 2, 1, 2, "See page 5. See page 5."), ("d", "beta", 3, 4, 3, 4, "refer to page no. 5; Williams p820; page 3"), ("d", "gamma", 5, 6, 5, 8, "see page 99"), ("d", "detail", 5, 5, 6, 7, "see page 5")]
    s = spark.createDataFrame(rows, "doc string, id string, page_start int, page_end int, lft int, rgt int, markdown string")
    counts = spark.createDataFrame([("d", 6)], "doc string, page_count int")
    assert sorted((r["from_id"], r["to_id"], r["occurrences"]) for r in refs.edges(s, s, counts).collect()) == [("alpha", "detail", 2), ("beta", "detail", 1)]
    routes = s.select("doc", "id", F.col("id").alias("route"))
    text = {r["id"]: r["markdown"] for r in wiki.linked(s, s, routes, counts).collect()}
    assert text["alpha"] == "[See page 5](/detail). [See page 5](/detail)." and text["detail"] == "see page 5"


def test_mentions_are_searched_once(spark):
    """Parts of mentions are those of one search, and edges and their readers search no text again."""
    texts = ["See page 3, refer\tto\nPAGE NO.12 p.7", "pg.12345 see see p. 5x page no 0009 refer pg 7. PAGE no. 1", "", None]
    found = refs.mentions(rows := pages(spark, *texts).withColumn("id", F.col("page_no").cast("string")))
    want = [(str(i), m[0], m[1] or "", m[2], int(m[3])) for i, t in enumerate(texts, 1) for m in re.finditer(T.PAGE_REFERENCE, t or "")]
    assert sorted(tuple(r)[1:] for r in found.collect()) == sorted(want) and len(want) == 6
    spans = spark.createDataFrame([("d", "1", 1, 2, 1), ("d", "2", 3, 12, 3)], "doc string, id string, page_start int, page_end int, lft int")
    counts = spark.createDataFrame([("d", 12)], "doc string, page_count int")
    edges = refs.edges(rows, spans, counts)
    assert sorted(tuple(r)[1:] for r in edges.collect()) == [("1", "2", 3, "See page 3", 1), ("1", "2", 12, "refer\tto\nPAGE NO.12", 1), ("2", "1", 1, "PAGE no. 1", 1)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(found).count("regexp_extract_all") <= 1 and "regexp_extract_all" not in plan(edges)


def small_tree(spark):
    rows = [("d", "a", None, "Alpha", 0, True), ("d", "b", "a", "Child", 0, True), ("d", "c", None, "Beta", 1, True), ("d", "e", "c", "Deep", None, False)]
    return spark.createDataFrame(rows, "doc string, id string, parent string, title string, sort_order int, include boolean").withColumns({"page_start": F.lit(1), "page_end": F.lit(2), "markdown": F.concat("title", F.lit("\n## Part Two\nrest"))})


def spans(df):
    return {r["id"]: (r["lft"], r["rgt"], r["level"], r["path"]) for r in df.collect()}


def test_mentions_are_looked_for_where_one_can_start(spark):
    """The pattern gives up after two characters nearly everywhere, and finds what it finds without that look."""
    look = "(?=[srp][eag.])"
    assert T.PAGE_REFERENCE.startswith("(?i)" + look)
    texts = ["See\npage 4", "REFER  TO pG.7, sp. 3", "seepage 9 see p.5", "refer page no. 12x page No.12", "see see p 1 P. 2345 p.23456", "pp.3 PAGE\t8", "reefer p. 1"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    plain = F.regexp_extract_all("x", F.lit(T.PAGE_REFERENCE.replace(look, "")), F.lit(0))
    for found, want in rows.select(F.regexp_extract_all("x", F.lit(T.PAGE_REFERENCE), F.lit(0)), plain).collect():
        assert found == want


def test_texts_go_to_their_spans_without_being_dealt_by_page(spark):
    plan = tables.span_texts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan
    assert "RepartitionByExpression" in tables.pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_tree_edits(spark):
    nodes = tree.nested_set(small_tree(spark))
    assert spans(nodes) == {"a": (1, 4, 1, ["Alpha"]), "b": (2, 3, 2, ["Alpha", "Child"]), "c": (5, 8, 1, ["Beta"]), "e": (6, 7, 2, ["Beta", "Deep"])}
    one = lambda **kw: spark.createDataFrame([tuple(kw.values())], list(kw))
    assert set(spans(tree.delete(nodes, one(doc="d", id="c")))) == {"a", "b"}
    assert spans(tree.rename(nodes, one(doc="d", id="a", title="New")))["b"][3] == ["New", "Child"]
    assert spans(tree.move(nodes, one(doc="d", id="b", parent="c", index=0)))["b"] == (4, 5, 2, ["Beta", "Child"])
    assert spans(tree.move(nodes, one(doc="d", id="a", parent="b", index=0))) == spans(nodes)
    assert {r["id"]: r["include"] for r in tree.include(nodes, one(doc="d", id="c"), True).collect()}["e"] is True
    merged = tree.merge(nodes, spark.createDataFrame([("d", "a", "a"), ("d", "a", "c")], "doc string, keep string, id string"))
    assert spans(merged)["e"][3] == ["Alpha", "Deep"] and "c" not in spans(merged)
    made = tree.create(nodes.drop("level", "path", "line", "is_group", "lft", "rgt"), spark.createDataFrame([("d", "n", "a", "New", True, 0), ("d", "m", "gone", "Lost", True, 0), ("d", "b", None, "Taken", True, 0)], "doc string, id string, parent string, title string, include boolean, index int"))
    assert spans(made)["n"] == (2, 3, 2, ["Alpha", "New"]) and spans(made)["b"] == (4, 5, 2, ["Alpha", "Child"]) and "m" not in spans(made)


def test_splits_keep_the_heading_line(spark):
    body = "\n intro\nnorth bank\n\n  ### North   bank \nreeds\n\n# east bank\nmud\n\n"
    nodes = tree.nested_set(spark.createDataFrame([("d", "r", None, "River", 0, True, body, 2, 9), ("d", "s", None, "Sea", 0, True, "salt", 3, 4), ("d", "k", "r", "Kid", 0, True, None, None, None)], "doc string, id string, parent string, title string, sort_order int, include boolean, markdown string, page_start int, page_end int"))
    ask = lambda *rows: spark.createDataFrame(rows, "doc string, id string, heading string, new_id string")
    got = tree.split(nodes, ask(("d", "r", "## EAST bank ", "r2"), ("d", "s", "none", "s2"))).orderBy("lft").collect()
    assert [(r["id"], r["title"], r["markdown"]) for r in got if r["parent"] is None] == [("r", "River", "intro\nnorth bank\n\n  ### North   bank \nreeds"), ("r2", "east bank", "# east bank\nmud"), ("s", "Sea", "salt")]
    assert all((r["page_start"], r["page_end"]) == (2, 9) for r in got if r["id"] in ("r", "r2"))
    # a plain line of the same text is no heading
    got = {r["id"]: r["markdown"] for r in tree.split(nodes, ask(("d", "r", "north   bank", "r2"))).collect()}
    assert got["r"] == "intro\nnorth bank" and got["r2"].startswith("### North   bank \nreeds")


def test_merges_trim_bodies_and_widen_ranges(spark):
    rows = [("d", "a", None, 0, " one \n", 5, 6), ("d", "b", None, 1, " \n", None, None), ("d", "c", None, 2, "\nthree", 2, 4), ("d", "x", "c", 0, "x", 3, 3), ("d", "y", "a", 0, "y", 1, 1)]
    nodes = tree.nested_set(spark.createDataFrame([(d, i, p, "T", o, True, m, s, e) for d, i, p, o, m, s, e in rows], "doc string, id string, parent string, title string, sort_order int, include boolean, markdown string, page_start int, page_end int"))
    got = {r["id"]: r for r in tree.merge(nodes, spark.createDataFrame([("d", "a", i) for i in "abcy"], "doc string, keep string, id string")).collect()}
    assert set(got) == {"a", "x", "y"} and (got["a"]["markdown"], got["a"]["page_start"], got["a"]["page_end"]) == ("one\n\nthree", 2, 6) and got["x"]["parent"] == "a"


def test_forty_levels(spark):
    rows = [("d", f"n{i:02}", f"n{i - 1:02}" if i else None, "Same", 0, True) for i in range(40)]
    nodes = tree.nested_set(spark.createDataFrame(rows, "doc string, id string, parent string, title string, sort_order int, include boolean"))
    assert spans(nodes)["n39"][:3] == (40, 41, 40) and wiki.routes(wiki.slugs(wiki.siblings(nodes))).count() == 40


def test_edits_need_one_occurrence(spark):
    rows = spark.createDataFrame([("one two", "two", "x"), ("two two", "two", "x"), ("one", "two", "x"), ("one", "", "x"), ("one", None, "x"), ("one", "one", None), ("aaa", "aa", "b"), ("cut it", " it", "")], "t string, f string, n string")
    assert [r[0] for r in rows.select(editing.replaced_once(F.col("t"), F.col("f"), F.col("n"))).collect()] == ["one x", None, None, None, None, None, "ba", "cut"]


def test_untagged_and_empty_scope(spark):
    s = spark.createDataFrame([("d", 1, "x"), ("d", 2, ""), ("d", 3, None)], "doc string, id int, section_type string")
    types = spark.createDataFrame([("x",), ("y",)], "type_name string")
    assert {r[0]: r[1] for r in explore.type_summary(s, types).collect()} == {"x": 1, "y": 0, explore.UNTAGGED: 2}
    assert {r[0]: r[1] for r in explore.type_summary(s, types, s.select("doc").limit(0)).collect()} == {"x": 0, "y": 0}


def test_cloud_improves(spark):
    def improves(lr, le, cr, ce):
        row = spark.createDataFrame([(float(lr), float(le), float(cr), float(ce))], "lr double, le double, cr double, ce double")
        none = F.lit(None).cast("double")
        return row.select(adopt.improves({"recall": F.col("lr"), "extra": F.col("le"), "table": none}, {"recall": F.col("cr"), "extra": F.col("ce"), "table": none})).first()[0]

    assert improves(1.0, 0.22, 0.99, 0.01) and not improves(1.0, 0.22, 0.43, 0.02)


def test_page_ranges(spark):
    rows = spark.createDataFrame([(1, 10, "1-3,5"), (2, 3, "2-9"), (3, 5, "all"), (4, 5, "4-2,3")], "id int, page_count int, pages string")
    found = runs.page_selection(rows).orderBy("id", "place").collect()
    assert [[r["page"] for r in found if r["id"] == k] for k in (1, 2, 3, 4)] == [[1, 2, 3, 5], [2, 3], [1, 2, 3, 4, 5], [4, 3, 2]]


def test_normal_forms(spark):
    row = spark.range(1).select(T.label_form(F.lit(" Straße X ")), T.slug(F.lit("")), T.boilerplate_form(F.lit("## A_b  c")), T.furniture_form(F.lit(" Pg 17 of  180")), T.path_depth(F.lit("a > b")))
    assert tuple(row.first()) == ("strasse x", "page", "a b c", "pg # of #", 2)


def test_canonical_documents(spark, tmp_path):
    folder = tmp_path / "run1"
    folder.mkdir()
    (folder / "canonical.json").write_text(
        '{"document": {"id": "d"}, "parse_run": {"id": "r"}, "pages": [{"id": "p1", "page_number": 1, "metadata": {"source_text": "Heading Body"},'
        ' "blocks": [{"id": "b2", "page_id": "p1", "type": "paragraph", "text": "Body", "reading_order": 2}, {"id": "b1", "page_id": "p1", "type": "heading", "markdown": "# Heading", "reading_order": 1}]}],'
        ' "sections": [{"id": "s1", "block_ids": ["b1", "b2", "gone"]}]}'
    )
    docs = canonical.read(spark, str(tmp_path))
    assert canonical.pages(docs).first()["markdown"] == "# Heading\n\nBody"
    assert canonical.graph(docs).groupBy("type").count().orderBy("type").collect() == [("BLOCK_PART_OF_SECTION", 2), ("DOCUMENT_HAS_PAGE", 1), ("PAGE_HAS_BLOCK", 2)]


def test_graph_of_odd_documents(spark):
    """Runs and ids that are missing, a run in several documents, blocks twice in a document and refs into another one, loaded twice."""
    ids = [None, "x", "y"]
    docs = [
        {"parse_run": {"id": run}, "document": {"id": doc}, "pages": pages, "sections": sections}
        for run, doc, pages, sections in [
            ("r", "d", [{"id": "p", "blocks": [{"id": b, "page_id": p, "type": t} for b in ids for p in ids for t in (None, "table")]}, {"id": None, "blocks": None}, {"id": "q", "blocks": []}], [{"id": s, "block_ids": ["x", "y", "z", None]} for s in ids] + [{"id": "n", "block_ids": None}]),
            ("r", "e", [{"id": "p", "blocks": [{"id": "z", "page_id": "p", "type": "paragraph"}]}], [{"id": "s", "block_ids": ["x", "gone"]}]),
            (None, None, [{"id": "p", "blocks": [{"id": "x", "page_id": None, "type": "table"}, {"id": "x", "page_id": "p", "type": "table"}]}], [{"id": "s", "block_ids": ["x"]}]),
            ("t", "d", None, [{"id": "s", "block_ids": ["x"]}]),
            ("u", None, [{"id": "p", "blocks": [{"id": "x", "page_id": "p", "type": "table"}]}], None),
        ]
    ]
    blocks = [(d["parse_run"]["id"], b["id"], b["page_id"], b["type"]) for d in docs for p in d["pages"] or [] for b in p["blocks"] or []]
    want = {(d["parse_run"]["id"], "DOCUMENT_HAS_PAGE", d["document"]["id"], p["id"]) for d in docs for p in d["pages"] or []} | {(r, "PAGE_HAS_BLOCK", p, b) for r, b, p, _ in blocks}
    for run, section, ref in [(d["parse_run"]["id"], s["id"], b) for d in docs for s in d["sections"] or [] for b in s["block_ids"] or []]:
        kinds = {t for r, b, _, t in blocks if None not in (r, b) and (r, b) == (run, ref)}
        want |= {(run, "BLOCK_PART_OF_SECTION", ref, section)} if kinds else set()
        want |= {(run, "SECTION_HAS_TABLE", section, ref)} if "table" in kinds else set()
    given = spark.createDataFrame(docs, canonical.SCHEMA)
    found = canonical.graph(given.union(given)).collect()
    assert len(found) == len(want) and {(r["run"], r["type"], r["source"], r["target"]) for r in found} == want
    assert all(r["edge_id"] == ":".join(x for x in (r["run"], "edge", r["type"], r["source"], r["target"]) if x is not None) for r in found)


def test_tables_are_stitched_over_pages(spark):
    rows = clean.stitched(pages(spark, "intro\n|a|b|\n|---|---|\n|1|2|", "|a|b|\n|---|---|\n|3|4|", "|5|6|\nafter", "none")).orderBy("page_no").collect()
    assert [r["markdown"] for r in rows] == ["intro\n|a|b|\n|---|---|\n|1|2|\n|3|4|", "", "|5|6|\nafter", "none"]
    apart = clean.stitched(pages(spark, "|a|b|\n|1|2|", "|x|y|z|\nend")).orderBy("page_no").collect()
    assert [r["markdown"] for r in apart] == ["|a|b|\n|1|2|", "|x|y|z|\nend"]


def test_table_rows_at_the_ends_of_pages(spark):
    """Rows at either end count whatever white space and line ends stand around them, and a text is cut into lines once."""
    texts = ["\n\n |a|b|\r\n|c|\nx", "x\n|a|\u0085", "x\n|a|b| \u2028", "|a|\n\x1c", "x | y |", "| open\nx", "", None, "|a|b|c|\n|-|-|-|\n|1|2|3|\n", "x\r|1|\r\n|2|3| \t\n\n", "\ny\n|z|\n\u0085\n"]
    rows = clean.edge_rows(pages(spark, *texts))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(r"split(CASE") == 1
    got = [(r["lead"], r["tail"], r["lead_columns"], r["tail_columns"], bool(r["whole"]), r["more"]) for r in rows.orderBy("page_no").collect()]
    table = ["|1|2|3|"]
    assert got == [(2, 0, 2, None, False, [" |a|b|", "|c|"]), (0, 1, None, 1, False, None), (0, 1, None, 2, False, None), (1, 0, 1, None, False, ["|a|"]), (0, 0, None, None, False, None), (0, 0, None, None, False, None),
        (0, 0, None, None, False, None), (0, 0, None, None, False, None), (3, 3, 3, 3, True, table), (0, 2, None, 1, False, None), (0, 0, None, None, False, None)]


def test_pages_are_cleaned_once_for_all_their_sections(spark):
    """Each section's pages come out as when they are cleaned as a document of their own, and what lines give is not found for each section again."""
    rng = random.Random(5)
    parts = ["Common line", "# common   LINE", "page 3 of 9", "Page-3 of 9", "x" * 91, "y" * 45 + " " * 3 + "y" * 44, "|Reviewed by K|Issued by L|", "|---|---|", "| Prepared by | approved by |", "", "  ", "Date : 1", "Ver. : 2", "|a|b|", "Ünder *water*", "z" * 90]
    texts = [None if k % 7 == 0 else "\n".join(rng.choice(parts if rng.random() < 0.8 else [f"own {k}"]) for _ in range(rng.randrange(12))) for k in range(60)]
    rows = pages(spark, *texts)
    ranges = [(f"s{a}-{n}", a, a + n - 1) for n in (1, 2, 3, 4, 9, 60) for a in range(1, 61, max(1, n // 2)) if a + n <= 61]
    covers = spark.createDataFrame([("d", s, p) for s, a, b in ranges for p in range(a, b + 1)], "doc string, id string, page_no bigint")
    found = clean.cleaned_spans(covers, rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "pvi" not in plan
    want = clean.cleaned(covers.join(rows, ["doc", "page_no"]).select(F.col("id").alias("doc"), "page_no", "markdown"))
    got = {(r["id"], r["page_no"]): r["markdown"] for r in found.collect()}
    assert got == {(r["doc"], r["page_no"]): r["m"] for r in want.select("doc", "page_no", T.strip(F.col("markdown")).alias("m")).collect()}
    assert len(got) == covers.count()


def test_varying_lines(spark):
    old = (r"(?i)\bpg\.?\s*\d+\s*of\s*\d+", r"(?i)\bpage\s*\d+\s*of\s*\d+", r"(?i)^man/[a-z0-9/]+", r"(?i)\bver\.?\s*:", r"(?i)\bissue\s*:\s*\d", r"(?i)^\s*date\s*:")
    texts = ["Pg.3of 9", "xpage 1 of 2", "- PAGE 1OF2", "page 1 of", "MAN/a", " man/a", "ver:", "Ver. :", "over:", "Issue : 4", "tissue:4", "issue: x", " Date :", "x date:", "pg 7 of 8 pg", "", "pages 1 of 2", "éver:"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.array(*[F.col("t").rlike(p) for p in old])
    for t, got, want in rows.select("t", T.is_varying(F.col("t")), plain).collect():
        assert got == any(want), t


def test_tables_are_repaired_within_their_text(spark):
    """Every block that lacks a separator gets one, none within fences, and only lines that can be of a table are ordered."""
    text = "|a|b|\n|1|2|\ntext\n```\n|f|\n|g|\n```\n |c|\n|d|\n\n|e|\n|-|\n|h|\n\n|i|\n~~~\n|j|\n|k|"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "plain\n\n"), (None, "|a|\n|b|"), (5, "x\n|a|\n|b|\n|c|d|\n")], "key int, markdown string")
    got = {r["key"]: r["markdown"] for r in lint.repaired(rows, ["key"]).collect()}
    assert got == {1: text.replace("|1|2|", "|---|---|\n|1|2|").replace("\n|d|", "\n|---|\n|d|"), 2: "", 3: "plain\n\n", None: "|a|\n|---|\n|b|", 5: "x\n|a|\n|---|\n|b|\n|c|d|\n"}
    assert lint.marked_lines(rows, ["key"]).count() == 20


def test_line_ends(spark):
    texts = ["a\r\nb\n", "\n", "", "\r\n\r\n", "a\n\r", "a\x1cb\x1d\x1e", "\u2028x\u2029", "a\x0bb\x0cc\x85", "\r\r\n", "\n\n\n", "é\r\n", "a\x1f"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    old = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    plain = F.split(F.regexp_replace("t", f"(?:{old})\\z", ""), old, -1)
    for t, got, want in rows.select("t", T.lines(F.col("t")), plain).collect():
        assert got == want, t


def test_source_tables(spark):
    rows = spark.createDataFrame([(1, "|a|b|\n|c|d|\n|e|f|"), (2, "a  b  c\nd  e  f\ng  h  i"), (3, "Revision Description Page 1/2020 2/2021 3/2022"), (4, "plain text"), (5, "aa  bb  cc\naa  bb  cc\naa  bb  cc")], "k int, t string")
    assert [r[0] for r in rows.orderBy("k").select(score.source_has_any_table(F.col("t"))).collect()] == [True, False, True, False, True]


def test_passages_are_found_by_any_part(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, passage), (2, "Alpha beta"), (3, ""), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [passage, "so two three four five six seven eight nine ten", "one two three x five six seven eight nine ten", "here alpha, beta stand in a text of more than eight words", "", "eight seven six five four three two one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["doc_id"], r["item_id"]): r["text_recall"] for r in retrieval.benchmark_overlap(spark, str(tmp_path)).collect()}
    assert found == {(0, 1): 1.0, (1, 1): 0.9, (3, 2): 1.0}


def test_deep_trees_and_orphans_are_whole(spark):
    rows = [("d", f"n{i:02}", f"n{i - 1:02}" if i else None, "Same", 0, True) for i in range(15)] + [("d", "x", "gone", "Lost", 1, True), ("d", "y", "x", "Lost child", 0, True)]
    nodes = tree.nested_set(spark.createDataFrame(rows, "doc string, id string, parent string, title string, sort_order int, include boolean"))
    found = spans(nodes)
    assert len(found) == 17 and found["n14"][:3] == (15, 16, 15) and found["n00"][:2] == (1, 30)
    assert found["x"] == (31, 34, 1, ["Lost"]) and found["y"] == (32, 33, 2, ["Lost", "Lost child"])
    routes = {r["id"]: r["route"] for r in wiki.routes(wiki.slugs(wiki.siblings(nodes))).collect()}
    assert len(routes) == 17 and routes["n14"] == "d" + 15 * "/same" and routes["y"] == "d/lost/lost-child"


def test_slugs_that_meet(spark):
    titles = ["A", "A 2", "A", "A", "A 2", "B 1", "B 2", "B 2", "A 2 2", "C", "C", "C 3 1"]
    placed = spark.createDataFrame([("d", i, None, t, i) for i, t in enumerate(titles)], "doc string, id int, wiki_parent int, title string, place int")
    taken = set()
    for i, t in enumerate(titles):
        base = t.lower().replace(" ", "-")
        titles[i] = next(s for s in [base, *(f"{base}-{n}" for n in range(2, 20))] if s not in taken)
        taken.add(titles[i])
    assert [r["slug"] for r in wiki.slugs(placed).orderBy("place").collect()] == titles
