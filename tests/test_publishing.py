"""Scans by segments, interval bins, merges, stored tables and streams on small inputs, against plain versions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import clean, editing, refs, runs, sectionize, segments, tree, wiki
from quire.plans import publishing
from quire.sources import stored
from quire.streaming import edges, fragments


def test_scans_by_segments_are_one_scan(spark, monkeypatch):
    """Sums, greatest and last values over segments of five rows equal those of one window; one document has nearly all rows."""
    r = random.Random(3)
    rows = [("big" if i % 40 else f"d{i}", i, r.choice([None, r.randint(0, 99)])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc string, n bigint, v int").repartition(7)
    w = Window.partitionBy("doc").orderBy("n")
    for own in (True, False):
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        got = segments.running(df, ["doc"], ["n"], F.floor(F.col("n") / 5), s=("sum", F.coalesce("v", F.lit(0)), own), m=("max", F.col("v"), own), l=("last", F.col("v"), own))
        want = df.select("doc", "n", "v", F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(frame), F.lit(0)).alias("s"), F.max("v").over(frame).alias("m"), F.last("v", ignorenulls=True).over(frame).alias("l"))
        assert sorted(map(tuple, got.select("doc", "n", "s", "m", "l").collect())) == sorted(map(tuple, want.select("doc", "n", "s", "m", "l").collect()))
    place = F.row_number().over(w)
    for got in (segments.numbered(df.select("doc", "n"), "doc", "n", "p", width=16), segments.ranked(df.select("doc", "n"), "doc", ["n"], "p")):
        assert sorted(map(tuple, got.select("doc", "n", "p").collect())) == sorted(map(tuple, df.select("doc", "n", place).collect()))


def test_sections_go_on_over_segments(spark):
    """Two thousand pages of one document, eight segments: chapters, places and folds carry over."""
    pages = spark.range(2000).select(F.lit("d").alias("doc"), (F.col("id") + 1).alias("page_no"), F.concat(F.lit("# "), F.col("id").cast("string"), F.lit(". T\nbody")).alias("markdown"))
    found = sectionize.sections(pages)
    assert found.count() == 2000 and [tuple(r) for r in found.filter("idx in (0, 1, 1999)").orderBy("idx").select("title", "level", "page_start", "markdown").collect()] == [("0. T", 2, 1, "body"), ("1. T", 1, 2, "body"), ("1999. T", 1, 2000, "body")]


@pytest.fixture(scope="module")
def spans(spark):
    """Nested spans of many widths in one document, and one without a range."""
    r, rows, n = random.Random(5), [], 0

    def grow(a, b, parent, depth):
        nonlocal n
        n += 1
        id_, lft = f"s{len(rows)}", n
        at = len(rows)
        rows.append(None)
        if depth < 6 and b > a:
            cut = sorted(r.sample(range(a, b), min(b - a, r.randint(1, 3))))
            for x, y in zip([a, *cut], [*cut, b]):
                grow(x, y, id_, depth + 1)
        n += 1
        rows[at] = ("d", id_, a, b, lft, n)

    grow(1, 700, None, 0)
    rows.append(("d", "none", 0, 0, n + 1, n + 2))
    return spark.createDataFrame(rows, "doc string, id string, page_start int, page_end int, lft int, rgt int").cache()


def test_covers_and_overlaps_by_bins(spark, spans):
    rows = [r for r in spans.collect() if r["page_start"]]
    points = spark.range(0, 720, 3).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("page"))
    cover = lambda p: [s for s in rows if s["page_start"] <= p <= s["page_end"]]
    for r in refs.smallest_cover(spans, points).collect():
        held = cover(r["page"])
        assert r["id"] == (min(held, key=lambda s: (s["page_end"] - s["page_start"], s["lft"]))["id"] if held else None)
    want = {(p, s["id"]) for p in range(0, 720, 3) for s in cover(p) if not any(t["lft"] > s["lft"] and t["rgt"] < s["rgt"] for t in cover(p))}
    assert {(r["page"], r["id"]) for r in refs.deepest_cover(spans, points).collect()} == want
    kin = lambda s, t: s["lft"] <= t["lft"] and s["rgt"] >= t["rgt"]
    pairs = sorted((s["id"], t["id"]) for s in rows for t in rows if s["page_start"] <= t["page_end"] and t["page_start"] <= s["page_end"] and not kin(s, t) and not kin(t, s))
    assert sorted((r["id"], r["other"]) for r in refs.overlapping(spans).collect()) == pairs


def test_candidates_of_covers_grow_with_points(spark):
    """A hundred thousand spans of one document: what meets before the range is looked at is a few spans a point."""
    n = 100_000
    flat = spark.range(n).select(F.lit("d").alias("doc"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), (2 * F.col("id") + 1).alias("page_start"), (2 * F.col("id") + 3).alias("page_end"), F.col("id").alias("lft"))
    points = spark.range(1, n, 50).select(F.lit("d").alias("doc"), F.col("id").alias("page"))
    page = F.col("page").cast("bigint")
    cells = points.withColumn("at", F.explode(refs.bins_of(page, page, F.lit(0)))).select("doc", "page", "at.level", "at.bin")
    assert cells.join(refs.binned(flat), ["doc", "level", "bin"]).count() <= 8 * points.count()
    assert refs.covering(flat, points).groupBy("page").count().filter("count > 2").count() == 0


def test_json_is_one_value_and_nothing_else(spark):
    odd = ['{"a":1} ok', "{'a':1}", '{"a":1}{"b":2}', '[1,2] tail {"a":1}', "3 apples", '{"a":1},"end":1', '1}', "", None, "{broken", "01", '{"a":1,}']
    sound = ['{"a":1}', " [1, 2]\n", "3", '"x"', "null", "true", '{"a":{"b":[1]}}']
    rows = {r[0]: r[1:] for r in spark.createDataFrame([(x,) for x in odd + sound], "r string").select("r", T.is_json(F.col("r")), T.salvaged_json(F.col("r")), T.reply_markdown(F.col("r")), T.json_length(F.col("r"))).collect()}
    assert [x for x in odd if rows[x][0]] == [] and all(rows[x][0] for x in sound)
    assert rows['{"a":1} ok'][1] == '{"a":1}' and rows['[1,2] tail {"a":1}'][1] == '{"a":1}' and rows['{"a":1}{"b":2}'][1] is None and rows["3 apples"][1] is None
    assert rows['{"a":1} ok'][2] == '{"a":1} ok' and rows['{"a":1}'][2] == "" and rows['"x"'][2] == "x" and rows[""][2] == "" and rows[None][2] == ""
    assert rows[" [1, 2]\n"][3] == 2 and rows["3"][3] == 0
    keys = spark.createDataFrame([('{"md":null,"text":"t"}',), ('{"content":"c","text":5}',)], "r string").select(T.reply_markdown(F.col("r"))).collect()
    assert [r[0] for r in keys] == ["", "5"]


def test_means_are_exact(spark):
    rows = spark.createDataFrame([(v,) for v in (0.801, 0.804, 0.802, 0.803, 0.802, 0.803)], "v double")
    assert rows.select(T.exact_mean(F.col("v"))).first()[0] == 0.803


TREE = [("d", "a", None, "Alpha", 0, True, None, 1, 4), ("d", "b", "a", "Beta", 0, True, "see page 4", 1, 2), ("d", "c", "a", "Beta", 1, True, "own text", 3, 4), ("d", "e", None, "Gone", 1, False, "x", 5, 5), ("f", "a", None, "Alpha", 0, True, None, None, None)]
NODES = "doc string, id string, parent string, title string, sort_order int, include boolean, markdown string, page_start int, page_end int"


def test_wiki_merge_twice_changes_nothing(spark):
    nodes = tree.nested_set(spark.createDataFrame(TREE, NODES))
    counts = spark.createDataFrame([("d", 5), ("f", 1)], "doc string, page_count int")
    none = spark.createDataFrame([], "wiki_id string, doc string, title string, is_group boolean, parent_id string, place int, slug string, route string, content string, created int")
    sections = nodes.withColumn("wiki_id", F.lit(None).cast("string"))
    pages = wiki.generated(nodes, counts)
    first = segments.settle(wiki.merged(none, sections, pages, 1), "first")
    got = {(r["doc"], r["section"]): r for r in first.collect()}
    assert {r["action"] for r in got.values()} == {"insert"} and set(got) == {("d", "a"), ("d", "b"), ("d", "c"), ("f", "a")}
    assert got["d", "a"]["content"] == "## Contents\n\n- [Beta](/d/alpha/beta)\n- [Beta](/d/alpha/beta-2)\n" and got["f", "a"]["content"] == "# Alpha\n"
    assert got["d", "b"]["content"] == "[see page 4](/d/alpha/beta-2)" and got["d", "b"]["parent_id"] == got["d", "a"]["wiki_id"]
    keep = ["wiki_id", "doc", *wiki.PAGE_FIELDS, "created"]
    again = wiki.merged(first.select(*keep), wiki.pointers(sections, first), pages, 2).collect()
    assert {r["action"] for r in again} == {"same"} and {r["created"] for r in again} == {1}
    # one renamed, one excluded, one page lost, another document's page there
    changed = [("d", "a", None, "Omega", *TREE[0][4:]), ("d", "b", "a", "Beta", 0, False, *TREE[1][6:]), *TREE[2:4]]
    nodes2 = tree.nested_set(spark.createDataFrame(changed, NODES))
    pointed = nodes2.join(wiki.pointers(sections, first).select("doc", "id", "wiki_id"), ["doc", "id"], "left")
    before = first.select(*keep).filter(F.col("section").isNull() | (F.col("section") != "c")) if "section" in keep else first.filter("section <> 'c'").select(*keep)
    third = {r["wiki_id"]: r for r in wiki.merged(before, pointed, wiki.generated(nodes2, counts), 3).collect()}
    of = {k: r["wiki_id"] for k, r in got.items()}
    assert third[of["d", "a"]]["action"] == "update" and third[of["d", "a"]]["title"] == "Omega" and third[of["d", "a"]]["created"] == 1
    assert third[of["d", "b"]]["action"] == "delete" and third[of["f", "a"]]["action"] == "keep"
    assert third[of["d", "c"]]["action"] == "insert" and third[of["d", "c"]]["slug"] == "beta" and third[of["d", "c"]]["created"] == 3


def test_previews_roll_up_link_and_lint(spark):
    nodes = tree.nested_set(spark.createDataFrame([*TREE[:4], ("d", "g", None, "G", 2, True, "|a|b|\n|1|2|", None, None)], NODES))
    documents = spark.createDataFrame([("d", "Manual", None, 5)], "doc string, title string, project string, page_count int")
    got = {r["id"]: r for r in wiki.preview(nodes, documents).collect()}
    assert got["a"]["markdown"] == "## Contents\n\n- [Beta](/section-preview/b)\n- [Beta](/section-preview/c)\n" and got["b"]["breadcrumb"] == ["Project", "Manual", "Alpha", "Beta"]
    assert got["b"]["shown"] == "[see page 4](/section-preview/c)" and got["b"]["page_refs_resolved"] == 1 and not got["e"]["include"]
    assert [x["code"] for x in got["g"]["lint"]] == ["missing_separator"]


def test_stored_documents_are_replaced(spark, tmp_path):
    path, make = str(tmp_path / "t"), lambda rows: spark.createDataFrame(rows, "doc string, id int, x string")
    first = make([("a", 1, "x"), ("b", 1, "y"), ("b", 2, None), (None, 7, "n"), ("12", 1, "z")])
    stored.replace(first, path, first.select("doc"))
    read = lambda: sorted(map(tuple, stored.read(spark, path, first.schema).collect()), key=str)
    assert read() == sorted(map(tuple, first.collect()), key=str)
    for _ in range(2):
        stored.replace(make([("b", 9, "new"), ("zz", 1, "left out")]), path, make([("b", 0, ""), ("a", 0, "")]).select("doc"))
        assert read() == sorted([("b", 9, "new"), (None, 7, "n"), ("12", 1, "z")], key=str)
    own = stored.read(spark, path, first.schema)
    stored.replace(own.withColumn("x", F.lit("self")), path, own.select("doc").filter("doc = '12'"))
    assert ("12", 1, "self") in read() and ("b", 9, "new") in read()


def test_streamed_edges_are_the_batch_form(spark, tmp_path):
    spans = spark.createDataFrame([("d", "a", 1, 4, 1, 6), ("d", "b", 1, 2, 2, 3), ("d", "c", 3, 4, 4, 5), ("e", "a", 1, 9, 1, 2)], "doc string, id string, page_start bigint, page_end bigint, lft bigint, rgt bigint")
    counts = spark.createDataFrame([("d", 4), ("e", 9)], "doc string, page_count bigint")
    schema = "doc string, id string, at int, markdown string"
    steps = [[("d", "b", 0, "see page 3"), ("d", "c", 0, "see page 1"), ("e", "a", 0, "see page 2")], [("d", "b", 1, "page no. 4, page no. 4"), ("d", "b", 2, "see page 4")], [("d", "c", 3, "nothing"), ("d", "a", 3, "refer to page 2")]]
    for step in steps:
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    target = str(tmp_path / "edges")
    edges.create(spark, target)
    stream = edges.kept_up(edges.changes(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1), target, str(tmp_path / "cp"), spans, counts)
    query = stream.trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    final = {(d, i): t for step in steps for d, i, _, t in step}
    sections = spark.createDataFrame([(d, i, t) for (d, i), t in final.items()], "doc string, id string, markdown string")
    empty = spark.createDataFrame([], edges.EDGES)
    got = sorted(map(tuple, stored.read(spark, target, empty.schema).collect()))
    assert got == sorted(map(tuple, refs.edges(sections, spans, counts).select(*empty.columns).collect())) and len(got) == 2


def test_fragments_are_put_together(spark, tmp_path):
    rows = [("c", 0, 1, "id1", "move", '{"a"'), ("c", None, 2, None, None, ":1"), ("c", 1, 3, "id2", "see", "x"), ("c", 0, 4, "", "", "}"), ("k", 0, 1, None, "n", None)]
    schema = "call string, index bigint, seq bigint, id string, name string, arguments string"
    want = {("c", 0): ("id1", "move", '{"a":1}', 3), ("c", 1): ("id2", "see", "x", 1), ("k", 0): ("", "n", "", 1)}
    batch = fragments.together(spark.createDataFrame(rows, schema))
    assert {(r["call"], r["index"]): (r["id"], r["name"], r["arguments"], r["fragments"]) for r in batch.collect()} == want
    at = F.timestamp_seconds(1_000_000 + F.col("seq"))
    for part in (rows[:2], rows[2:4], rows[4:]):
        spark.createDataFrame(part, schema).withColumn("at", at).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("new", 0, 9, "i", "n", "y")], schema).withColumn("at", F.timestamp_seconds(F.lit(9_000_000)))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = fragments.accumulated(spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("joined").outputMode("update").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    last, found = {}, spark.table("joined").collect()
    for r in sorted((r for r in found if not r["done"]), key=lambda r: r["fragments"]):
        last[r["call"], r["index"]] = (r["id"], r["name"], r["arguments"], r["fragments"])
    assert last == want | {("new", 0): ("i", "n", "y", 1)}
    assert sorted((r["call"], r["index"]) for r in found if r["done"]) == sorted(want)  # dropped once the time has passed


def stitched_by_hand(texts):
    row, sep, cols = (lambda x: x.strip().startswith("|") and x.strip().endswith("|") and len(x.strip()) > 1), (lambda x: set(x.strip()) <= set("|-: ")), (lambda x: len(x.strip().strip("|").split("|")))
    out = list(texts)
    for k in range(len(out) - 1):
        above, below = out[k].rstrip().splitlines(), out[k + 1].lstrip("\n").splitlines()
        i = len(above)
        while i and row(above[i - 1]):
            i -= 1
        j = 0
        while j < len(below) and row(below[j]):
            j += 1
        if i < len(above) and j and cols(above[i]) == cols(below[0]):
            out[k] = "\n".join(above + (below[2:j] if j >= 2 and sep(below[1]) else below[:j])).strip()
            out[k + 1] = "\n".join(below[j:]).strip()
    return out


def test_stitching_by_scans_is_stitching_page_by_page(spark, monkeypatch):
    monkeypatch.setattr(segments, "PAGES", 4)
    r = random.Random(11)
    pieces = ["|1|2|", "|1|2|\n|3|4|", "|h|k|\n|---|---|\n|5|6|", "|1|2|3|", "text\n|7|8|", "|7|8|\ntext", "text", "\n\n|9|9|\n", "|a|b|\nmid\n|c|d|", ""]
    docs = {f"d{k}": [r.choice(pieces if k % 2 else pieces[:3]) for _ in range(40)] for k in range(6)}
    pages = spark.createDataFrame([(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts, 1)], "doc string, page_no bigint, markdown string")
    got = {(x["doc"], x["page_no"]): x["markdown"] for x in clean.stitched(pages).collect()}
    for d, texts in docs.items():
        assert [got[d, i] for i in range(1, 41)] == stitched_by_hand(texts)


def test_refusals_and_scopes(spark):
    nodes = spark.createDataFrame([("d", "a", None, "A", 0)], "doc string, id string, parent string, title string, sort_order int")
    new = spark.createDataFrame([("d", "x", "a", " New ", None, "t"), ("d", "y", None, " ", None, None), ("d", "z", "a", "Z", None, "odd"), ("q", "w", None, "W", None, None)], "doc string, id string, parent string, title string, index int, section_type string")
    types = spark.createDataFrame([("t",)], "type_name string")
    assert {r["id"]: r["reason"] for r in tree.refused(nodes, new, types).collect()} == {"y": "blank title", "z": "unknown type", "w": "unknown document"}
    made = tree.create(nodes.withColumn("section_type", F.lit(None).cast("string")), new, types)
    assert {r["id"]: r["title"] for r in made.collect()} == {"a": "A", "x": "New"}
    attached = spark.createDataFrame([("s", 1, "project", "empty")], "session string, place int, kind string, name string")
    documents = spark.createDataFrame([("d", "p")], "doc string, project string")
    pages, sections = spark.createDataFrame([], "page string, doc string"), spark.createDataFrame([], "id string, doc string")
    assert editing.scopes(attached, documents, pages, sections).first()["project"] is None
    assert editing.scopes(attached, documents, pages, sections, spark.createDataFrame([("empty",)], "project string")).first()["project"] == "empty"


def test_stages_are_observed(spark, tmp_path):
    rows, seen = runs.measured(spark.range(10), "ten", str(tmp_path / "t"), rows=F.count("*"), most=F.max("id"))
    assert rows.count() == 10
    assert {(r["stage"], r["metric"], r["value"]) for r in runs.progress_report(spark, "r", [seen]).collect()} == {("ten", "rows", 10.0), ("ten", "most", 9.0)}


def test_what_is_written_on_the_way_is_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "shared_dir", lambda s: str(tmp_path))
    found = tree.nested_set(spark.createDataFrame(TREE, NODES))
    assert found.count() == 5 and len(list(tmp_path.iterdir())) == 1


def test_parse_documents_are_dealt_once(spark):
    """Lines and orders go to their runs; pages, documents and edges are made there, loaded once or twice."""
    for name in ("parse_graph", "parse_pages"):
        plan = publishing.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if " Exchange " in line]
        assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)


def _with_separators(text):
    lines, inside, out = text.split("\n"), False, []
    inner = []
    for x in lines:
        fence = x.strip().startswith(("```", "~~~"))
        inside ^= fence
        inner.append(inside or fence)
    row = [x.strip().startswith("|") and not i for x, i in zip(lines, inner)]
    for i, x in enumerate(lines):
        out.append(x)
        if row[i] and not (i and row[i - 1]) and i + 1 < len(lines) and row[i + 1] and "-" not in lines[i + 1]:
            out.append("|" + "---|" * x.count("|", 1))
    return "\n".join(out)


def test_sections_are_built_of_whole_pages(spark):
    """Sections of one page to all pages, over the ends of cells, with pages that are missing, blank or null, against pages cleaned one by one."""
    r = random.Random(11)
    parts = ["Running head", "*Foot*  line", "Page 3 of 9", "|prepared by x|approved by y|", "|---|", "|k|b|", "|1|2|", "```", "~~~", "", "Some words", "Ver: 3", *[f"Seldom {i}" for i in range(12)]]
    pages = [(d, p, r.choice([None, ""]) if p % 9 == 0 else "\n".join([f"own {p}", *r.choices(parts, k=r.randint(0, 9))])) for d, n in (("a", 300), ("b", 70), (None, 5)) for p in range(1, n + 1) if p % 31]
    held, n = [], {"a": 300, "b": 70, None: 5}
    for i in range(90):
        d = r.choice(["a", "a", "a", "b", None])
        first, width = r.randint(1, n[d]), r.choice([1, 2, 3, 7, 40, 63, 64, 65, 130, 400])
        held.append((d, f"s{i}", first, first + width - 1, 2 * i, 2 * i + 1))
    held += [("a", "at31", 31, 31, 200, 201), ("a", "none", 0, 3, 202, 203), ("a", "back", 9, 8, 204, 205), ("a", "null", None, None, 206, 207), ("a", "past", 301, 320, 208, 209), ("a", None, 1, 3, 210, 211), ("c", "far", 1, 3, 0, 1)]
    sections = spark.createDataFrame(held, "doc string, id string, page_start bigint, page_end bigint, lft bigint, rgt bigint")
    texts = spark.createDataFrame(pages, "doc string, page_no bigint, markdown string").repartition(5)
    covers = [(d, i, p) for d, i, a, b, *_ in held for q, p, _ in pages if None not in (d, i, a) and q == d and 0 < a <= p <= b]
    kept = clean.cleaned_spans(spark.createDataFrame(covers, "doc string, id string, page_no bigint"), texts).collect()
    want = {}
    for x in sorted(kept, key=lambda x: x["page_no"]):
        want.setdefault((x["doc"], x["id"]), []).append(x["markdown"])
    want = {k: _with_separators("\n\n".join(filter(None, v))) for k, v in want.items()}
    meets = {(d, i): sorted(j for e, j, c, f, *_ in held if e == d and j and j != i and 0 < (c or 0) <= f and a <= f and c <= b) for d, i, a, b, *_ in held if (d, i) in want}
    got = editing.rebuilt(sections, texts).collect()
    assert len(got) == len(want) > 60 and {(x["doc"], x["id"]): x["markdown"] for x in got} == want
    assert {(x["doc"], x["id"]): x["overlaps"] for x in got} == meets
    assert {b - a >= editing.CELL for d, i, a, b, *_ in held if (d, i) in want} == {True, False}
    assert any("|---|---|" in text for text in want.values())


def test_texts_of_sections_are_dealt_once(spark, tmp_path, monkeypatch):
    """Pages go to the cells of their sections; no text is written, and none is dealt again to be cleaned or repaired."""
    monkeypatch.setattr(segments, "shared_dir", lambda spark: str(tmp_path))
    r = random.Random(5)
    pages = spark.createDataFrame([("d", p, "".join(r.choices("abcdefgh \n|", k=5000))) for p in range(1, 201)], "doc string, page_no bigint, markdown string")
    sections = spark.createDataFrame([("d", f"s{a}", a, a + 3, a, a + 1) for a in range(1, 200, 2)], "doc string, id string, page_start bigint, page_end bigint, lft bigint, rgt bigint")
    found = editing.rebuilt(sections, pages)
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in line]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]
    assert found.count() == 100 and sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 100_000


def test_forms_that_recur_are_looked_up(spark):
    """Thousands of lines that recur on three pages go, whatever stands between them in order; those on two stay."""
    often, seldom = [f"line {i}" for i in range(0, 3000, 2)], [f"line {i}" for i in range(1, 3000, 2)]
    pages = spark.createDataFrame([("d", p, "\n".join(often + (seldom if p < 3 else ["end"]))) for p in (1, 2, 3)], "doc string, page_no bigint, markdown string")
    sections = spark.createDataFrame([("d", "s", 1, 3, 1, 2), ("d", "t", 1, 2, 3, 4)], "doc string, id string, page_start bigint, page_end bigint, lft bigint, rgt bigint")
    got = {x["id"]: x["markdown"] for x in editing.rebuilt(sections, pages).collect()}
    assert got == {"s": "\n\n".join(["\n".join(seldom)] * 2 + ["end"]), "t": "\n\n".join(["\n".join(often + seldom)] * 2)}
