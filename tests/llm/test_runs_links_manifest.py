"""Periodic runs, small-world graphs and the manifest against plain versions, with every odd case."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import manifest, periodic, queries, small_world
from tests import oracle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree string, runs string"


def docs(spark, *texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}" if i else None, len(t or ""), "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(5)
    long = " ".join(r.choice("alpha beta gamma delta".split()) + str(i % 97) for i in range(20_000)) + " x y" * 400
    texts = ["", None, "  \n\t", "one", "a b " * 9, "a " * 30, "the same text twice", "the same text twice", long, "ΑΣ İé\x1cx\x85y  z", "Upper CASE " * 8]
    repeated = docs(spark, "again", "again", first=3)
    none = spark.createDataFrame([(None, "x y x y x y x y x y x y x y", None, "s1", None, "x", "y", "z")], SCHEMA)
    return docs(spark, *texts).unionByName(repeated).unionByName(repeated).unionByName(none).cache()


def plain_runs(w):
    """Every maximal stretch of each period in turn; the least period of a stretch counts."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_runs_of_random_words():
    r, lists = random.Random(1), []
    for _ in range(1500):
        n, kinds = r.randint(0, 110), r.choice([1, 2, 3, 5, 20])
        w = [b"w%d" % r.randrange(kinds) for _ in range(n)]
        if n > 20 and r.random() < 0.6:
            s, p = r.randrange(n), r.randint(1, 15)
            for i in range(s + p, min(n, s + p * r.randint(2, 5) + r.randrange(p))):
                w[i] = w[i - p]
        lists.append(w)
    assert periodic.runs_of([periodic.hashes(w) for w in lists]) == [plain_runs(w) for w in lists]


def test_grammars_derive_their_words():
    """No pair of neighbours is left twice, the tree gives the words back, and its places are right."""
    r = random.Random(2)
    for _ in range(100):
        word = [r.randrange(3) for _ in range(r.randint(2, 80))]
        grammar, rest = periodic.re_pair(word, 3)
        expand = lambda x: [x] if x < 3 else expand(grammar.left[x - 3]) + expand(grammar.right[x - 3])
        assert sum(map(expand, rest), []) == word
        pairs = [(a, b) for a, b in zip(rest, rest[1:]) if a != b]
        assert len(pairs) == len(set(pairs))
        grammar, top = periodic.tree(word, 3)
        assert expand(top) == word
        for x, places in periodic.occurrences(grammar, top).items():
            assert all(word[i : i + grammar.sizes[x]] == expand(x) for i in places)


def test_run_digests(spark, odd):
    small = spark.read.parquet(f"{SF}/documents.parquet")
    for table in (odd, small):
        rows = {}
        for r in table.select("doc_id", "text").collect():
            words = (r["text"] or "").encode().split()
            h = zlib.crc32(str(r["doc_id"]).encode())
            if r["doc_id"] is not None and h % 10 == 0 and words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            runs = plain_runs(words) if len(words) < 3000 else None
            rows.setdefault(r["doc_id"], []).append((words, runs))
        got = periodic.digests(table).collect()
        assert len(got) == table.count()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for r in got:
            due = []
            for words, runs in rows[r["doc_id"]]:  # rows that repeat an id
                if runs is None:
                    due.append((r["n_runs"], *r[2:]) if r["n_runs"] >= 1 else None)
                    continue
                kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
                due.append((len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed.encode()), sha(b" ".join(kept))))
            assert tuple(r)[1:] in due
    assert periodic.digests(odd.limit(0)).count() == 0 and periodic.periodic_runs(odd).filter("doc_id = 5").first()["runs"][0]["period"] == 1


def plain_links(rows, least=0.95):
    """vec_id, n_links and component_id by comparing all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok)]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), component, component == rows[i][0]))
    return sorted(out, key=str)


def test_small_world_links(spark):
    """Groups of near and equal copies from two to ninety, chains, null, zero, empty and unsound vectors, other lengths, repeated and null ids."""
    r, rows = np.random.default_rng(4), []
    for size in (2, 3, 90, 40):
        centre = r.normal(size=16)
        rows += [(None, (centre + r.normal(size=16) * 0.05).tolist()) for _ in range(size)]
    turn = lambda a: [float(np.cos(a)), float(np.sin(a))] + [0.0] * 14
    rows += [(None, turn(0.3 * k)) for k in range(8)]  # cos 0.3 = 0.955: a chain
    rows += [(None, rows[0][1])] * 5 + [(None, r.normal(size=16).tolist()) for _ in range(150)]
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    rows += [(7, rows[50][1]), (None, rows[60][1]), (None, r.normal(size=16).tolist()), (900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] + [0.0] * 14), (904, [float("nan")] * 16), (905, [float("inf")] + [0.0] * 15), (906, [1.0, 0.0]), (907, [2.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("label", F.lit(1)).withColumn("node", F.lit("x"))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, small_world.near_duplicates(table).collect()), key=str) == plain_links(rows)
    assert small_world.near_duplicates(table.limit(0)).count() == 0
    wide = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    assert sorted(map(tuple, small_world.near_duplicates(wide).collect()), key=str) == plain_links(rows)


def test_beams_find_what_scans_find():
    """A graph over several insertions finds nearly all near ones of its own nodes, in groups far apart too."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(3000, 24)), *[r.normal(size=24) + r.normal(size=(n, 24)) * 0.04 for n in (2, 3, 5, 20, 300)]]).astype(np.float32)
    x = x[r.permutation(len(x))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = small_world.Graph(x)
    assert len(graph.counts) > 1
    for links, n in zip(graph.links, graph.counts):
        assert set(links[links >= 0].tolist()) == set(range(n))  # some link leads to every node
    shard = small_world.Shard(24, [(i, 1, v.tobytes(), [own[i].tobytes() for own, n in zip(graph.links, graph.counts) if i < n]) for i, v in enumerate(x)])
    found = {int(a): {int(b) for b in shard.nodes[p]} for a, p, _ in shard.answers(np.arange(len(x)), [v.tobytes() for v in x], 24, 32, 0.95)}
    near = x @ x.T >= 0.95
    want = {i: set(np.flatnonzero(near[i]).tolist()) - {i} for i in range(len(x))}
    assert sum(len(want[i] & found.get(i, set())) for i in want) >= 0.99 * sum(map(len, want.values()))
    assert all(found[i] <= want[i] | {j for j in found[i] if abs(float(x[i] @ x[j]) - 0.95) < 1e-4} for i in found)


def plain_manifest(rows):
    """All digests by recursion over lists; rows are (doc_id, source, lang, n_chars, text)."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(part, r)))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for nodes in levels[:-1]:
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            yield run[: i % 16], run[i % 16 + 1 :]
            i //= 16

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    trees = {}
    for source, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = climb([leaf(r) for r in own])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        for i, r in enumerate(by[source]):
            steps = [*path(trees[source], i), *path(top, k)]
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                changed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            d = leaf(changed)
            for before, after in steps:
                d = sha("".join([*before, d, *after]))
            out.append((r[0], leaf(r), trees[source][-1][0], top[-1][0], sha("".join(x for before, after in steps for x in [*before, *after])), d, d == top[-1][0]))
    return sorted(out, key=str)


def test_manifest(spark, odd):
    """Sources of one, few, sixteen, seventeen and six hundred rows, in several blocks; null and empty sources; null and repeated ids."""
    rows = [(i, s, "en", 3, f"Text {i} of {s}") for s, n in (("a", 1), ("b", 16), ("c", 17), ("", 3), (None, 2), ("ü", 257), ("z", 600)) for i in range(n)]
    many = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string").repartition(5)
    for table in (odd, many):
        own = [tuple(r) for r in table.select("doc_id", "source", "lang", "n_chars", "text").collect()]
        got = manifest.manifest(table)
        assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(own)
    assert manifest.manifest(odd.limit(0)).count() == 0 and manifest.manifest(odd.limit(1)).count() == 1


def test_witnesses_lead_to_the_root(spark):
    small = spark.read.parquet(f"{SF}/documents.parquet")
    for r in manifest.witnesses(small).collect():
        steps = [(s["at"], bytes(s["siblings"])) for s in r["witness"]]
        assert manifest.folded(bytes(r["leaf"]), steps) == bytes(r["root"])
        assert manifest.folded(hashlib.sha256(b"other").digest(), steps) != bytes(r["root"])


def test_witnesses_grow_as_siblings_complete():
    a = manifest.Appender()
    first = a.append(b"\0" * 32)
    assert first == []
    for i in range(1, 16):
        a.append(bytes([i]) * 32)
    assert len(first) == 1 and first[0][0] == 0 and len(first[0][1]) == 15 * 32
    for i in range(16, 40):
        a.append(bytes([i]) * 32)
    assert len(first) == 1
    assert manifest.folded(b"\0" * 32, first) != a.close() and len(first) == 2


@pytest.mark.parametrize("name", ["op12_small_world", "op13_manifest"])
def test_queries_match_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = oracle.connect(SF).execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and oracle.rows(got) == oracle.rows(want)
