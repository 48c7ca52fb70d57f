"""N-gram Jaccard join: prefix-tree join over globally ordered sets of word n-grams.

1. A document's set holds the hashes of its distinct n-grams. Equal sets form a class, which is one node.
2. A set of which too many n-grams occur in no other class can reach no link and is done. Occurrences are
   counted over all documents for a fixed quarter of all n-grams, which is enough to see it.
3. The sets left follow one global order: rare n-grams first by hash, frequent ones last. Two sets that link
   share an n-gram among their first |x| - ceil(t|x|) + 1, so sets meet under those n-grams.
4. Sets that meet form a trie. A walk carries the overlap of the path with every other set at once; subtrees
   share it, and are pruned where even all remaining n-grams could not reach the overlap that a link needs.
5. Large groups of copies are joined first: each set walks once, in the largest meeting it has, within a
   block of bounded size; then one set per block and component meets the others'. This is linear.
6. What links across components is then found exactly. In each meeting of several components, all sets
   but those of its largest component walk against all sets, first by an eighth of their n-grams, and
   whoever might link to any of another component after that by whole sets. Both sides are cut into blocks of bounded size.

Every cell of work holds at most two blocks and passes through a task as a stream of rows in cell order, so memory is
bounded by BLOCK (and by the longest single set) whatever the size of a group. Components are joined by
hooking and pointer jumping, in rounds that grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_ROWS, partitions, settle, sized_join, tidied

#: N-grams whose hash is below this (a quarter of all) are counted to find sets that can have no link.
COUNTED = 1 << 62
#: Most frequent n-grams that the order puts last (512 KB), and times one must occur. They change the cost, never the links.
FREQUENT_KEPT, FREQUENT = 65_536, 8
#: N-grams of a block at most (or one longer set), and what a set weighs beside them, which bounds the sets of a block.
BLOCK, SET_WEIGHT = 65_536, 64
#: Sizes of sets fall into steps of this factor; meetings are parted where no size is near enough for a link.
SIZE_STEP = 1.02
#: Links that a task turns into a forest at a time (16 MB).
LINKS = 1_000_000
#: Rows per batch that leaves a task.
ROWS = 1024


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams, A-Z lower-cased.

    With fewer words the whole sequence counts as one n-gram; without words the set is empty.
    """
    words = (text or "").encode().lower().split()  # bytes split at the blank and \\x09-\\x0d alone
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1 + len(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[i : len(h) - n + 1 + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _lists(batches: Iterator[pd.DataFrame], of) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for at in range(0, len(whole), ROWS):
            yield of(whole.iloc[at : at + ROWS])


def row_key(docs: DataFrame) -> Column:
    """A hash of doc_id and text, nulls told apart."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), "text")


def _key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row, size and class key of each document's set, and its counted n-grams."""

    def of(batch: pd.DataFrame) -> pd.DataFrame:
        sets = [ngram_set(t, n) for t in batch["text"]]
        low = [s[: np.searchsorted(s, np.uint64(COUNTED))].view(np.int64) for s in sets]
        return pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "row": batch["row"], "size": list(map(len, sets)), "key": list(map(_key, sets)), "low": low})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _lists(batches, of)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), "text").mapInPandas(run, "doc_id bigint, row bigint, size bigint, key binary, low array<bigint>")


def representatives(sets: DataFrame) -> DataFrame:
    """node, key, size, doc_id, row and at (its place in sets) of the first row of each class: least doc_id, null last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at", "size")).alias("r")
    reps = sets.filter("size > 0").groupBy("key").agg(first)
    return settle(reps.select(F.monotonically_increasing_id().alias("node"), "key", "r.doc_id", "r.row", "r.at", "r.size"), "classes", narrow=True)


def open_sets(docs: DataFrame, sets: DataFrame, reps: DataFrame, n: int, percent: int) -> DataFrame:
    """node, size, grams (the whole set) and low (the leading halves of half its counted part) of the classes that may have a link."""
    counted = sized_join(sets.select("at", "low"), reps.select("at", "node"), "at", "inner").select("node", F.explode("low").alias("gram"))
    counted = counted.groupBy("gram").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    lone = settle(counted.filter("n = 1").groupBy("node").agg(F.count("*").alias("lone")), "lone", narrow=True)
    may = F.col("size") - F.coalesce(F.col("lone"), F.lit(0)) >= F.ceil(F.col("size") * percent / 100)
    wanted = settle(sized_join(reps.select("node", "size", "row", "key"), lone, "node", "left").filter(may).select("node", "row", "key"), "wanted", narrow=True)

    def of(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("node")
        sets = [ngram_set(t, n) for t in b["text"]]
        own = [_key(s) == k for s, k in zip(sets, b["key"])]
        b, sets = b[own], [s for s, o in zip(sets, own) if o]
        low = [np.unique(s[: np.searchsorted(s, np.uint64(COUNTED // 2))] >> np.uint64(29)).astype(np.uint32).tobytes() for s in sets]
        return pd.DataFrame({"node": b["node"], "size": list(map(len, sets)), "grams": [s.tobytes() for s in sets], "low": low})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _lists(batches, of)

    texts = sized_join(docs.select(row_key(docs).alias("row"), "text"), wanted, "row", "inner").select("node", "key", "text")
    return settle(texts.mapInPandas(run, "node bigint, size bigint, grams binary, low binary"), "open_sets")


def frequent(sets: DataFrame) -> np.ndarray:
    """N-grams that many of the sets hold, the least frequent first; at most FREQUENT_KEPT.

    Only the counted quarter is looked at: prefixes, which start with the least hashes, hardly reach beyond it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _lists(batches, lambda b: pd.DataFrame({"gram": (g := np.frombuffer(b"".join(b["grams"]), np.uint64))[g < COUNTED].view(np.int64)}))

    counts = sets.select("grams").mapInPandas(run, "gram bigint").groupBy("gram").count().filter(F.col("count") >= FREQUENT)
    rows = counts.orderBy(F.desc("count"), "gram").limit(FREQUENT_KEPT).collect()
    return np.array([r["gram"] for r in reversed(rows)], np.int64).view(np.uint64)


def prefixes(sets: DataFrame, percent: int, late: np.ndarray) -> DataFrame:
    """node, size, gram: the first n-grams of each set in the global order."""
    by_value = np.argsort(late)
    shared = sets.sparkSession.sparkContext.broadcast((late[by_value], by_value))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, rank = shared.value

        def of(batch: pd.DataFrame) -> pd.DataFrame:
            first = []
            for grams in batch["grams"]:
                s = np.frombuffer(grams, np.uint64)
                keep = len(s) - (percent * len(s) + 99) // 100 + 1
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    is_late = values[at] == s
                    s = np.concatenate([s[~is_late], s[is_late][np.argsort(rank[at[is_late]])]])
                first.append(s[:keep].view(np.int64))
            return pd.DataFrame({"node": batch["node"], "size": batch["size"], "first": first})

        yield from _lists(batches, of)

    return sets.select("node", "size", "grams").mapInPandas(run, "node bigint, size bigint, first array<bigint>").select("node", "size", F.explode("first").alias("gram"))


def size_step() -> Column:
    return F.floor(F.log(F.col("size").cast("double")) / math.log(SIZE_STEP)).cast("int")


def steps_apart(percent: int) -> int:
    """Steps between the sizes of two sets that link, at most."""
    return math.ceil(math.log(100 / percent) / math.log(SIZE_STEP)) + 1


def meetings(sets: DataFrame, percent: int) -> DataFrame:
    """node, size, cell, n and weight: the sets that meet under each n-gram, n-grams with the very same sets once.

    An n-gram's sets are parted where sizes leave a gap that no link spans. The gaps are seen in the sizes'
    steps, counted per n-gram before they are put in order, so a frequent n-gram is no burden of one task.
    """
    starts = settle(prefixes(sets, percent, frequent(sets)), "starts")
    met = settle(starts.groupBy("gram").count().filter("count > 1").select("gram"), "met", narrow=True)  # one number a row
    members = settle(sized_join(starts, met, "gram", "left_semi", most=4 * BROADCAST_ROWS).withColumn("step", size_step()), "members", narrow=True)
    order, apart = Window.partitionBy("gram").orderBy("step"), steps_apart(percent)
    steps = members.groupBy("gram", "step").agg(F.count("*").alias("n"))
    gaps = F.coalesce((F.col("step") - F.lag("step").over(order) > apart).cast("int"), F.lit(0))
    parts = steps.withColumn("gap", gaps).withColumn("part", F.sum("gap").over(order))
    parts = parts.withColumn("all", F.sum("n").over(Window.partitionBy("gram", "part"))).filter("all > 1")
    parts = settle(parts.select("gram", "step", F.xxhash64("gram", "part").alias("cell")), "parts", narrow=True)
    members = settle(sized_join(members, parts, ["gram", "step"], "inner").select("cell", "node", "size"), "parted", narrow=True)
    mark = F.xxhash64("node")
    groups = members.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.sum(mark.cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("h2"))
    groups = settle(groups.groupBy("n", "weight", "h1", "h2").agg(F.min("cell").alias("cell")).select("cell", "n", "weight"), "meetings", narrow=True)
    return settle(sized_join(members, groups, "cell", "inner"), "held", narrow=True)


class Side:
    """Sets of one side of a cell: node, size of the whole set, label of the component, and the n-grams that are looked at."""

    def __init__(self, node: np.ndarray, size: np.ndarray, label: np.ndarray, grams: list[np.ndarray]):
        self.node, self.size, self.label, self.grams = node, size, label.copy(), grams
        self.given = np.array([len(g) for g in grams], np.int64)
        self.rest = size - self.given


def trie_links(left: Side, right: Side, percent: int, all_ends: bool = False) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between nodes of left and right that have different labels, as many as join what links; and, if asked for, all their ends.

    Left's sets form the trie; the walk counts their paths' overlaps with all of right's. Where only parts of
    the sets are given, pairs count as linked if they might be. Links that join nothing new are passed over (their
    ends are not, if all ends are asked for).
    """
    m, count = len(right.grams), len(left.grams)
    gram_r, owner = np.concatenate(right.grams), np.repeat(np.arange(m), right.given)
    values, token, times = np.unique(gram_r, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((np.arange(len(values)), -times))] = np.arange(len(values))
    by_token = np.argsort(rank[token], kind="stable")
    holders, starts = owner[by_token], np.concatenate([[0], np.cumsum(np.sort(times)[::-1])])
    path = []
    for g in left.grams:
        at = np.minimum(np.searchsorted(values, g), max(len(values) - 1, 0))
        path.append(np.sort(rank[at[values[at] == g]]) if len(values) else np.zeros(0, np.int64))
    order = sorted(range(count), key=lambda i: path[i].astype(">i8").tobytes())
    length = np.array([len(path[i]) for i in order])
    same = np.zeros(count, np.int64)  # n-grams that a path shares with the one before it
    for k in range(1, count):
        a, b = path[order[k - 1]], path[order[k]]
        c = min(len(a), len(b))
        d = np.flatnonzero(a[:c] != b[:c])
        same[k] = d[0] if len(d) else c
    sizes, rests, labels = left.size[order], left.rest[order], left.label[order]
    joined, joined_right = (labels.copy(), right.label.copy()) if all_ends else (labels, right.label)
    ends, ends_right = np.zeros(count, bool), np.zeros(m, bool)
    pairs, todo = [], [(0, count, 0, np.zeros(m, np.int64))]
    while todo:
        lo, hi, depth, overlap = todo.pop()
        end = same[lo + 1 : hi].min() if hi - lo > 1 else length[lo]
        steps = path[order[lo]][depth:end]
        if len(steps):
            overlap = overlap + np.bincount(np.concatenate([holders[starts[t] : starts[t + 1]] for t in steps]), minlength=m)
        need = (percent * (sizes[lo:hi].min() + right.size) + 99 + percent) // (100 + percent)
        reach = overlap + (length[lo:hi].max() - end) + np.minimum(rests[lo:hi].max(), right.rest) >= need
        if (labels[lo:hi] == labels[lo]).all():
            reach &= right.label != labels[lo]
        if not reach.any():
            continue
        at = lo
        while at < hi and length[at] == end:  # sets that end here
            found = reach & (right.label != labels[at]) & ((100 + percent) * (overlap + np.minimum(rests[at], right.rest)) >= percent * (sizes[at] + right.size))
            ends[at] = found.any()
            ends_right |= found
            hit = np.flatnonzero(found & (joined_right != joined[at]))
            for j in hit[np.unique(joined_right[hit], return_index=True)[1]]:
                now, before = joined[at], joined_right[j]
                pairs.append((left.node[order[at]], right.node[j]))
                joined[joined == before], joined_right[joined_right == before] = now, now
            at += 1
        if at < hi:
            heads = [at, *(k for k in range(at + 1, hi) if same[k] == end), hi]
            todo += [(a, b, int(end), overlap) for a, b in zip(heads, heads[1:])]
    return pairs, np.concatenate([left.node[np.array(order, np.int64)[ends]], right.node[ends_right]]) if all_ends else np.zeros(0, np.int64)


def compared(cells: DataFrame, keys: list[str], percent: int, kind: type, all_ends: bool = False) -> DataFrame:
    """Links a, b within each cell: rows of keys, node, size, label, side (0 walks, 1 is met, 2 both) and grams, numbers of the given kind.

    If asked for, all ends of links are given too, as links of a node to itself.
    """

    def links(rows: list[tuple]) -> list[np.ndarray]:
        node, size, label, side, grams = zip(*rows)
        node, size, label, side = (np.array(x, np.int64) for x in (node, size, label, side))
        if len(rows) < 2 or (label == label[0]).all():
            return []
        grams = [np.frombuffer(g, kind) for g in grams]
        left, right = (Side(node[at], size[at], label[at], [g for g, here in zip(grams, at) if here]) for at in (side != 1, side != 0))
        if not left.grams or not right.grams:
            return []
        pairs, ends = trie_links(left, right, percent, all_ends)
        return [np.array(pairs, np.int64).reshape(-1, 2), np.column_stack([ends, ends])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, found = None, [], []
        for batch in batches:
            for at, *row in zip(zip(*(batch[k].to_numpy() for k in keys)), batch["node"], batch["size"], batch["label"], batch["side"], batch["grams"]):
                if at != now:
                    found += links(rows) if rows else []
                    now, rows = at, []
                rows.append(row)
            if found:
                yield pd.DataFrame(np.concatenate(found), columns=["a", "b"])
                found = []
        found = links(rows) if rows else []
        if found:
            yield pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    p = partitions(cells.sparkSession)
    dealt = cells.select(*keys, "node", "size", "label", "side", "grams").repartition(p, *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "a bigint, b bigint")


def blocks_of(weight: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(weight / BLOCK)).cast("int")


def block_at(weight: Column) -> Column:
    """Block in which a place in the sum of weights lies."""
    return F.floor(weight / BLOCK).cast("int")


def dealt_to(n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")


def within(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between rows (cell, block, node) of the same cell and block."""
    cells = sized_join(sets.select("node", "size", "grams"), rows.select("cell", "block", "node"), "node", "inner").withColumns({"label": F.col("node"), "side": F.lit(2)})
    return compared(cells, ["cell", "block"], percent, np.uint64)


def across(rows: DataFrame, sets: DataFrame, percent: int, kind: type, share: int, all_ends: bool = False) -> DataFrame:
    """Links a, b between rows (cell, node, size, label) of the same cell that have different labels.

    sets hold node, size and grams, which are a share-th of the whole sets. All rows but those of the cell's
    heaviest label walk, dealt to slices; all rows are met, dealt to blocks. Both are dealt in the order of sizes, by
    the weight of each size's step, so a slice meets only the blocks whose sizes are near enough for a link.
    """
    weight = F.col("size") / share + SET_WEIGHT
    per_label = rows.groupBy("cell", "label").agg(F.sum(weight).alias("w"))
    per_cell = per_label.groupBy("cell").agg(F.max(F.struct("w", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    per_cell = settle(per_cell.select("cell", F.col("top.label").alias("top")), "cells", narrow=True)
    rows = sized_join(rows.select("cell", "node", "size", "label"), per_cell, "cell", "inner")
    rows = settle(rows.select("cell", "node", "size", "label", size_step().alias("step"), (F.col("label") != F.col("top")).alias("walks")), "apart", narrow=True)
    # where each step's weight begins and ends in its cell, and what the steps within reach of it span
    steps = rows.groupBy("cell", "step").agg(F.sum(weight).alias("all"), F.sum(F.when(F.col("walks"), weight).otherwise(0.0)).alias("some"))
    order, reach = Window.partitionBy("cell").orderBy("step"), steps_apart(percent)
    up_to, near = order.rowsBetween(Window.unboundedPreceding, 0), order.rangeBetween(-reach, reach)
    steps = steps.withColumns({"all_to": F.sum("all").over(up_to), "some_to": F.sum("some").over(up_to)})
    walked = F.col("some") > 0
    steps = steps.select(
        "cell", "step", "all", "some", (F.col("all_to") - F.col("all")).alias("all_from"), (F.col("some_to") - F.col("some")).alias("some_from"),
        block_at(F.min(F.col("all_to") - F.col("all")).over(near)).alias("first_block"), block_at(F.max("all_to").over(near)).alias("last_block"),
        block_at(F.min(F.when(walked, F.col("some_to") - F.col("some"))).over(near)).alias("first_slice"), block_at(F.max(F.when(walked, F.col("some_to"))).over(near)).alias("last_slice"),
    )
    rows = sized_join(rows, settle(steps, "steps", narrow=True), ["cell", "step"], "inner")
    share_of = lambda seed: dealt_to(F.lit(1 << 20), seed) / float(1 << 20)
    met = rows.filter("first_slice is not null").select("cell", "node", "label", F.lit(1).alias("side"), F.explode(F.sequence("first_slice", "last_slice")).alias("slice"), block_at(F.col("all_from") + share_of(3) * F.col("all")).alias("block"))
    walking = rows.filter("walks").select("cell", "node", "label", F.lit(0).alias("side"), block_at(F.col("some_from") + share_of(5) * F.col("some")).alias("slice"), F.explode(F.sequence("first_block", "last_block")).alias("block"))
    dealt = settle(met.unionByName(walking), "dealt", narrow=True)
    return compared(sized_join(sets, dealt, "node", "inner"), ["cell", "slice", "block"], percent, kind, all_ends)


def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with label: the component of node, or node itself."""
    return sized_join(rows, found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """node, component of all nodes that have a link to a lesser one (sets is the result of open_sets)."""
    held = meetings(sets, percent)
    # each set once, in its largest meeting
    home = held.groupBy("node", "size").agg(F.max(F.struct("n", "weight", "cell")).alias("home"))
    blocks = blocks_of(F.col("home.weight") + SET_WEIGHT * F.col("home.n"))
    home = settle(home.select("node", "size", "home.cell", blocks.alias("blocks"), dealt_to(blocks, 3).alias("block")), "home", narrow=True)
    found = components(within(home, sets, percent))
    # one set of each block's components; they too are dealt to blocks
    leaders = labelled(home.filter("blocks > 1"), found).groupBy("cell", "block", "label").agg(F.min_by(F.struct("node", "size"), "node").alias("s")).select("cell", "s.node", "s.size")
    leaders = settle(leaders, "leaders", narrow=True)
    if not leaders.isEmpty():
        weights = leaders.groupBy("cell").agg(F.sum(F.col("size") + SET_WEIGHT).alias("weight"))
        led = settle(leaders.join(weights, "cell").select("cell", "node", dealt_to(blocks_of(F.col("weight")), 7).alias("block")), "led", narrow=True)
        found = components(within(led, sets, percent), found)
    # exactly, across components: by an eighth of the sets, then whoever might link by whole ones
    might = settle(across(labelled(held.select("cell", "node", "size"), found), sets.select("node", "size", F.col("low").alias("grams")), percent, np.uint32, 16, all_ends=True), "might")
    closer = components(might.filter("a <> b"), found)
    ends = settle(might.filter("a = b").select(F.col("a").alias("node")).distinct(), "ends", narrow=True)
    rows = labelled(labelled(sized_join(sets.select("node", "size"), ends, "node", "left_semi"), found).withColumnRenamed("label", "own"), closer)
    rows = settle(rows.select(F.col("label").alias("cell"), "node", "size", F.col("own").alias("label")), "closer", narrow=True)
    return components(across(rows, sets.select("node", "size", "grams"), percent, np.uint64, 1), found)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the least node of each component to each of its others, instead of links a, b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not (up[up] == up).all():
            up = up[up]
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    below = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[up[below]], nodes[below]


def contracted(links: DataFrame) -> DataFrame:
    """Links a < b that join what links join, fewer of them: each task takes up to LINKS at a time and keeps a forest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.to_numpy())
            n += len(batch)
            if n >= LINKS:
                yield pd.DataFrame(dict(zip("ab", forest(*np.concatenate(held).T))))
                held, n = [], 0
        if n:
            yield pd.DataFrame(dict(zip("ab", forest(*np.concatenate(held).T))))

    few = max(1, partitions(links.sparkSession) // 64)
    return settle(links.select("a", "b").coalesce(few).mapInPandas(run, "a bigint, b bigint"), "links")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, component (the least node that links reach) for every node with a link to a lesser one; known are such rows that hold already.

    Each round tasks replace their links by forests, every node points to its least lesser neighbour, pointers
    jump until they end at a node that has none, and links move to these ends. A chain of any length is one
    round of as many jumps as its length has bits. Links and pointers stay distributed; each step is a written table.
    """
    links = settle(links, "found")
    if known is not None:  # links between the ends of known pointers
        for end in ("a", "b"):
            links = sized_join(links.withColumnRenamed(end, "node"), known, "node", "left").withColumn(end, F.coalesce("component", "node")).drop("node", "component")
    labels, edges = known, contracted(links)
    while not edges.isEmpty():
        to = settle(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "to", narrow=True)
        while True:
            jumped = sized_join(to, to.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
            jumped = settle(jumped.select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "to", narrow=True)
            if jumped.filter("moved").isEmpty():
                break
            to = jumped.select("node", "to")
        new = to.select("node", F.col("to").alias("component"))
        if labels is not None:
            old = sized_join(labels, to.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            new = settle(old.unionByName(new), "labels", narrow=True)
        labels = new
        for end in ("a", "b"):
            edges = sized_join(edges, to.select(F.col("node").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = contracted(edges.filter("a <> b"))
    return labels if labels is not None else edges.selectExpr("a as node", "b as component")


@tidied
def grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, row, size, component and component_id of every row of docs; no component where the set is empty."""
    sets = settle(classes(docs, n).withColumn("at", F.monotonically_increasing_id()), "ngram_classes")
    reps = representatives(sets)
    found = links(open_sets(docs, sets, reps, n, percent), percent)
    nodes = settle(labelled(reps.select("node", "key", "doc_id"), found), "class_nodes", narrow=True)
    least = settle(nodes.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least_ids", narrow=True)
    nodes = settle(sized_join(nodes, least, "label", "inner").select("key", F.col("label").alias("component"), "component_id"), "class_components", narrow=True)
    return sized_join(sets.select("doc_id", "row", "size", "key"), nodes, "key", "left").drop("key")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs.

    Rows link when percent * |union| <= 100 * |intersection| of their n-gram sets. A null text or one without
    words has an empty set and links with nothing: its component_id is its own. Every row is compared by
    itself: rows that repeat a doc_id with other texts may lie in different components, and a row without a
    doc_id is linked like any other; a component of which no row has one has none. An empty table gives an
    empty result; columns other than doc_id and text are ignored.
    """
    return grouped(docs, n, percent).select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


@tidied
def one_per_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (null last; ties by a hash of the text).

    Of equal rows one stays. Rows without words link with nothing and all stay.
    """
    rows = grouped(docs, n, percent).filter("component is not null").groupBy("component", "doc_id", "row").agg(F.count("*").alias("times"))
    rows = settle(rows, "groups", narrow=True)
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "times")).alias("best"))
    id_ = F.coalesce(F.col("doc_id"), F.lit(0)).alias("__id")  # the row's hash tells null from 0
    best = settle(best.select(F.coalesce("best.doc_id", F.lit(0)).alias("__id"), F.col("best.row").alias("__row"), "best.times"), "best", narrow=True)
    gone = settle(rows.select(id_, F.col("row").alias("__row")).join(best.select("__id", "__row"), ["__id", "__row"], "left_anti"), "gone", narrow=True)
    marked = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__row": row_key(docs)})
    kept, repeated = sized_join(marked, gone, ["__id", "__row"], "left_anti"), best.filter("times > 1").drop("times")
    if not repeated.isEmpty():
        once = sized_join(kept, repeated, ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"])
        kept = sized_join(kept, repeated, ["__id", "__row"], "left_anti").unionByName(once)
    return kept.select(*docs.columns)
