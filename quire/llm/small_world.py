"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

1. Equal vectors form a class, which is one node. Nodes are dealt to shards of bounded size by hash.
2. Each shard builds its graph: nodes have levels, one in FAN of a level's nodes is in the next one too; a node links to
   near nodes of its level that are not nearer to one another, so links lead out of dense groups as well.
3. Every node queries every shard: greedily from the top level down, then with a beam on the lowest. A query of whose beam
   half are links widens it, up to a scan of the shard, so a group of any size is found whole.
4. Found pairs are verified by their cosine in double precision.
5. Recall is audited: a sample of nodes is compared with all others; unless enough of their links are found, all beams
   are widened and the graphs queried again, at last by scans, which find everything.
6. Components are the union of links. A dense group's links are counted where they are found and joined up by a
   forest; its pairs are never written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import partitions, settle, sized_join, tidied
from quire.llm.ngrams import components, forest

#: Nodes of a shard at most (about), and shards at least.
SHARD_ROWS, SHARDS = 65_536, 4
#: One in how many nodes of a level is in the next one; links of a node; candidates looked at to choose them; nodes inserted together.
FAN, LINKS, REACH, INSERTED = 16, 24, 48, 512
#: First beam of a query, nodes expanded in one step, and queries that go through a graph side by side.
BEAM, EXPANDED, BESIDE = 32, 3, 512
#: Nodes compared with all others, and the share of their links that must be found.
AUDITED, RECALL = 1024, 0.99
#: Single precision is this far off at most; pairs nearer to the limit are looked at in double precision.
SLACK = 1e-4
#: Rows per batch that leaves a task.
ROWS = 1024


def classes(vectors: DataFrame) -> DataFrame:
    """at, vec_id, dim, key (equal for equal vectors, null for those that link with nothing) and v, the components in their own precision."""
    kind = "f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "f4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [None if e is None else np.asarray(e, dtype=kind) for e in batch["embedding"]]  # null components become NaN
            own = [None if e is None or not len(e) or not np.isfinite(e).all() or not e.any() else e + e.dtype.type(0) for e in own]
            yield pd.DataFrame({
                "at": batch["at"], "vec_id": batch["vec_id"], "dim": [0 if e is None else len(e) for e in own],
                "key": [None if e is None else hashlib.blake2b(e.tobytes(), digest_size=16).digest() for e in own], "v": [None if e is None else e.tobytes() for e in own],
            })

    element = "double" if kind == "f8" else "float"
    rows = vectors.select(F.monotonically_increasing_id().alias("at"), F.col("vec_id").cast("string").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    read = rows.mapInPandas(run, "at bigint, vec_id string, dim int, key binary, v binary")
    return settle(read.withColumn("vec_id", F.col("vec_id").cast("bigint")), "vectors")


def units(rows: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a dimension from their bytes: in double precision, divided by their largest component, and of length 1 in single precision."""
    data = np.frombuffer(b"".join(rows), "f8" if rows and len(rows[0]) == 8 * dim else "f4").reshape(-1, dim).astype(np.float64)
    exact = data / np.abs(data).max(1, keepdims=True)
    return exact, (exact / np.linalg.norm(exact, axis=1, keepdims=True)).astype(np.float32)


def linked(left: np.ndarray, right: np.ndarray, near: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows link: near, their cosine in single precision, tells but for those next to the limit."""
    out = near >= least
    close = np.abs(near - least) <= SLACK
    if close.any():
        a, b = left[close], right[close]
        out[close] = (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)) >= least
    return out


def top(near: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row, greatest first."""
    k = min(k, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape).copy()
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(near, at, 1), axis=1, kind="stable"), 1)


class Graph:
    """The graph over unit vectors x. The nodes of level k are the first counts[k] places; links[k] has a row of places for each, -1 where there are fewer."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray] | None = None) -> None:
        self.x = x
        self.counts = [len(x)]
        while self.counts[-1] > INSERTED:
            self.counts.append(-(-self.counts[-1] // FAN))
        self.links = links if links is not None else [np.full((n, LINKS), -1, np.int32) for n in self.counts]
        if links is None:
            for level in range(len(self.counts) - 1, -1, -1):
                self._build(level)

    def _build(self, level: int) -> None:
        n, links, done = self.counts[level], self.links[level], 0
        while done < n:
            end = min(n, done + INSERTED)
            batch = self.x[done:end]
            near = batch @ batch.T
            np.fill_diagonal(near, -np.inf)
            at = top(near, REACH)
            ids, near = at + done, np.take_along_axis(near, at, 1)
            if done:
                old, old_near = self.search(batch, REACH, level, done)
                ids, near = np.concatenate([old, ids], 1), np.concatenate([old_near, near], 1)
                at = top(near, REACH)
                ids, near = np.take_along_axis(ids, at, 1), np.take_along_axis(near, at, 1)
            chosen = self._apart(ids, near)
            links[done:end, : chosen.shape[1]] = chosen
            self._back(level, np.repeat(np.arange(done, end), chosen.shape[1]), chosen.ravel())
            done = end
        self._reached(links)

    @staticmethod
    def _reached(links: np.ndarray) -> None:
        """Gives every node that no link leads to one from its nearest neighbour, in place of the last one there whose end has others."""
        reached = np.bincount(links[links >= 0], minlength=len(links))
        for node in np.flatnonzero(reached == 0).tolist():
            for near in links[node][links[node] >= 0].tolist():
                free = [k for k in range(LINKS - 1, -1, -1) if links[near, k] < 0 or reached[links[near, k]] > 1]
                if free:
                    if links[near, free[0]] >= 0:
                        reached[links[near, free[0]]] -= 1
                    links[near, free[0]] = node
                    reached[node] = 1
                    break

    def _apart(self, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of each row's candidates (nearest first) up to LINKS that are nearer to the node than to any chosen before, then the nearest others."""
        rows, width = ids.shape
        vectors = self.x[np.maximum(ids, 0)]
        valid = near > -np.inf
        most = np.full((rows, width), -np.inf, np.float32)  # nearness to the chosen ones
        chosen, taken = np.zeros((rows, width), bool), np.zeros(rows, int)
        for k in range(width):
            take = valid[:, k] & (near[:, k] > most[:, k]) & (taken < LINKS)
            if take.any():
                chosen[take, k] = True
                taken += take
                if k + 1 < width:
                    most[take, k + 1 :] = np.maximum(most[take, k + 1 :], np.einsum("rcd,rd->rc", vectors[take, k + 1 :], vectors[take, k]))
        rank = np.where(chosen, np.arange(width), np.where(valid, width + np.arange(width), 3 * width))
        order = np.argsort(rank, axis=1, kind="stable")[:, :LINKS]
        return np.where(np.take_along_axis(rank, order, 1) < 3 * width, np.take_along_axis(ids, order, 1), -1).astype(np.int32)

    def _back(self, level: int, source: np.ndarray, target: np.ndarray) -> None:
        """Adds links back to source; a node with too many chooses among them anew."""
        links = self.links[level]
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), INSERTED):
            own, starts, n = nodes[lo : lo + INSERTED], first[lo : lo + INSERTED], np.minimum(counts[lo : lo + INSERTED], REACH)
            new = np.full((len(own), int(n.max())), -1, np.int64)
            for k in range(new.shape[1]):
                new[n > k, k] = source[starts[n > k] + k]
            ids = np.concatenate([links[own], new], 1)
            ids[repeated(ids)] = -1
            near = np.einsum("rcd,rd->rc", self.x[np.maximum(ids, 0)], self.x[own])
            near[ids < 0] = -np.inf
            at = top(near, ids.shape[1])
            links[own] = self._padded(self._apart(np.take_along_axis(ids, at, 1), np.take_along_axis(near, at, 1)))

    @staticmethod
    def _padded(rows: np.ndarray) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, LINKS - rows.shape[1])), constant_values=-1)

    def search(self, queries: np.ndarray, beam: int, level: int = 0, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest nodes found for each query on a level, nearest first: places and cosines (-inf where there are fewer).

        known: nodes of the level that are linked so far. The levels above are walked first, greedily.
        """
        known = self.counts[level] if known is None else known
        top_level = len(self.counts) - 1
        entries = np.zeros((len(queries), 1), np.int64)
        if top_level > level or known > INSERTED:
            start = self.x[: min(self.counts[top_level], known)] @ queries.T
            entries = top(start.T, 4)
            for above in range(top_level - 1, level, -1):
                entries = self._walk(queries, entries, 4, above, self.counts[above])[0]
        elif known:
            near = queries @ self.x[:known].T
            at = top(near, beam)
            return at, np.take_along_axis(near, at, 1)
        entries = np.where(entries < known, entries, 0)
        return self._walk(queries, entries, beam, level, known)

    def _walk(self, queries: np.ndarray, entries: np.ndarray, beam: int, level: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        rows, links = len(queries), self.links[level]
        entries = entries.astype(np.int64)
        entries[repeated(entries)] = -1
        beam = max(beam, entries.shape[1])
        near = np.einsum("rcd,rd->rc", self.x[np.maximum(entries, 0)], queries)
        near[entries < 0] = -np.inf
        ids = np.pad(entries, ((0, 0), (0, beam - entries.shape[1])), constant_values=-1)
        near = np.pad(near, ((0, 0), (0, beam - near.shape[1])), constant_values=-np.inf)
        closed = near == -np.inf
        seen = np.zeros((rows, known), bool)
        r, c = np.nonzero(ids >= 0)
        seen[r, ids[r, c]] = True
        live = np.arange(rows)
        while len(live):
            open_ = np.where(closed[live], -np.inf, near[live])
            at = top(open_, EXPANDED)
            going = np.take_along_axis(open_, at, 1) > -np.inf
            some = going.any(1)
            live, at, going = live[some], at[some], going[some]
            if not len(live):
                break
            closed[live[:, None], at] |= going
            from_ = np.where(going, ids[live[:, None], at], -1)
            to = np.where(from_[:, :, None] >= 0, links[np.maximum(from_, 0)], -1).reshape(len(live), -1)
            to[(to >= known)] = -1
            fresh = (to >= 0) & ~seen[live[:, None], np.maximum(to, 0)]
            to[~fresh] = -1
            to[repeated(to)] = -1
            k, c = np.nonzero(to >= 0)
            if not len(k):
                continue
            seen[live[k], to[k, c]] = True
            value = np.full(to.shape, -np.inf, np.float32)
            value[k, c] = np.einsum("nd,nd->n", self.x[to[k, c]], queries[live[k]])
            all_near, all_ids = np.concatenate([near[live], value], 1), np.concatenate([ids[live], to], 1)
            all_closed = np.concatenate([closed[live], to < 0], 1)
            best = top(all_near, beam)
            near[live], ids[live], closed[live] = (np.take_along_axis(z, best, 1) for z in (all_near, all_ids, all_closed))
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def repeated(ids: np.ndarray) -> np.ndarray:
    """Which entries of a row stand in it before."""
    order = np.argsort(ids, axis=1, kind="stable")
    ranked = np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
    out = np.zeros(ids.shape, bool)
    np.put_along_axis(out, order, again, 1)
    return out


def build(nodes: DataFrame) -> DataFrame:
    """nodes (shard, dim, node, weight, v) with place and links of each level they are in: the graphs, one per dim and shard.

    A task holds one shard at a time. Higher levels have the nodes of least hash.
    """
    keys = ["dim", "shard"]
    dealt = nodes.withColumn("h", F.xxhash64("node")).repartition(partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys, "h", "node").drop("h")

    def graph(dim: int, shard: int, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        found = Graph(units([r[2] for r in rows], dim)[1])
        for lo in range(0, len(rows), ROWS):
            part = rows[lo : lo + ROWS]
            links = [[own[i].tobytes() for own, n in zip(found.links, found.counts) if i < n] for i in range(lo, lo + len(part))]
            yield pd.DataFrame({"dim": dim, "shard": shard, "place": range(lo, lo + len(part)), "node": [r[0] for r in part], "weight": [r[1] for r in part], "v": [r[2] for r in part], "links": links})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []
        for batch in batches:
            for dim, shard, *row in zip(*(batch[c] for c in (*keys, "node", "weight", "v"))):
                if (dim, shard) != now:
                    if rows:
                        yield from graph(*now, rows)
                    now, rows = (dim, shard), []
                rows.append(tuple(row))
        if rows:
            yield from graph(*now, rows)

    return settle(dealt.mapInPandas(run, "dim int, shard int, place int, node bigint, weight bigint, v binary, links array<binary>"), "graphs")


class Shard:
    """A shard's graph, read from its rows, and what its queries find."""

    def __init__(self, dim: int, rows: list[tuple]) -> None:
        self.nodes, self.weights = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.exact, x = units([r[2] for r in rows], dim)
        depth = max(len(r[3]) for r in rows)
        self.graph = Graph(x, [np.stack([np.frombuffer(r[3][k], np.int32) for r in rows if len(r[3]) > k]) for k in range(depth)])

    def answers(self, nodes: np.ndarray, vectors: list[bytes], dim: int, beam: int, least: float) -> Iterator[tuple]:
        """For each query with links: its node, the places it links to, and whether the shard was scanned for it."""
        exact, x = units(vectors, dim)
        open_, width = np.arange(len(nodes)), beam
        while len(open_):
            if 4 * width >= len(self.nodes):
                for at in open_:
                    near = self.graph.x @ x[at]
                    places = np.flatnonzero(near >= least - SLACK)
                    places = places[linked(self.exact[places], np.broadcast_to(exact[at], (len(places), dim)), near[places], least)]
                    yield nodes[at], places[self.nodes[places] != nodes[at]], len(places) > beam
                return
            ids, near = self.graph.search(x[open_], width)
            full = 2 * (near >= least - SLACK).sum(1) >= width  # half links: there may be more
            r, c = np.nonzero((near >= least - SLACK) & ~full[:, None])
            good = linked(self.exact[ids[r, c]], exact[open_[r]], near[r, c], least)
            r, places = r[good], ids[r[good], c[good]]
            cuts = np.searchsorted(r, np.arange(len(open_) + 1))
            for k in np.flatnonzero(~full):
                own = places[cuts[k] : cuts[k + 1]]
                if len(own):
                    at = open_[k]
                    yield nodes[at], own[self.nodes[own] != nodes[at]], len(own) > beam
            open_, width = open_[full], 4 * width


def queried(graphs: DataFrame, parts: int, shards: int, beam: int, least: float) -> DataFrame:
    """What the nodes find in all shards: rows of kind p (a links to b, in shard, of weight n), d (a links to n rows, m nodes, in shard) and f (a and b are of one component).

    A query that finds more than beam nodes in a shard gives d; its links join a forest. Each cell of work is a shard and a part of the queries,
    the graph's rows first.
    """
    keys = ["dim", "shard", "part"]
    spark = graphs.sparkSession
    blank = {"place": F.lit(-1), "links": F.lit(None).cast("array<binary>")}
    columns = ["side", *keys, "place", "node", "weight", "v", "links"]
    held = graphs.withColumn("side", F.lit(0)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = graphs.withColumns(blank).withColumn("side", F.lit(1)).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = held.select(*columns).unionByName(asked.select(*columns))
    dealt = both.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "side", "place", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, shard, asked, out, ties = None, [], None, [], [], []

        def answered() -> Iterator[pd.DataFrame]:
            nonlocal shard, asked, out
            if rows and shard is None:
                shard = Shard(now[0], rows)
            if shard is not None and asked:
                for node, places, dense in shard.answers(np.array([a for a, _ in asked]), [v for _, v in asked], now[0], beam, least):
                    if dense:
                        out.append(("d", node, len(places), now[1], int(shard.weights[places].sum())))
                        ties.append(np.stack([np.full(len(places), node), shard.nodes[places]]))
                    else:
                        out += [("p", node, b, now[1], n) for b, n in zip(shard.nodes[places].tolist(), shard.weights[places].tolist())]
            asked = []
            if sum(t.shape[1] for t in ties) > 500_000:
                tied()
            if out:
                yield pd.DataFrame(out, columns=["kind", "a", "b", "shard", "n"])
                out = []

        def tied() -> None:
            if ties:
                a, b = forest(*np.concatenate(ties, 1))
                ties.clear()
                ties.append(np.stack([a, b]))

        def flushed() -> Iterator[pd.DataFrame]:
            yield from answered()
            tied()
            if ties:
                yield pd.DataFrame({"kind": "f", "a": ties[0][0], "b": ties[0][1], "shard": now[1], "n": 0})
                ties.clear()

        for batch in batches:
            for dim, at, part, side, node, weight, v, links in zip(*(batch[c] for c in (*keys, "side", "node", "weight", "v", "links"))):
                if (dim, at, part) != now:
                    if now is not None:
                        yield from flushed()
                    now, rows, shard = (dim, at, part), [], None
                if side == 0:
                    rows.append((node, weight, v, list(links)))
                else:
                    asked.append((node, v))
                    if len(asked) >= BESIDE:
                        yield from answered()
        if now is not None:
            yield from flushed()

    return settle(dealt.mapInPandas(run, "kind string, a bigint, b bigint, shard int, n bigint"), "answers")


def audited(nodes: DataFrame, found: DataFrame, least: float) -> float:
    """The share of the links of a sample of nodes that found has; 1 where they have none. The sample (those of least hash) is bounded and meets every node."""
    picked = nodes.select("node", F.xxhash64("node", F.lit(2)).alias("h")).orderBy("h", "node").limit(AUDITED).select("node")
    sample = [(r["dim"], r["node"], bytes(r["v"])) for r in sized_join(nodes, settle(picked, "sample", narrow=True), "node", "left_semi").collect()]
    dims = {dim: (np.array([n for d, n, _ in sample if d == dim]), *units([v for d, _, v in sample if d == dim], dim)) for dim in {d for d, _, _ in sample}}
    shared = nodes.sparkSession.sparkContext.broadcast(dims)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                if dim in shared.value:
                    own, exact, x = shared.value[dim]
                    left, y = units(part["v"].tolist(), dim)
                    near = y @ x.T
                    r, c = np.nonzero(near >= least - SLACK)
                    r, c = (z[linked(left[r], exact[c], near[r, c], least)] for z in (r, c))
                    nodes_, counts = np.unique(own[c][part["node"].to_numpy()[r] != own[c]], return_counts=True)
                    yield pd.DataFrame({"node": nodes_, "n": counts})

    due = nodes.mapInPandas(run, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("due"))
    got = found.filter("kind <> 'f'").join(F.broadcast(settle(picked, "sample", narrow=True)), F.col("a") == F.col("node"), "left_semi")
    got = got.groupBy(F.col("a").alias("node")).agg(F.sum(F.when(F.col("kind") == "d", F.col("b")).otherwise(1)).alias("got"))
    row = due.join(got, "node", "left").agg(F.sum("due").alias("due"), F.sum(F.least("due", F.coalesce("got", F.lit(0)))).alias("got")).first()
    return row["got"] / row["due"] if row["due"] else 1.0


def link_counts(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and n, the rows of other nodes that it links to. A pair that one side alone has found counts for both, unless the other's count in that shard is from a scan."""
    pairs = found.filter("kind = 'p'").select("a", "b")
    both = settle(pairs.union(pairs.select("b", "a")).distinct(), "pairs", narrow=True)
    where = nodes.select(F.col("node").alias("b"), "shard", F.col("weight").alias("n"))
    dense = settle(found.filter("kind = 'd'").select("a", "shard", "n"), "dense", narrow=True)
    single = sized_join(both.join(where, "b").select("a", "b", "shard", "n"), dense.select("a", "shard"), ["a", "shard"], "left_anti")
    return settle(single.select("a", "n").unionByName(dense.select("a", "n")).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "counts", narrow=True)


@tidied
def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (the least vec_id that links reach) and kept (whether that is its own) of every row.

    Rows link if the cosine of their vectors is least or more. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing; so do vectors of different lengths. Rows that repeat a vec_id are rows of
    their own. A row without a vec_id is linked like any other, and counts as kept where no row of its component has one.
    An empty table gives an empty result; columns other than vec_id and embedding are ignored.

    Recall is audited, not certain; a link found is always one.
    """
    spark = vectors.sparkSession
    rows = classes(vectors)
    reps = rows.filter("key is not null").groupBy("dim", "key").agg(F.min("at").alias("at"), F.count("*").alias("weight"), F.min("vec_id").alias("id"))
    reps = settle(reps, "classes", narrow=True)
    n = reps.count()
    if n == 0:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    shards = max(SHARDS, -(-n // SHARD_ROWS))
    parts = max(-(-n // SHARD_ROWS), -(-partitions(spark) // shards))
    shard = F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int").alias("shard")
    nodes = sized_join(rows.select("at", "dim", "v"), reps.select("at", "weight"), "at", "inner").select(F.col("at").alias("node"), "dim", shard, "weight", "v")
    graphs = build(nodes)
    beam, recall = BEAM, 0.0
    while True:
        found = queried(graphs, parts, shards, beam, least)
        recall = audited(graphs, found, least)
        if recall >= RECALL or 4 * beam >= SHARD_ROWS:
            break
        beam *= 4
    counts = link_counts(found, graphs.select("node", "shard", "weight"))
    labels = components(found.filter("kind <> 'd'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    known = sized_join(sized_join(reps.withColumnRenamed("at", "node"), settle(labels, "components", narrow=True), "node", "left"), counts, "node", "left")
    known = settle(known.select("dim", "key", "id", F.coalesce("component", "node").alias("component"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "known", narrow=True)
    least_ids = settle(known.groupBy("component").agg(F.min("id").alias("component_id")), "least_ids", narrow=True)
    known = settle(sized_join(known, least_ids, "component", "inner").select("key", "dim", "n_links", "component_id"), "labelled", narrow=True)
    out = sized_join(rows.select("vec_id", "dim", "key"), known, ["dim", "key"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
