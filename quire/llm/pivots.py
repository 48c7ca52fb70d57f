"""Exact top-k search by pivot-table elimination.

Distances of every vector to many pivots are computed once. By the triangle inequality the distance of a
query and a candidate is at least the largest difference of their distances to a pivot, which bounds the
inner product from above. Candidates are evaluated in the order of these bounds until no bound left can
reach the k-th best score.

Candidates lie in cells, by their nearest pivot, and cells in blocks. A cell's least and largest distance to each
pivot bound all its scores at once: a query first goes to the cell of its best bound, and then to those cells
alone whose bound reaches the k-th score found there. Queries move, candidates stay in their block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import partitions, settle, tidied

#: Pivots, and vectors (those of least hash) among which they are chosen; both bounded whatever the table.
PIVOTS, PIVOT_SAMPLE = 48, 1024
#: Rows of a block of candidates.
BLOCK = 4096
#: Candidates evaluated first; each further step takes twice as many.
STEP = 64
#: Stands for a vec_id that is null: such rows are candidates, after all others on ties, and no queries.
NO_ID = 2**63 - 1
#: Room for rounding in bounds, relative to the lengths of the two vectors.
SLACK = 1e-7


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id (NO_ID where it is null) and v, each component x as floor(scale * x). Rows that are null, empty or hold a null or non-finite component go.

    A finite component whose floor(scale * x) exceeds 64 bits fails the query, for no score could be right.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(x, finite)
    whole = lambda c: F.when(F.abs(c * scale) < 2.0**63, F.floor(c * scale).cast("long")).otherwise(F.raise_error(F.lit("a component exceeds 64 bits")).cast("long"))
    return vectors.filter(sound).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.transform(x, whole).alias("v"))


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n points of a sample that lie far apart: each next one is farthest from those before."""
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def choose(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The pivots of each dimension that the sample has. The sample is picked by narrow rows, then its vectors are read."""
    ids = [r["at"] for r in vectors.select("at", F.xxhash64("vec_id", "at").alias("h")).orderBy("h", "at").limit(PIVOT_SAMPLE).collect()]
    sample = [r["v"] for r in vectors.filter(F.col("at").isin(ids)).orderBy(F.xxhash64("vec_id", "at"), "at").select("v").collect()] if ids else []
    return {dim: choose_pivots(np.array([v for v in sample if len(v) == dim], float), PIVOTS) for dim in sorted({len(v) for v in sample})}


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vectors with dim, cell (the nearest pivot), square (of the length) and d, the distances to the pivots of their dimension."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].str.len()):
                v = np.stack(part["v"].to_numpy()).astype(float)
                p = shared.value.get(dim, np.zeros((1, dim)))
                d = np.sqrt(np.maximum((v**2).sum(1)[:, None] + (p**2).sum(1) - 2 * v @ p.T, 0))
                yield pd.DataFrame({"at": part["at"], "vec_id": part["vec_id"], "dim": dim, "cell": d.argmin(1), "square": (v**2).sum(1), "v": part["v"], "d": list(d)})

    return vectors.mapInPandas(run, "at bigint, vec_id bigint, dim int, cell int, square double, v array<bigint>, d array<double>")


def cells(table: DataFrame) -> dict[int, list[tuple]]:
    """Per dimension the cells: number, blocks, largest square, and least and largest distances to the pivots.

    At most PIVOTS rows a dimension, each of two numbers a pivot; summed before the shuffle.
    """
    far = F.posexplode("d").alias("p", "x")
    ranges = table.select("dim", "cell", far).groupBy("dim", "cell", "p").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ranges = ranges.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("p", "lo", "hi"))).alias("ranges"))
    sizes = table.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("square").alias("square"))
    found: dict[int, list[tuple]] = {}
    for r in sizes.join(ranges, ["dim", "cell"]).collect():
        found.setdefault(r["dim"], []).append((r["cell"], -(-r["n"] // BLOCK), r["square"], np.array([x["lo"] for x in r["ranges"]]), np.array([x["hi"] for x in r["ranges"]])))
    return found


def reachable(square: float, d: np.ndarray, own: list[tuple]) -> np.ndarray:
    """The highest score that a query could have in each cell of its dimension."""
    lo, hi = np.stack([c[3] for c in own]), np.stack([c[4] for c in own])
    apart = np.maximum(np.maximum(lo - d, d - hi), 0).max(1)
    most = np.array([c[2] for c in own])
    return (square + most - apart**2) / 2 + SLACK * (square + most) + 1


def routed(asked: DataFrame, known: dict[int, list[tuple]], first: bool) -> DataFrame:
    """asked once per block to visit: those of the best cell, or (with its k-th score as least) of all other cells that could reach it."""
    shared = asked.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, dim, square, d, least in zip(batch["at"], batch["dim"], batch["square"], batch["d"], batch["least"]):
                own = shared.value[dim]
                most = reachable(square, np.asarray(d), own)
                best = int(most.argmax())
                go = [best] if first else [i for i in np.flatnonzero(most >= (least if least == least else -np.inf)) if i != best]
                rows += [(at, own[i][0], b) for i in go for b in range(own[i][1])]
            yield pd.DataFrame(rows, columns=["at", "cell", "block"])

    return asked.select("at", "dim", "square", "d", "least").mapInPandas(run, "at bigint, cell int, block int").join(asked.drop("cell"), "at")


def best(query: np.ndarray, square: float, qd: np.ndarray, own: int, at: np.ndarray, ids: np.ndarray, v: np.ndarray, squares: np.ndarray, d: np.ndarray, k: int, least: float | None) -> list[tuple[int, int]]:
    """The k best (score, vec_id) of a block for one query that reach least, if that is given; ids ascending."""
    apart = np.abs(d - qd).max(1)
    bound = (square + squares - apart**2) / 2 + SLACK * (square + squares) + 1
    bound[at == own] = -np.inf
    order = np.argsort(-bound, kind="stable")[: int((bound > -np.inf).sum())]
    scores, done, step = np.zeros(0, v.dtype), 0, STEP
    while done < len(order) and (least is None or bound[order[done]] >= least):
        scores = np.concatenate([scores, v[order[done : done + step]] @ query])
        done, step = done + step, 2 * step
        if len(scores) >= k:
            kth = np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, -k)[-k]
            least = kth if least is None else max(least, kth)
    seen = ids[order[: len(scores)]]
    top = np.flatnonzero(scores >= least) if least is not None else np.arange(len(scores))
    top = sorted(top.tolist(), key=lambda i: (-scores[i], seen[i]))[:k]
    if any(abs(int(scores[i])) >= 1 << 63 for i in top):
        raise OverflowError("a score exceeds 64 bits")
    return [(int(scores[i]), int(seen[i])) for i in top]


def met(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query (its place), query_id, vec_id and score of the k best in each block that a query visits.

    Rows pass in block order, candidates before queries, so a task holds one block of candidates at a time.
    """
    keys, columns = ["dim", "cell", "block"], ["side", "at", "vec_id", "square", "least", "v", "d"]
    spark = blocks.sparkSession
    both = blocks.withColumns({"side": F.lit(0), "least": F.lit(None).cast("double")}).select(*keys, *columns).unionByName(queries.withColumn("side", F.lit(1)).select(*keys, *columns))
    dealt = both.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "side", "vec_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, block = None, [], None
        for batch in batches:
            found = []
            for place, side, at, vec_id, square, least, v, d in zip(zip(*(batch[c] for c in keys)), *(batch[c] for c in columns)):
                if place != now:
                    now, held, block = place, [], None
                if side == 0:
                    held.append((at, vec_id, square, v, d))
                    continue
                if block is None and held:
                    ats, ids, squares, vs, ds = map(np.array, (x for x in zip(*held)))
                    if max(-int(vs.min()), int(vs.max())) ** 2 * vs.shape[1] < 2**52:
                        vs = vs.astype(float)  # sums of products are exact, and faster
                    else:
                        vs = vs.astype(object)  # whole numbers of any size
                    block = ats, ids, vs, squares, ds
                if block:
                    wide = block[2].dtype == object or max(-int(v.min()), int(v.max())) ** 2 * len(v) >= 2**52
                    own, query = (block[2].astype(np.int64).astype(object) if wide and block[2].dtype != object else block[2]), (v.astype(object) if wide else v.astype(float))
                    found += [(at, vec_id, i, s) for s, i in best(query, square, np.asarray(d), at, block[0], block[1], own, block[3], block[4], k, None if least != least else least)]
            if found:
                yield pd.DataFrame(found, columns=["query", "query_id", "vec_id", "score"], dtype="int64")

    return dealt.mapInPandas(run, "query bigint, query_id bigint, vec_id bigint, score bigint")


@tidied
def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, its k highest integer inner products.

    Ties go to the smaller vec_id. A query meets every row but itself; rows that repeat its vec_id are candidates
    and queries of their own. A row without a vec_id is a candidate (after all others on ties) and no query. Only vectors of the same length meet. Unsound vectors take no part; an empty
    table gives an empty result; columns other than vec_id and embedding are ignored. Products are exact at
    any size; a score among the k highest that exceeds 64 bits fails the query.
    """
    rows = settle(quantised(vectors).withColumn("at", F.monotonically_increasing_id()), "quantised")
    table = settle(pivot_table(rows, choose(rows)), "pivot_table")
    known = cells(table)
    if not known:
        return table.select(F.col("at").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("at").alias("score")).limit(0)
    blocks = F.lit(None).cast("int")
    for dim, own in known.items():
        sizes = F.create_map(*[F.lit(x) for c in own for x in (c[0], c[1])])
        blocks = F.when(F.col("dim") == dim, sizes[F.col("cell")]).otherwise(blocks)
    held = table.withColumn("block", F.pmod(F.xxhash64("at"), blocks).cast("int"))
    asked = table.filter((F.pmod("vec_id", F.lit(every)) == 0) & (F.col("vec_id") < NO_ID)).withColumn("least", F.lit(None).cast("double"))
    first = settle(met(held, routed(asked, known, True), k), "first_cells")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    kth = first.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query").alias("at"), (F.col("score") - F.abs(F.col("score") * 1e-9) - 1).cast("double").alias("least"))
    others = met(held, routed(asked.drop("least").join(kth, "at", "left"), known, False), k)
    return first.unionByName(others).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
