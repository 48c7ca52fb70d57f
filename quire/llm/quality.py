"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel. Each partition sums its part of the normal equations; the sums
(a matrix of fixed size) are added on Spark and solved on the driver. Labels are learnt only from training rows;
a fifth of these is kept from the ridge and calibrates its scores by isotonic regression over a fixed grid.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quire.llm.common import settle, sized_join, tidied

#: Random features, width of the kernel in standard deviations, ridge penalty per row, cells of the calibration grid.
FEATURES, WIDTH, RIDGE, GRID = 192, 4.0, 1e-4, 512
#: A document is accepted from this score on. Rows with this remainder of crc32(doc_id) mod 5 are held out;
#: those with the next one calibrate.
ACCEPT, HELD_OUT, CALIBRATE = 0.3, 0, 1

STATISTICS = 14
_kinds = np.zeros(256, np.int64)  # of UTF-8 bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 symbol, 6 beyond ASCII
for _first, _last, _kind in ((33, 126, 5), (97, 122, 1), (65, 90, 2), (48, 57, 3), (9, 13, 4), (32, 32, 4), (128, 255, 6)):
    _kinds[_first : _last + 1] = _kind


def statistics(text: str | None) -> list[float]:
    """Fixed numbers that describe a whole text. A null or empty text has all of them 0."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * STATISTICS
    kinds = np.bincount(_kinds, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=7) / len(data)
    n = len(words)
    counts = Counter(words)
    lines = data.split(b"\n")
    symbols = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:!?'\")-")
    shouted = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return [
        np.log1p(len(data)),
        np.log1p(n),
        len(data) / n if n < len(data) else 1.0,
        np.log(len(counts)) / np.log(n) if n > 1 else 1.0,
        max(counts.values()) / n if n > 5 else 0.2,
        sum(map(eq, words, words[1:])) / n,
        symbols / n,
        shouted / n,
        *kinds[[2, 3, 5, 6]].tolist(),
        len(set(lines)) / len(lines),
        np.log1p(len(data) / len(lines)),
    ]


def _features(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Cosines of random projections, with the seed as part of the model's form, and a constant."""
    rng = np.random.default_rng(17)
    w, b = rng.normal(size=(STATISTICS, FEATURES - 1)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES - 1)
    z = np.clip((x - centre) / spread, -8, 8)
    return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ w + b)])


class Model:
    """Centre and spread of the statistics, ridge weights, and the calibrated value at each cell of the grid."""

    def __init__(self, centre, spread, weights, cells):
        self.centre, self.spread, self.weights, self.cells = centre, spread, weights, cells

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_features(x, self.centre, self.spread) @ self.weights, -0.5, 1.5)

    def scores(self, x: np.ndarray) -> np.ndarray:
        cell = np.minimum(((self.raw(x) + 0.5) / 2 * GRID).astype(int), GRID - 1)
        return self.cells[cell]


def isotonic(weight: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing fit over the grid by pooling neighbours that violate the order; empty cells interpolate."""
    pools: list[list[float]] = []  # weight, ones, first cell, last cell
    for i in np.flatnonzero(weight):
        pools.append([weight[i], ones[i], i, i])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, y, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + y, pools[-1][2], last]
    at = [c for p in pools for c in (p[2], p[3])]
    value = [p[1] / p[0] for p in pools for _ in (0, 1)]
    return np.interp(np.arange(len(weight)), at, value)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


_statistics = F.pandas_udf(lambda texts: pd.Series([statistics(t) for t in texts]), ArrayType(DoubleType()))


@tidied
def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from labelled training rows. Null labels are left out; repeated labels of a document count each.

    Without any training row every score is 0.5.
    """
    known = labels.filter("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("quality"))
    known = settle(known.filter(fold(F.col("doc_id")) != HELD_OUT), "labels")
    rows = sized_join(docs.select("doc_id", "text").filter(fold(F.col("doc_id")) != HELD_OUT), known, "doc_id", "inner")
    rows = settle(rows.select("quality", fold(F.col("doc_id")).alias("fold"), _statistics("text").alias("x")), "statistics")
    at = [F.col("x")[i].cast("double") for i in range(STATISTICS)]
    m = rows.agg(*[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    if m is None or m[0] is None:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES), np.full(GRID, 0.5))
    centre, spread = np.array(m[:STATISTICS]), np.maximum(np.array(m[STATISTICS:]), 1e-3)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((FEATURES, FEATURES + 1)), 0
        for batch in batches:
            z = _features(np.stack(batch["x"].to_numpy()).astype(float), centre, spread)
            total += z.T @ np.column_stack([z, batch["quality"].to_numpy()])
            n += len(batch)
        if n:
            yield pd.DataFrame({"i": np.arange(FEATURES), "n": n, "row": list(total)})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": part["i"].iloc[:1], "n": [part["n"].sum()], "row": [np.sum(part["row"].to_numpy(), axis=0)]})

    ridge_rows = rows.filter(F.col("fold") != CALIBRATE)
    got = ridge_rows.mapInPandas(sums, "i int, n bigint, row array<double>").groupBy("i").applyInPandas(add, "i int, n bigint, row array<double>").collect()
    model = Model(centre, spread, np.zeros(FEATURES), np.full(GRID, 0.5))
    if got:
        full = np.array([r["row"] for r in sorted(got, key=lambda r: r["i"])])
        model.weights = np.linalg.solve(full[:, :FEATURES] + RIDGE * got[0]["n"] * np.eye(FEATURES), full[:, FEATURES])
    raw = F.pandas_udf(lambda x: pd.Series(model.raw(np.stack(x.to_numpy()).astype(float))), DoubleType())
    cell = F.least(((raw("x") + 0.5) / 2 * GRID).cast("int"), F.lit(GRID - 1))
    grid = rows.filter((F.col("fold") == CALIBRATE) | F.lit(not got)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("quality").alias("ones")).collect()
    if grid:
        weight, ones = np.zeros(GRID), np.zeros(GRID)
        for r in grid:
            weight[r["cell"]], ones[r["cell"]] = r["n"], r["ones"]
        model.cells = np.clip(isotonic(weight, ones), 0, 1)
    elif got:
        model.cells = np.clip(np.linspace(-0.5, 1.5, GRID), 0, 1)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the columns score and predicted, in place of any of these names.

    Only the text counts. Null and empty texts score like any text whose statistics are all 0.
    """
    of = F.pandas_udf(lambda texts: pd.Series(model.scores(np.array([statistics(t) for t in texts], float).reshape(-1, STATISTICS))), DoubleType())
    return docs.withColumn("score", of("text")).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; an empty table gives an empty result."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; null and empty texts are scored like any other.

    Rows without a doc_id are scored but never learnt from; repeated rows are kept or rejected each alike; an
    empty table gives an empty one. Columns named score or predicted are dropped, all others kept.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    return score(docs.select(*names), train(docs, labels)).filter("predicted = 1").select(*names)
