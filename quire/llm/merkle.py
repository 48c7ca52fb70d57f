"""Document fingerprints: a Merkle tree over paragraphs and sections.

Paragraphs are lines; a section is a run of paragraphs that a blank line or a paragraph with a digest
divisible by SECTION closes, so an insertion moves no later section. A paragraph's leaves are pieces of it,
cut where the WINDOW bytes before a place say so: an edit changes the leaves that it touches and no others,
in long lines too. Every node's digest is that of its children's digests. Equal roots mean equal texts; where
roots differ, the branches that differ locate the edit (see `nodes` and `differences`).

A printed fingerprint is the root and, in page order, the sections' and leaves' short digests with the leaves'
lengths. The likeness of two fingerprints is the share of their bytes that lies under branches both trees have.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bucket_bounds, bucket_of, partitions, tie_bucket

#: A paragraph closes its section if its digest is divisible by this.
SECTION = 8
#: Bytes that decide whether a leaf ends, one in how many places does, and the longest leaf.
WINDOW, EVERY, LONGEST = 8, 32, 255
#: Lines of up to so many bytes are cut at one in so many places, the shortest ones as the last two bytes say: a short text has leaves enough to keep some over an edit.
SHORT, SHORTEST = ((40, 2), (128, 4)), 40
#: Rows per batch that leaves a task.
ROWS = 256

_gear = np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint32)  # a number for each byte


class Tree(NamedTuple):
    """Root; per section its digest and its paragraphs, each a digest and where its leaves start and end; the leaves' digests and ends."""

    root: bytes
    sections: list[tuple[bytes, list[tuple[bytes, int, int]]]]
    leaves: list[bytes]
    ends: np.ndarray


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _sizes(ends: np.ndarray) -> np.ndarray:
    out = ends.copy()
    out[1:] -= ends[:-1]
    return out


def leaf_ends(raw: np.ndarray) -> np.ndarray:
    """Ends of the leaves of a text: at every line end, where the bytes before a place say so (more often in short lines), and after LONGEST bytes."""
    own = _gear[raw]
    mixed = own.copy()
    for k in range(1, min(WINDOW, len(raw))):
        mixed[k:] += own[:-k] << np.uint32(k)
    near = own.copy()
    near[1:] += own[:-1] << np.uint32(1)
    stops = np.flatnonzero(raw == 10) + 1
    stops = stops if len(stops) and stops[-1] == len(raw) else np.append(stops, len(raw))
    lines = _sizes(stops)
    starts = stops - lines  # what stands before a line does not count
    near[starts] = own[starts]
    for k in range(WINDOW - 1):
        mixed[np.minimum(starts + k, stops - 1)] = 1 << 12
    every = np.full(len(lines), EVERY, np.uint32)
    for most, places in reversed(SHORT):
        every[lines <= most] = places
    mixed = np.where(np.repeat(lines <= SHORTEST, lines), near, mixed)
    ends = np.flatnonzero(((mixed >> np.uint32(12)) & (np.repeat(every, lines) - np.uint32(1)) == 0) | (raw == 10)) + 1
    ends = ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))
    size = _sizes(ends)
    if size.max(initial=0) <= LONGEST:
        return ends
    return np.array([x for end, n in zip(ends.tolist(), size.tolist()) for x in [*range(end - n + LONGEST, end, LONGEST), end]])


def tree(text: str | None) -> Tree:
    """The tree of a whole text. A null text counts as empty: one section of one paragraph without leaves."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    ends = leaf_ends(raw) if data else np.zeros(0, np.int64)
    places = ends.tolist()
    leaves = [xxhash.xxh3_128_digest(data[i:j]) for i, j in zip([0, *places], places)]
    stops = (np.flatnonzero(raw[ends - 1] == 10) + 1).tolist()
    stops = stops if stops and stops[-1] == len(leaves) else [*stops, len(leaves)]
    sections, paragraphs, start = [], [], 0
    for i, j in zip([0, *stops], stops):
        digest = _digest(b"".join(leaves[i:j]))
        paragraphs.append((digest, i, j))
        end = places[j - 1] if j else 0
        if digest[0] % SECTION == 0 or data[start:end].isspace():
            sections.append((_digest(b"".join([d for d, _, _ in paragraphs])), paragraphs))
            paragraphs = []
        start = end
    if paragraphs:
        sections.append((_digest(b"".join([d for d, _, _ in paragraphs])), paragraphs))
    return Tree(_digest(b"".join([d for d, _ in sections])), sections, leaves, ends)


class Fingerprint(NamedTuple):
    """Root (hex), short digests of the sections and the number of leaves of each, the leaves' short digests and lengths."""

    root: str
    sections: np.ndarray
    counts: np.ndarray
    leaves: np.ndarray
    lengths: np.ndarray

    def printed(self) -> str:
        head = np.array([len(self.sections)], "<u4").tobytes()
        return f"{self.root}:{base64.b64encode(head + self.sections.tobytes() + self.counts.tobytes() + self.leaves.tobytes() + self.lengths.tobytes()).decode()}"


def fingerprint(text: str | None) -> Fingerprint:
    root, sections, leaves, ends = tree(text)
    return Fingerprint(
        root.hex(),
        np.frombuffer(b"".join([d[:4] for d, _ in sections]), "<u4"),
        np.array([own[-1][2] - own[0][1] for _, own in sections], "<u4"),
        np.frombuffer(b"".join(leaves), "<u4")[::4].copy(),
        _sizes(ends).astype(np.uint8),
    )


def read(printed: str) -> Fingerprint:
    """A fingerprint from its printed form."""
    root, _, body = printed.partition(":")
    data = base64.b64decode(body)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    m = (len(data) - 4 - 8 * n) // 5
    return Fingerprint(root, np.frombuffer(data, "<u4", n, 4), np.frombuffer(data, "<u4", n, 4 + 4 * n), np.frombuffer(data, "<u4", m, 4 + 8 * n), np.frombuffer(data, np.uint8, m, 4 + 8 * n + 4 * m))


def likeness(left: Fingerprint, right: Fingerprint) -> float:
    """1 for equal roots; else twice the bytes under common branches over the bytes of both, less than 1.

    Sections that both trees have count whole and are not descended into; of the others' leaves those count
    that both have, each as often as both have it.
    """
    if left.root == right.root:
        return 1.0
    total = int(left.lengths.sum(dtype=np.int64) + right.lengths.sum(dtype=np.int64))
    if not len(left.leaves) or not len(right.leaves):
        return 0.0
    shared, rest = 0, []
    both = Counter(left.sections.tolist()) & Counter(right.sections.tolist())
    for side in (left, right):
        lengths = side.lengths.astype(np.int64)
        if both:
            due, whole = Counter(both), []
            for s in side.sections.tolist():
                whole.append(due[s] > 0)
                due[s] -= 1
            whole = np.repeat(whole, side.counts)
            shared = int(lengths[whole].sum())  # the same on both sides
            rest.append(np.unique(side.leaves[~whole], return_index=True, return_counts=True) + (lengths[~whole],))
        else:
            rest.append(np.unique(side.leaves, return_index=True, return_counts=True) + (lengths,))
    (a, first, times, lengths), (b, _, others, _) = rest
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared += int((lengths[first[i]] * np.minimum(times[i], others[j])).sum())
    return min(2 * shared / total, 0.999999)


def nodes(docs: DataFrame) -> DataFrame:
    """One row per tree node down to paragraphs: doc_id, section and paragraph (null above their level), digest (hex)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                root, sections, _, _ = tree(text)
                rows = [(doc, None, None, root.hex())]
                for i, (digest, paragraphs) in enumerate(sections):
                    rows += [(doc, i, None, digest.hex()), *((doc, i, k, d.hex()) for k, (d, _, _) in enumerate(paragraphs))]
                yield pd.DataFrame(rows, columns=["doc_id", "section", "paragraph", "digest"]).astype({"section": "Int64", "paragraph": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, section bigint, paragraph bigint, digest string")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paragraphs of left whose digest its document in right lacks, under sections that right lacks.

    Branches with equal section digests are left out before their paragraphs are compared.
    """
    open_ = left.filter("section is not null and paragraph is null").join(
        right.filter("section is not null and paragraph is null").select("doc_id", "digest"), ["doc_id", "digest"], "left_anti"
    )
    leaves = left.filter("paragraph is not null").join(open_.select("doc_id", "section"), ["doc_id", "section"], "left_semi")
    return leaves.join(right.filter("paragraph is not null").select("doc_id", "digest"), ["doc_id", "digest"], "left_anti").select("doc_id", "section", "paragraph", "digest")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses to these and to the next document.

    The next document is the one with the next doc_id (repeated ids: in the order of a hash of the text;
    after the last comes the first; a null id comes first). An edited text has its last floor(n_chars/2)
    code points replaced by as many first ones of the next document, or all it has. Null texts count as
    empty; an empty table gives an empty result; other columns are ignored.

    Texts move once, to even ranges of doc_id; the rows of an id that fills several ranges are dealt by their
    text's hash. The first row of each range also goes to the range before it, so every row meets its neighbour
    without a global window.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    p = partitions(spark)
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    bounds, shares = bucket_bounds(src, "doc_id", 4 * p)
    if not bounds:
        return spark.createDataFrame([], schema)
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    dealt = src.withColumn("bucket", bucket_of(F.col("doc_id"), bounds))
    first, ranges = key == F.element_at(F.lit(bounds), F.col("bucket") + 1), len(bounds)
    if max(shares) > 1:  # parts may be empty: the first row of each one that is not is looked up
        before = np.cumsum([0, *(1 if n == 1 else n + 1 for n in shares)]).tolist()
        part = tie_bucket(F.col("doc_id"), F.col("tie"), F.col("bucket"), bounds, shares)
        dealt = dealt.withColumn("bucket", F.element_at(F.lit(before), F.col("bucket") + 1) + part)
        heads = sorted((r["bucket"], r["head"]) for r in dealt.groupBy("bucket").agg(F.min(F.struct(key.alias("k"), "tie")).alias("head")).collect())
        dealt, ranges = dealt.withColumn("bucket", bucket_of(F.col("bucket"), [b for b, _ in heads])), len(heads)
        at = F.col("bucket") + 1
        first = (key == F.element_at(F.lit([h["k"] for _, h in heads]), at)) & (F.col("tie") == F.element_at(F.lit([h["tie"] for _, h in heads]), at))
    own = F.struct(F.col("bucket").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("bucket") - 1, F.lit(ranges)).alias("range"), F.lit(1).alias("guest"))
    dealt = (
        dealt.select("doc_id", "text", "tie", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
        .select("doc_id", "text", "tie", "at.range", "at.guest")
        .repartition(p, "range")
        .sortWithinPartitions("range", "guest", "doc_id", "tie")
        .select("doc_id", "text", "range", "guest")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, before = [], None
        for batch in batches:
            for doc, text, at, guest in zip(batch["doc_id"], batch["text"], batch["range"], batch["guest"]):
                if guest and (before is None or before[3] != at):
                    continue  # a repeated id at the edge: the first such row has been met
                text = text or ""
                mark = fingerprint(text)
                if before is not None:
                    old, own, own_mark, _ = before
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    edited_mark = fingerprint(edited)
                    rows.append((old, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_mark.printed(), edited_mark.printed(), likeness(own_mark, edited_mark), likeness(own_mark, mark)))
                before = None if guest else (doc, text, mark, at)
                if len(rows) >= ROWS:
                    yield table(rows)
                    rows = []
        yield table(rows)

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        return out.astype({"doc_id": "Int64"})

    return dealt.mapInPandas(run, schema)
