"""Token-ID output: one wavelet matrix per shard.

A shard is a run of documents in doc_id order. Its token ids are kept as bit planes, the highest bit
first; at each plane the ids are split, stably, into those with a 0 and those with a 1. With counts of
ones at every RANK_STEP bits, planes answer rank and select, and with these the matrix gives the token
at a place, the times a token occurs before it, and the place of its n-th occurrence.

A shard is one file (a binary value of a Parquet table in the shared folder): counts, the documents' ids and
sizes, and the planes in blocks that are compressed one by one, so that a reader inflates no other blocks
than those that its places lie in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.bpe import ROWS, codec_of, shared_codec
from quire.llm.common import bucket_bounds, bucket_of, partitions, settle, sized_join, tidied, tie_bucket

#: Id after each document; tokens after which a shard is closed; bits between counts of ones and bits of a block.
END, SHARD_TOKENS, RANK_STEP, BLOCK_BITS = 1, 1 << 17, 4096, 32_768
MAGIC = b"WM02"


class WaveletMatrix:
    """n ids as bit planes: the number of zeros of each, its ones before every RANK_STEP bits, and its blocks of packed bits.

    blocks(level, k) gives the k-th block of a plane; it is asked for each block at most once.
    """

    def __init__(self, n: int, zeros: list[int], ones: np.ndarray, blocks):
        self.n, self.zeros, self.ones, self._blocks = n, zeros, ones, blocks
        self.held: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        kind = np.uint16 if width <= 16 else np.uint32
        a, size = ids.astype(kind), -(-len(ids) // 8)
        planes, zeros = np.zeros((width, -(-size // (RANK_STEP // 8)) * RANK_STEP // 8), np.uint8), []
        for level in range(width):
            bits = (a & kind(1 << (width - 1 - level))) != 0
            planes[level, :size] = np.packbits(bits)
            ones = a[bits]
            low = a[np.logical_not(bits, out=bits)]
            zeros.append(len(low))
            a = np.concatenate([low, ones])
        steps = np.bitwise_count(planes).reshape(width, -1, RANK_STEP // 8).sum(2, dtype=np.uint32)
        ones = np.zeros((width, steps.shape[1] + 1), np.uint32)
        np.cumsum(steps, axis=1, out=ones[:, 1:])
        step = BLOCK_BITS // 8
        return cls(len(ids), zeros, ones, lambda level, k: planes[level, k * step : min(size, (k + 1) * step)])

    def block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self.held:
            self.held[level, k] = self._blocks(level, k)
        return self.held[level, k]

    def plane(self, level: int) -> np.ndarray:
        """All packed bits of a plane."""
        return np.concatenate([self.block(level, k) for k in range(-(-self.n // BLOCK_BITS))] or [np.zeros(0, np.uint8)])

    def unpack(self) -> np.ndarray:
        """All ids: from the last plane upwards, each split is undone."""
        width = len(self.zeros)
        v = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for level in reversed(range(width)):
            bits = np.unpackbits(self.plane(level), count=self.n).view(bool)
            out = np.empty_like(v)
            out[bits] = v[self.zeros[level] :] | v.dtype.type(1 << (width - 1 - level))
            out[np.logical_not(bits, out=bits)] = v[: self.zeros[level]]
            v = out
        return v

    def _bits(self, level: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits of a plane at places, and the ones before each."""
        bits, ones = np.zeros(len(places), bool), np.zeros(len(places), np.int64)
        for k in np.unique(places // BLOCK_BITS):
            here = places // BLOCK_BITS == k
            at = places[here] - k * BLOCK_BITS
            flat = np.unpackbits(self.block(level, int(k)))
            before = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
            bits[here], ones[here] = flat[np.minimum(at, len(flat) - 1)].astype(bool), before[at] + self.ones[level, k * (BLOCK_BITS // RANK_STEP)]
        return bits, ones

    def extract(self, places: np.ndarray) -> np.ndarray:
        """The ids at places, all followed through the planes at once."""
        value, places = np.zeros(len(places), np.int64), np.asarray(places, np.int64)
        for level, zeros in enumerate(self.zeros):
            bits, ones = self._bits(level, places)
            value, places = value << 1 | bits, np.where(bits, zeros + ones, places - ones)
        return value

    def access(self, i: int) -> int:
        """The id at place i."""
        return int(self.extract(np.array([i]))[0])

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        ones = int(self.ones[level, i // RANK_STEP])
        rest = i % RANK_STEP
        if rest:
            at = i - rest
            data = self.block(level, at // BLOCK_BITS)[at % BLOCK_BITS // 8 :]
            ones += int(np.bitwise_count(data[: rest // 8]).sum(dtype=np.int64))
            if rest % 8:
                ones += (int(data[rest // 8]) >> (8 - rest % 8)).bit_count()
        return ones

    def _run(self, token: int, end: int) -> tuple[int, int]:
        """Place after the last plane of the first of all such tokens, and of the end of those before place end."""
        start = 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, start), self._rank1(level, end)
            start, end = (zeros + a, zeros + b) if token >> (len(self.zeros) - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def rank(self, token: int, end: int) -> int:
        """Times that token occurs before place end."""
        if token >> len(self.zeros):
            return 0
        start, end = self._run(token, end)
        return end - start

    def select(self, token: int, n: int) -> int:
        """Place of the n-th occurrence (from 0) of token, or -1: its place after the last plane, followed back upwards."""
        if token >> len(self.zeros):
            return -1
        start, end = self._run(token, self.n)
        place = start + n
        if place >= end:
            return -1
        for level in reversed(range(len(self.zeros))):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            counts = self.ones[level].astype(np.int64)
            if not bit:
                counts = np.arange(len(counts)) * RANK_STEP - counts
            k = place - self.zeros[level] if bit else place
            step = int(np.searchsorted(counts, k, side="right")) - 1
            at = step * RANK_STEP
            data = self.block(level, at // BLOCK_BITS)[at % BLOCK_BITS // 8 :][: RANK_STEP // 8]
            place = at + int(np.flatnonzero(np.unpackbits(data) == bit)[k - counts[step]])
        return place


class Shard:
    """The file of one shard: a wavelet matrix, and the documents' ids and sizes."""

    def __init__(self, doc_ids: list[int | None], sizes: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.sizes, self.matrix = doc_ids, np.asarray(sizes, np.int64), matrix
        self.ends = np.cumsum(self.sizes)

    def to_bytes(self) -> bytes:
        m, pack = self.matrix, zstandard.ZstdCompressor(level=1).compress
        blocks = [pack(m.block(level, k).tobytes()) for level in range(len(m.zeros)) for k in range(-(-m.n // BLOCK_BITS))]
        head = np.array([m.n, len(m.zeros), len(self.doc_ids), m.ones.shape[1], *m.zeros], "<u8")
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        return MAGIC + b"".join([head.tobytes(), ids.tobytes(), self.sizes.astype("<i8").tobytes(), m.ones.astype("<u4").tobytes(), np.array(list(map(len, blocks)), "<u4").tobytes(), known.tobytes(), *blocks])

    @classmethod
    def from_bytes(cls, blob: bytes) -> Shard:
        """The shard with its blocks still compressed."""
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        at = 4

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(blob, kind, count, at)
            at += found.nbytes
            return found

        n, width, docs, steps = take("<u8", 4).tolist()
        zeros = take("<u8", width).tolist()
        ids, sizes, ones = take("<i8", docs).tolist(), take("<i8", docs), take("<u4", width * steps).reshape(width, steps)
        per = -(-n // BLOCK_BITS)
        packed = take("<u4", width * per)
        known = take("u1", docs)
        begins = at + np.concatenate([[0], np.cumsum(packed, dtype=np.int64)])
        inflate = zstandard.ZstdDecompressor().decompress

        def block(level: int, k: int) -> np.ndarray:
            i = level * per + k
            return np.frombuffer(inflate(blob[begins[i] : begins[i + 1]]), np.uint8)

        return cls([d if k else None for d, k in zip(ids, known.tolist())], sizes, WaveletMatrix(n, zeros, ones, block))

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, read from the blocks that hold them."""
        return self.matrix.extract(np.arange(self.ends[k] - self.sizes[k], self.ends[k]))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, tie (a hash of the text) and the bytes of its ids (two each) with END at the last; a null text has END alone."""
    file = shared_codec(docs, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(file)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.iloc[at : at + ROWS]
                ids, ends = codec.encode_all([text or "" for text in batch["text"]])
                data, ends = np.insert(ids, ends, END).tobytes(), 2 * (ends + np.arange(1, len(ends) + 1))
                own = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "tie": batch["tie"], "ids": own})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").mapInPandas(run, "doc_id bigint, tie bigint, ids binary")


def write_shards(docs: DataFrame, path: str, name: str = "wavelet_shards") -> DataFrame:
    """The settled table of shards: range, part, number in the range, tokens and blob (the file), in doc_id order.

    Ids move once, to even ranges of doc_id; rows of an id that fills several ranges are dealt to parts by their
    text's hash. A shard holds documents up to SHARD_TOKENS tokens, or one longer one.
    """
    schema = "range int, part int, number int, tokens bigint, blob binary"
    spark = docs.sparkSession
    bounds, shares = bucket_bounds(docs, "doc_id", 4 * partitions(spark))
    bounds, shares = bounds or [0], shares or [1]
    rows = encoded(docs, path).withColumn("range", bucket_of(F.col("doc_id"), bounds)).withColumn("part", tie_bucket(F.col("doc_id"), F.col("tie"), F.col("range"), bounds, shares))
    dealt = rows.repartition(partitions(spark), "range", "part").sortWithinPartitions("range", "part", "doc_id", "tie").select("range", "part", "doc_id", "ids")

    def shard(at: tuple, number: int, ids: list, parts: list[bytes]) -> pd.DataFrame:
        sizes = np.array([len(p) // 2 for p in parts])
        blob = Shard(ids, sizes, WaveletMatrix.build(np.frombuffer(b"".join(parts), np.uint16))).to_bytes()
        return pd.DataFrame({"range": [at[0]], "part": [at[1]], "number": [number], "tokens": [sizes.sum()], "blob": [blob]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, ids, parts, held = None, 0, [], [], 0
        for batch in batches:
            for *at, doc, data in zip(batch["range"], batch["part"], batch["doc_id"], batch["ids"]):
                if parts and (at != now or held + len(data) // 2 > SHARD_TOKENS):
                    yield shard(now, number, ids, parts)
                    number, ids, parts, held = number + 1 if at == now else 0, [], [], 0
                now = at
                ids.append(None if pd.isna(doc) else int(doc))
                parts.append(data)
                held += len(data) // 2
        if parts:
            yield shard(now, number, ids, parts)

    return settle(dealt.mapInPandas(run, schema), name)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards' files.

    A shard starts after the tokens of all ranges before its own and of the shards before it in its range.
    """
    sizes = shards.select("range", "part", "number", "tokens")
    ranges = sizes.groupBy("range", "part").agg(F.sum("tokens").alias("all")).select("range", "part", (F.sum("all").over(Window.orderBy("range", "part")) - F.col("all")).alias("base"))
    inner = F.sum("tokens").over(Window.partitionBy("range", "part").orderBy("number")) - F.col("tokens")
    starts = settle(sizes.withColumn("inner", inner).join(ranges, ["range", "part"]).select("range", "part", "number", (F.col("base") + F.col("inner")).alias("start")), "starts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob, start in zip(batch["blob"], batch["start"]):
                shard = Shard.from_bytes(blob)
                data = memoryview(shard.matrix.unpack().astype("<u4").tobytes())  # every document is wanted, so all planes at once
                begins = shard.ends - shard.sizes
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), shard.ends.tolist())]
                yield pd.DataFrame({"doc_id": pd.array(shard.doc_ids, "Int64"), "start": begins + start, "n_tokens": shard.sizes, "ids_crc32": sums})

    return sized_join(shards, starts, ["range", "part", "number"], "inner").select("blob", "start").mapInPandas(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


@tidied
def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, from shards written and read back.

    Repeated rows are written each, ordered by a hash of their texts; a null doc_id comes first; a null text has
    the end id alone. An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    return read_shards(write_shards(docs, path))
