"""BPE encoding and decoding by forced-boundary splitting.

A merge yields a vocabulary token, so two neighbouring bytes that stand side by side in no vocabulary
token can never end up in one token: between them lies a certain cut. Each word is cut there, the
fragments are encoded independently (and remembered), and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import WhitespaceSplit

#: Words and fragments that a worker remembers, so that memory stays bounded on any corpus.
REMEMBERED = 100_000

#: Rows encoded at a time: ids, digests and what they are made from are held together, by two workers or more beside a JVM.
ROWS = 256


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


def offsets_end(binary: pa.Array) -> int:
    """Bytes that the values of an unsliced large binary array take."""
    return int(np.frombuffer(binary.buffers()[1], np.int64, len(binary) + 1)[-1])


class Codec:
    """Encoder and decoder for a tokenizer file with the normalizer below, a Split pattern, byte letters and a word-end mark."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        spec = json.loads(file)
        model = spec["model"]
        steps = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if steps != [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]:
            raise ValueError(f"only texts normalised by NFC, single blanks and lower case can be encoded, not by {steps}")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if max([*self.vocab.values(), *self.special.values()], default=0) >= 1 << 16:
            raise ValueError("ids must fit in two bytes")
        if not self.end:
            raise ValueError("words must carry a word-end mark")
        token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        known = range(max(token, default=-1) + 1)
        # what an id adds to a text of ids and to a decoded one; the file names no decoder, so tokens are joined by one blank
        self.decimal, self.token = pa.array([f"{i} " for i in known], pa.large_binary()), pa.array([f"{token.get(i, '')} ".encode() for i in known], pa.large_binary())
        self.letters = {b: letter for b, letter in byte_letters().items() if b != 32}  # blanks part words
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.controls = regex.compile(r"[\x1c-\x1f]")  # white space to str.split alone
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.inside = {p for t in self.vocab for bare in [t[: -len(self.end)] if t.endswith(self.end) else t] for p in zip(bare, bare[1:])}
        self.joined = Tokenizer(BPE(self.vocab, merges, cache_capacity=0, end_of_word_suffix=self.end))
        self.joined.pre_tokenizer = WhitespaceSplit()
        self.middles = Tokenizer(BPE(self.vocab, merges, cache_capacity=0))
        self.is_end = np.zeros(1 << 16, bool)
        self.is_end[[i for t, i in self.vocab.items() if t.endswith(self.end)]] = True
        # byte pairs that some token holds, and those at a blank between words
        self.together = np.zeros(1 << 16, bool)
        byte = {letter: b for b, letter in byte_letters().items()}
        self.together[[byte[a] << 8 | byte[b] for a, b in self.inside]] = True
        self.together[[32 << 8 | b for b in range(256)]] = self.together[[b << 8 | 32 for b in range(256)]] = True
        self.ends_unit = self._ends_unit()
        self.unit: dict[str, bytes] = {"": b""}
        self.middle: dict[str, bytes] = {}

    @staticmethod
    def _ends_unit() -> np.ndarray:
        """Byte pairs between which the Split pattern always parts words: where letters, digits and symbols of ASCII meet.

        A quote before a letter is left to the pattern, which has contractions; so are bytes beyond ASCII.
        """
        kind = np.zeros(256, np.int64)  # 0 beyond ASCII or blank
        kind[:128] = 1
        kind[9:14] = kind[32] = 0
        kind[97:123], kind[65:91], kind[48:58] = 2, 2, 3
        a, b = np.meshgrid(kind, kind, indexing="ij")
        cut = (a > 0) & (b > 0) & ((a != b) | (a == 3))
        cut[ord("'")][kind == 2] = False
        return cut.reshape(-1)

    def fragments(self, letters: str) -> list[str]:
        """letters cut at every certain boundary."""
        cuts = [i for i, pair in enumerate(zip(letters, letters[1:]), 1) if pair not in self.inside]
        return [letters[i:j] for i, j in zip([0, *cuts], [*cuts, len(letters)])]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word. All byte pairs are looked up at once, and words are cut at every certain boundary.

        Last fragments, which carry the word end, go through the merges in one text; their ids part where a
        token carries the word end. The other fragments are encoded in one call and remembered.
        """
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        if not len(data):
            return []
        letters = data.tobytes().decode("latin-1").translate(self.letters)
        cuts = np.flatnonzero(~self.together[data[:-1].astype(np.uint16) << 8 | data[1:]]) + 1
        if not len(cuts):
            return self._parted(letters)
        blanks = np.flatnonzero(data == 32)
        owner = np.searchsorted(blanks, cuts)
        begins = np.concatenate([[0], blanks + 1])
        first = np.ones(len(cuts), bool)  # of its word
        first[1:] = owner[1:] != owner[:-1]
        starts = np.where(first, begins[owner], np.concatenate([[0], cuts[:-1]]))
        middles = [letters[i:j] for i, j in zip(starts.tolist(), cuts.tolist())]
        new = list(set(middles).difference(self.middle))
        if len(self.middle) + len(new) > REMEMBERED:
            self.middle, new = {}, list(set(middles))
        for f, e in zip(new, self.middles.encode_batch_fast(new, add_special_tokens=False)):
            self.middle[f] = array("H", e.ids).tobytes()
        begins[owner] = cuts  # the last of equal owners stays
        ends = np.concatenate([blanks, [len(data)]])
        out = self._parted(" ".join([letters[i:j] for i, j in zip(begins.tolist(), ends.tolist())]))
        heads: dict[int, bytes] = {}
        of = self.middle.__getitem__
        for k, f in zip(owner.tolist(), middles):
            heads[k] = heads[k] + of(f) if k in heads else of(f)
        for k, head in heads.items():
            out[k] = head + out[k]
        return out

    def _parted(self, letters: str) -> list[bytes]:
        ids = np.array(self.joined.encode_batch_fast([letters], add_special_tokens=False)[0].ids, np.uint16)
        data, ends = ids.tobytes(), [0, *(2 * np.flatnonzero(self.is_end[ids]) + 2).tolist()]
        return [data[i:j] for i, j in zip(ends, ends[1:])]

    def learn(self, units: list[str]) -> None:
        """Encodes units, each one word or more without a white space. Those of letters or of ASCII symbols alone are one word."""
        known = self.unit
        plain = [u for u in units if u.isalpha() or u.isascii() and not u[-1:].isalpha()]
        known.update(zip(plain, self.encode_words(plain)))
        other = [u for u in units if u not in known]
        words = list(map(self.words.findall, other))
        distinct = list(set(chain.from_iterable(words)))
        of = dict(zip(distinct, self.encode_words(distinct))).__getitem__
        known.update((u, b"".join(map(of, ws))) for u, ws in zip(other, words))

    def normalised(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return " ".join(self.spaces.split(text)).strip(" ") if self.controls.search(text) else " ".join(text.split())

    def _segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, none of which holds a special token, and the place where each ends."""
        data = np.frombuffer(("\n".join(map(self.normalised, texts)) + "\n").encode(), np.uint8)
        data = np.insert(data, np.flatnonzero(self.ends_unit[data[:-1].astype(np.uint16) << 8 | data[1:]]) + 1, 32)
        at = np.flatnonzero((data == 32) | (data == 10))
        last = np.flatnonzero(data[at] == 10)
        data = np.where(data == 10, np.uint8(32), data)
        offsets = np.zeros(len(at) + 1, np.int64)
        offsets[1:] = at + 1
        units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = memoryview(units.dictionary.buffers()[2]).tobytes()[: offsets_end(units.dictionary)].decode().split(" ")[:-1]
        new = [u for u in distinct if u not in self.unit]
        if len(self.unit) + len(new) > REMEMBERED:
            self.unit = {"": b""} | {u: self.unit[u] for u in distinct if u in self.unit}  # those that recur stay, so they are not learnt again
        self.learn(new)
        ids = pa.array(map(self.unit.__getitem__, distinct), pa.large_binary()).take(units.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
        return np.frombuffer(ids.buffers()[2], np.uint16, ends[-1] // 2) if ends[-1] else np.zeros(0, np.uint16), ends[last + 1] // 2

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the place where each text's end."""
        if not texts:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        if not self.marks or not any("<" in t and self.marks.search(t) for t in texts):
            return self._segments(texts)
        pieces, marks, owner = [], [], []  # a text's pieces, each but the last followed by a mark
        for k, text in enumerate(texts):
            at = 0
            for m in self.marks.finditer(text):
                pieces.append(text[at : m.start()])
                marks.append([self.special[m.group()]])
                owner.append(k)
                at = m.end()
            pieces.append(text[at:])
            marks.append([])
            owner.append(k)
        ids, ends = self._segments(pieces)
        parts = np.split(ids, ends[:-1])
        whole = np.concatenate([x for part, mark in zip(parts, marks) for x in (part, np.array(mark, np.uint16))])
        size = np.bincount(owner, weights=[len(p) + len(m) for p, m in zip(parts, marks)], minlength=len(texts)).astype(np.int64)
        return whole, np.cumsum(size)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, two bytes each in the machine's order."""
        ids, ends = self.encode_all(texts)
        data = ids.tobytes()
        return [data[2 * a : 2 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    @staticmethod
    def digests(written: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """SHA-256 of each text's ids as written, each with a blank after it but for the last."""
        text = written.take(pa.array(ids))
        at = np.frombuffer(text.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        data = memoryview(text.buffers()[2] or b"") if len(ids) else memoryview(b"")
        starts = np.concatenate([[0], ends[:-1]])
        return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[starts].tolist(), at[ends].tolist())]


def shared_codec(df: DataFrame, path: str):
    """The tokenizer file as a broadcast (a few MB, whatever the corpus), so executors need no copy of it."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


_codecs: dict[int, Codec] = {}


def codec_of(file) -> Codec:
    """One codec per worker process and tokenizer file."""
    key = hash(file.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(file.value)
    return _codecs[key]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Per row: the kept columns, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids array<int>.

    A null text counts as empty: no tokens and the digests of the empty string. Repeated rows are
    encoded each. Columns named like the results are dropped in favour of the results.
    """
    file = shared_codec(docs, path)
    names = [k for k in keep if k not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "text")]
    src = docs.select(*names, "text")
    fields = [f.simpleString().replace(":", " ", 1) for f in src.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.split(' ', 1)[0]}` {f.split(' ', 1)[1]}" for f in fields) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(file)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.iloc[at : at + ROWS]
                ids, ends = codec.encode_all([t or "" for t in batch["text"]])
                n = np.diff(ends, prepend=0)
                out = batch.drop(columns="text").assign(n_tokens=n, ids_sha256=codec.digests(codec.decimal, ids, ends), decoded_sha256=codec.digests(codec.token, ids, ends))
                yield out.assign(ids=np.split(ids.astype(np.int32), ends[:-1])) if with_ids and len(out) else out.assign(ids=[]) if with_ids else out

    return src.mapInPandas(run, schema)


def count(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens added, for callers that need sizes alone."""
    return encode(docs, path, keep=tuple(docs.columns), with_ids=False).drop("ids_sha256", "decoded_sha256").withColumn("n_tokens", F.col("n_tokens"))
