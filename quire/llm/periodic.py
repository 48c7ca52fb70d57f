"""Periodic run detection over a Re-Pair grammar of a document's words.

1. A run has length 12 or more and at least twice its period, so each of its words lies in six words that
   occur in the document again. Words that do not are in no run; the stretches between them are looked at apart.
2. Re-Pair replaces the most frequent pair of neighbouring symbols by a new one until no pair occurs twice. The
   symbols left are paired up in a balanced way, so a stretch becomes a tree whose nodes are nonterminals.
3. A run lies within some nonterminal across its boundary, between its two parts. Runs across the boundary are computed
   once per nonterminal, at its first occurrence: for each period by the longest extensions of the match of
   the words beside the boundary with those a period away, found by comparing hashes of powers of two of words.
4. They are translated to all places where the nonterminal stands in the derivation. A nonterminal may cut a run off; the
   nonterminal in which the run lies whole gives the maximal one, and intervals within it that have its period go.
   Of equal intervals the one of the smallest period stays.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least length of a run, least repetitions of its period, and words that recur in any run (see 1).
LEAST, TIMES, GRAM = 12, 2, 6
#: Columns of whole numbers or nulls.
NUMBERS = ("n_runs", "start", "length", "period", "exponent_milli")
#: Rows per batch that leaves a task, and entries (a nonterminal and a period) that are looked at at a time.
ROWS, ENTRIES = 1024, 4_000_000


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    out = x * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out += y
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def stretches(h: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of the stretches of words (by their hashes) that lie in GRAM words which occur twice; LEAST words or more."""
    n = len(h)
    if n < LEAST:
        return []
    grams = h[: n - GRAM + 1]
    for i in range(1, GRAM):
        grams = _mixed(grams, h[i : n - GRAM + 1 + i])
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + GRAM, -1)
    held = np.cumsum(edge[:n]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2]) if b - a >= LEAST]


class Grammar:
    """Rules (left and right symbol, by nonterminal) and, per nonterminal, its length and where it first stands in the stretch.

    Nonterminals are numbered from the number of terminals on; a rule's symbols are older than its own. The last one derives all.
    """

    def __init__(self, terminals: int) -> None:
        self.terminals = terminals
        self.left: list[int] = []
        self.right: list[int] = []
        self.sizes = [1] * terminals

    def add(self, left: int, right: int) -> int:
        self.left.append(left)
        self.right.append(right)
        self.sizes.append(self.sizes[left] + self.sizes[right])
        return len(self.sizes) - 1


def re_pair(word: list[int], terminals: int) -> tuple[Grammar, list[int]]:
    """The grammar of a stretch, and the symbols left once no pair occurs twice. Of equally frequent pairs the older goes first, so phrases pair up evenly."""
    grammar, symbols, n = Grammar(terminals), list(word), len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in range(n - 1):
        places[symbols[i], symbols[i + 1]].append(i)
    age = {pair: k for k, pair in enumerate(places)}
    heap = [(-len(at), age[pair], pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    while heap:
        count, _, pair = heapq.heappop(heap)
        a, b = pair
        found, last = [], -1
        for i in places.get(pair, ()):
            if symbols[i] == a and i != last:
                j = after[i]
                if j < n and symbols[j] == b:
                    found.append(i)
                    last = j
        if len(found) < 2:
            places.pop(pair, None)
            continue
        if len(found) < -count:  # others took some: back in line with the right count
            places[pair] = found
            heapq.heappush(heap, (-len(found), age[pair], pair))
            continue
        del places[pair]
        new, met = grammar.add(a, b), set()
        for i in found:
            j = after[i]
            k = after[j]
            symbols[i], symbols[j] = new, -1
            after[i] = k
            if k < n:
                before[k] = i
                met.add((new, symbols[k]))
                places[new, symbols[k]].append(i)
            if (p := before[i]) >= 0:
                met.add((symbols[p], new))
                places[symbols[p], new].append(p)
        for own in sorted(met):
            at = sorted(set(places[own]))
            places[own] = at
            if len(at) > 1:
                age.setdefault(own, len(age))
                heapq.heappush(heap, (-len(at), age[own], own))
    return grammar, [s for s in symbols if s >= 0]


def tree(word: list[int], terminals: int) -> tuple[Grammar, int]:
    """The grammar with the symbols left paired up in a balanced way, and the symbol that derives the stretch."""
    grammar, rest = re_pair(word, terminals)
    while len(rest) > 1:
        paired = [grammar.add(x, y) for x, y in zip(rest[::2], rest[1::2])]
        rest = paired + rest[len(rest) - len(rest) % 2 :]
    return grammar, rest[0]


def occurrences(grammar: Grammar, top: int) -> dict[int, list[int]]:
    """Per nonterminal of LEAST words or more all places where it stands in the derivation."""
    places: dict[int, list[int]] = {top: [0]} if grammar.sizes[top] >= LEAST else {}
    terminals, sizes = grammar.terminals, grammar.sizes
    for x in range(len(sizes) - 1, terminals - 1, -1):
        if at := places.get(x):
            left, right = grammar.left[x - terminals], grammar.right[x - terminals]
            if sizes[left] >= LEAST:
                places.setdefault(left, []).extend(at)
            if sizes[right] >= LEAST:
                width = sizes[left]
                places.setdefault(right, []).extend([i + width for i in at])
    return places


class Matches:
    """Longest common extensions of places in a row of word hashes, by hashes of powers of two of words."""

    def __init__(self, h: np.ndarray) -> None:
        self.levels = [h]
        while 2 << len(self.levels) <= 2 * len(h):
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            if len(below) <= half:
                break
            self.levels.append(_mixed(below[:-half], below[half:]))

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on, at most so many."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            h, step = self.levels[k], 1 << k
            fits = done + step <= most
            a, b = np.where(fits, i + done, 0), np.where(fits, j + done, 0)
            done += np.where(fits & (h[a] == h[b]), step, 0)
        return done

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree before i and j, at most so many."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            h, step = self.levels[k], 1 << k
            fits = done + step <= most
            a, b = np.where(fits, i - done - step, 0), np.where(fits, j - done - step, 0)
            done += np.where(fits & (h[a] == h[b]), step, 0)
        return done


def crossing(h: np.ndarray, first: np.ndarray, left: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs across the boundaries of nonterminals: their number in the lists, start within it, length and period.

    first, left and size: where each first stands in h, the words of its left part, and all its words. For a period q the q words
    before the boundary are held to those after it (and the other way round); a repetition needs q matches in a row
    around there, so three next to the boundary on one side, by which most periods are dismissed.
    """
    found = []
    threes = np.concatenate([_mixed(_mixed(h[:-2], h[1:-1]), h[2:]), np.zeros(2, np.uint64)])
    matches = Matches(h)
    cost = np.maximum(left, size - left)
    cuts = np.searchsorted(np.cumsum(cost), np.arange(ENTRIES, int(cost.sum()) + ENTRIES, ENTRIES)) + 1
    for lo, hi in zip([0, *np.minimum(cuts, len(size))], [*np.minimum(cuts, len(size)), len(size)]):
        for forward in (False, True):
            part = slice(int(lo), int(hi))
            start, border, end = first[part], first[part] + left[part], first[part] + size[part]
            # a period fits once on its own side, and twice into the whole
            most = np.minimum((size - left)[part] if forward else left[part], size[part] // TIMES)
            node = np.repeat(np.arange(lo, hi), most)
            if not len(node):
                continue
            q = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
            own = node - lo
            i, j = (border[own], border[own] + q) if forward else (border[own] - q, border[own])
            ahead = (j + 3 <= end[own]) & (threes[i] == threes[np.minimum(j, len(h) - 1)])
            behind = (i - 3 >= start[own]) & (threes[np.maximum(i - 3, 0)] == threes[np.maximum(j - 3, 0)])
            keep = ahead | behind
            node, own, q, i, j = node[keep], own[keep], q[keep], i[keep], j[keep]
            on = matches.forward(i, j, end[own] - j)
            back = matches.backward(i, j, i - start[own])
            length = on + back + q
            good = (on + back >= q) & (length >= LEAST)
            found.append((node[good], (i - back - start[own])[good], length[good], q[good]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found))


def merged(intervals: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) by start, then period, from repetitions (period, start, end), some of which are parts of others."""
    widest: dict[tuple[int, int], int] = {}
    period, reach = 0, -1
    for q, start, end in sorted(set(intervals), key=lambda x: (x[0], x[1], -x[2])):
        if q != period or end > reach:
            period, reach = q, end
            widest.setdefault((start, end), q)  # periods ascend
    return sorted((start, end - start, q) for (start, end), q in widest.items())


def runs_of(h: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of word hashes, all found together."""
    grammars, flat, base = [], [], 0
    for k, own in enumerate(h):
        for a, b in stretches(own):
            _, word = np.unique(own[a:b], return_inverse=True)
            grammar, top = tree(word.tolist(), int(word.max()) + 1)
            grammars.append((k, a, base, grammar, occurrences(grammar, top)))
            flat.append(own[a:b])
            base += b - a
    out: list[list[tuple[int, int, int]]] = [[] for _ in h]
    if not grammars:
        return out
    nodes = [(g, x) for g, (_, _, _, _, places) in enumerate(grammars) for x in places]
    first = np.array([grammars[g][2] + grammars[g][4][x][0] for g, x in nodes], np.int64)
    left = np.array([grammars[g][3].sizes[grammars[g][3].left[x - grammars[g][3].terminals]] for g, x in nodes], np.int64)
    size = np.array([grammars[g][3].sizes[x] for g, x in nodes], np.int64)
    for node, start, length, q in zip(*(x.tolist() for x in crossing(np.concatenate(flat), first, left, size))):
        g, x = nodes[node]
        k, a, _, _, places = grammars[g]
        out[k].extend((q, a + at + start, a + at + start + length) for at in places[x])
    return [merged(x) for x in out]


def words_of(text: str | None, doc_id: str | None) -> list[bytes]:
    """The words of a text; where ten divides the checksum of doc_id, those from some place on repeat with some period."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at the blank and \\x09-\\x0d alone
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: all but those after the first period of a run."""
    if not runs:
        return words
    gone = bytearray(len(words))
    for start, length, q in runs:
        gone[start + q : start + length] = b"\1" * (length - q)
    return [w for w, g in zip(words, gone) if not g]


def found(docs: DataFrame, result, schema: str) -> DataFrame:
    """result(doc_id as text, words, runs) of each row; texts stay where they are, no row moves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.iloc[at : at + ROWS]
                words = [words_of(t, d) for t, d in zip(batch["text"], batch["doc_id"])]
                runs = runs_of([hashes(w) for w in words])
                out = pd.DataFrame([result(*x) for x in zip(batch["doc_id"], words, runs)])
                yield out.astype({c: "Int64" for c in out.columns if c in NUMBERS})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id and runs (start, length, period, by start, then period) of every row.

    Null and empty texts have none; a null doc_id changes no words (see words_of); repeated rows each get their own; any
    length of text is looked at whole; an empty table gives an empty result; other columns are ignored.
    """
    schema = "doc_id string, runs array<struct<start: bigint, length: bigint, period: bigint>>"
    of = lambda doc, words, runs: {"doc_id": doc, "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs]}
    return found(docs, of, schema).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: least start, then period), runs_sha256, collapsed_sha256.

    Rows and cases as in periodic_runs; without a run the four numbers of the longest are null and the digests those of
    an empty list and of all words.
    """
    schema = "doc_id string, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"

    def of(doc: str | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
        start, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        return {
            "doc_id": doc, "n_runs": len(runs), "start": start, "length": length, "period": q, "exponent_milli": 1000 * length // q if runs else None,
            "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(b" ".join(kept(words, runs))).hexdigest(),
        }

    return found(docs, of, schema).withColumn("doc_id", F.col("doc_id").cast("bigint"))
