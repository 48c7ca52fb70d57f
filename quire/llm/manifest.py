"""Merkle dataset manifest: a tree of rows per source, a tree over the sources, and a proof for every row.

A row's leaf is the digest of its columns. The leaves of a source, in order of doc_id, are appended to a tree
of fan-out FANOUT: each leaf gets a witness that is partial while the runs of nodes above it are open, and that
the completion of each later run extends (`Appender`). Blocks of BLOCK leaves are appended to in parallel; a
block's root is a further append, to a block of block roots, and so on until one root a source is left; the
sources' roots are appended to one last tree in the same way. Witnesses then run down again: a block's witness
goes on every witness within the block.

Digests are SHA-256; a node's input is its children's digests as lowercase hex text, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import partitions, settle, sized_join, tidied

#: Nodes that one node takes; levels of a block; nodes of a full block.
FANOUT, LEVELS = 16, 2
BLOCK = FANOUT**LEVELS
#: Rows per batch that leaves a task.
ROWS = 1024

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(children: bytes) -> bytes:
    """Digest of a node from its children's digests, 32 bytes each."""
    return hashlib.sha256(children.hex().encode()).digest()


class Appender:
    """A tree that digests are appended to, in order, and the witness of each.

    open holds per level the run that is not full: digests, each with the witnesses of what was appended under it.
    A witness is a list of steps, lowest first: the place of the node in its run and its siblings' digests.
    """

    def __init__(self) -> None:
        self.open: list[list[tuple[bytes, list[list]]]] = []

    def append(self, digest: bytes) -> list[tuple[int, bytes]]:
        """The witness of the digest, which later appends and close() extend."""
        witness: list[tuple[int, bytes]] = []
        self._add(0, digest, [witness])
        return witness

    def _add(self, level: int, digest: bytes, below: list[list]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((digest, below))
        if len(self.open[level]) == FANOUT:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _ in run]
        for at, (_, below) in enumerate(run):
            step = (at, b"".join(digests[:at] + digests[at + 1 :]))
            for witness in below:
                witness.append(step)
        self._add(level + 1, digest_of(b"".join(digests)), [w for _, below in run for w in below])

    def close(self, levels: int = 0) -> bytes:
        """The root, once all open runs are completed: that of a single node, but at least so many levels up."""
        level = 0
        while True:
            run = self.open[level]
            if len(run) == 1 and level >= levels and not any(self.open[level + 1 :]):
                return run[0][0]
            if run:
                self._complete(level)
            level += 1


def folded(digest: bytes, witness: list[tuple[int, bytes]]) -> bytes:
    """The root that a digest and a witness give."""
    for at, siblings in witness:
        digest = digest_of(siblings[: 32 * at] + digest + siblings[32 * at :])
    return digest


def leaf(*columns: Column) -> Column:
    """Digest of columns: each is -, or its length in UTF-8 bytes, a colon and its value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(part, columns)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, name (the id as text), tree (its source: null gives an empty text, others a letter before), leaf, changed (the tampered row's leaf), salt (which tells equal rows apart).

    Rows where 5 divides the checksum of doc_id are tampered with: letters A-Z of their text lower-cased. A null id is none of these.
    """
    c = [F.col(x) for x in COLUMNS]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("string").alias("name"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("tree"),
        leaf(*c).alias("leaf"), F.when(picked, leaf(*c[:4], F.translate("text", upper, upper.lower()))).alias("changed"), F.monotonically_increasing_id().alias("salt"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, their place in their tree by order (from 0), and total, the rows of the tree.

    Rows are range-partitioned by tree and order, so a large tree fills many partitions; a partition's places follow
    from the counts of those before it: one row per tree and partition that it reaches into.
    """
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    ordered = settle(ranged.withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("at", 33))
    sizes = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = settle(sizes.select("tree", "part", "first", before.alias("before"), F.sum("n").over(own).alias("total")), "starts", narrow=True)
    found = sized_join(ordered, starts, ["tree", "part"], "inner")
    return found.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def in_blocks(rows: DataFrame, *then: str) -> DataFrame:
    """rows dealt by block of their tree, each block's in order."""
    blocks = rows.withColumn("block", F.floor(F.col("pos") / BLOCK))
    return blocks.repartition(partitions(rows.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", *then, "pos")


def _rise(total: int) -> int:
    """Levels that a block of a tree rises at least: all, if the tree has further blocks."""
    return LEVELS if total > BLOCK else 0


def raised(nodes: DataFrame) -> DataFrame:
    """tree, pos, digest and total of the block roots of nodes (the same columns), which are nodes of the next round."""
    schema = "tree string, pos bigint, digest binary, total bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, block, rise, rows = None, Appender(), 0, []
        for batch in batches:
            for tree, at, digest, total in zip(batch["tree"], batch["block"], batch["digest"], batch["total"]):
                if (tree, at) != now:
                    if now is not None:
                        rows.append((*now, block.close(rise), blocks))
                    now, block, rise, blocks = (tree, at), Appender(), _rise(total), -(-total // BLOCK)
                block.append(digest)
            yield pd.DataFrame(rows, columns=["tree", "pos", "digest", "total"])
            rows = []
        if now is not None:
            yield pd.DataFrame([(*now, block.close(rise), blocks)], columns=["tree", "pos", "digest", "total"])

    return settle(in_blocks(nodes).select("tree", "block", "digest", "total").mapInPandas(run, schema), "raised", narrow=True)


WITNESS = "array<struct<at: int, siblings: binary>>"


def witnessed(nodes: DataFrame, upper: DataFrame, result, schema: str, *columns: str) -> DataFrame:
    """result(row, witness, block's row) of each node, where row has columns and digest, and witness leads to the root.

    upper has a row for each block: tree, pos, witness (from its root on) and any other columns that result reads. A block's
    row passes before its nodes, so a task holds one block at a time.
    """
    more = [c for c in upper.columns if c not in ("tree", "pos", "witness")]
    own = nodes.withColumn("side", F.lit(1)).withColumn("witness", F.lit(None).cast(WITNESS))
    heads = upper.withColumn("pos", F.col("pos") * BLOCK).withColumn("side", F.lit(0))
    both = heads.unionByName(own, allowMissingColumns=True)
    names = ["side", "digest", "total", "witness", *columns, *more]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, block, held, rise, out = None, Appender(), [], 0, []

        def closed() -> None:
            if held:
                block.close(rise)
                above = [(s["at"], s["siblings"]) for s in head["witness"]]
                out.extend(result(row, witness + above, head) for row, witness in held)

        for batch in batches:
            for values in zip(*(batch[c] for c in names)):
                row = dict(zip(names, values))
                if row["side"] == 0:
                    closed()
                    head, block, held = row, Appender(), []
                else:
                    rise = _rise(row["total"])
                    held.append((row, block.append(row["digest"])))
            for i in range(0, len(out), ROWS):
                yield pd.DataFrame(out[i : i + ROWS])
            out.clear()
        closed()
        for i in range(0, len(out), ROWS):
            yield pd.DataFrame(out[i : i + ROWS])

    return in_blocks(both, "side").select(*names).mapInPandas(run, schema)


def climbed(nodes: DataFrame, most: int) -> list[DataFrame]:
    """nodes, their block roots, the roots of blocks of these, and so on, to one a tree; most: nodes of the largest tree."""
    rounds = [nodes]
    while most > 1:
        rounds.append(raised(rounds[-1]))
        most = -(-most // BLOCK)
    return rounds


def descended(rounds: list[DataFrame], top: DataFrame, more: list[str]) -> DataFrame:
    """witness (and more, columns of top) of the blocks of rounds[0], from those of the trees' roots."""
    types = dict(top.dtypes)
    schema = f"tree string, pos bigint, witness {WITNESS}" + "".join(f", {c} {types[c]}" for c in more)
    for nodes in reversed(rounds[1:-1]):

        def passed(row: dict, witness: list, head: dict) -> dict:
            return {"tree": row["tree"], "pos": row["pos"], "witness": [{"at": a, "siblings": s} for a, s in witness], **{c: head[c] for c in more}}

        top = settle(witnessed(nodes, top, passed, schema, "tree", "pos"), "witnesses", narrow=True)
    return top


def _most(rows: DataFrame) -> int:
    return rows.agg(F.max("total")).first()[0] or 0


def proven(docs: DataFrame, result, schema: str) -> DataFrame:
    """result(row, witness, block's row) of every row of docs: row has name (the id as text), digest (the leaf) and changed, the block's row subroot and root."""
    told = settle(leaves(docs), "leaves")
    nodes = placed(told, ["doc_id", "leaf", "salt"]).withColumnRenamed("leaf", "digest").drop("salt")
    sources = climbed(nodes.select("tree", "pos", "digest", "total"), _most(nodes))
    roots = sources[-1].select(F.col("tree").alias("name"), "digest")
    tops = placed(roots.withColumn("tree", F.lit("")), ["name"])
    overall = climbed(tops.select("tree", "pos", "digest", "total"), _most(tops))
    last = overall[-1].select("tree", F.lit(0).cast("bigint").alias("pos"), F.array().cast(WITNESS).alias("witness"), F.col("digest").alias("root"))

    def passed(row: dict, witness: list, head: dict) -> dict:
        return {"tree": row["name"], "pos": 0, "witness": [{"at": a, "siblings": s} for a, s in witness], "subroot": row["digest"], "root": head["root"]}

    upper = f"tree string, pos bigint, witness {WITNESS}, subroot binary, root binary"
    heads = settle(witnessed(tops, descended(overall, last, ["root"]), passed, upper, "name"), "subroots", narrow=True)
    found = witnessed(nodes, descended(sources, heads, ["subroot", "root"]), result, schema, "name", "changed")
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@tidied
def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of docs, digests as hex.

    proof_sha256 is over the siblings on the way to the root. folded_root follows from the (for some rows tampered) leaf
    and these siblings; verified says that it is the root. Rows of equal doc_id stand in the order of their leaves; a null
    doc_id comes first and is not tampered with; a null source is the first source, an empty one the next. An empty table
    gives an empty result. Texts are hashed whole, of any length; other columns are ignored.
    """

    def result(row: dict, witness: list, head: dict) -> dict:
        changed = row["changed"] if row["changed"] is not None else row["digest"]
        found = folded(changed, witness)
        proof = hashlib.sha256(b"".join([s for _, s in witness]).hex().encode()).hexdigest()
        return {
            "doc_id": row["name"], "leaf": row["digest"].hex(), "subroot": head["subroot"].hex(), "root": head["root"].hex(),
            "proof_sha256": proof, "folded_root": found.hex(), "verified": found == head["root"],
        }

    return proven(docs, result, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


@tidied
def witnesses(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, root and witness (place in the run and siblings' digests, leaf first) of every row, for holders of single rows to verify."""

    def result(row: dict, witness: list, head: dict) -> dict:
        return {"doc_id": row["name"], "leaf": row["digest"], "root": head["root"], "witness": [{"at": a, "siblings": s} for a, s in witness]}

    return proven(docs, result, f"doc_id string, leaf binary, root binary, witness {WITNESS}")
