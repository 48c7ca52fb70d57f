"""The registered queries of this subpackage, each an operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, html_tree, manifest, merkle, mixing, ngrams, periodic, pivots, pseudonyms, quality, shards, small_world, wavelet
from quire.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_neighbours(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op7_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), pseudonyms.session_key(spark))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE, with_ids=False)


def op10_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


def op12_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_world.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_merkle, op2_mixing, op3_pivots, op4_html, op5_quality, op6_shards, op7_ngrams, op8_pseudonyms, op9_bpe, op10_wavelet, op11_periodic, op12_small_world, op13_manifest)}

#: Levels that the SQL of op13 climbs: trees of up to 16^6 leaves, and 16^3 sources.
_LEVELS, _TOP_LEVELS = 6, 3


def _climbed(name: str, leaves: str, levels: int) -> str:
    """Runs of the levels of a forest (tree, pos, d): name_rK has each run's digests, name_nK the nodes above."""
    out, below = "", leaves
    for k in range(levels):
        out += f"""
        {name}_r{k} AS MATERIALIZED (SELECT tree, pos // 16 AS run, list(d ORDER BY pos) AS ds FROM {below} WHERE tree IN (SELECT tree FROM {below} GROUP BY tree HAVING count(*) > 1) GROUP BY 1, 2),
        {name}_n{k} AS MATERIALIZED (SELECT tree, run AS pos, sha256(array_to_string(ds, '')) AS d FROM {name}_r{k} UNION ALL SELECT tree, pos, d FROM {below} WHERE tree NOT IN (SELECT tree FROM {name}_r{k})),"""
        below = f"{name}_n{k}"
    return out


def _folded(name: str, start: str, runs: str, levels: int) -> str:
    """Rows of start (tree, pos, d, proof and others) after each level's siblings."""
    out, below = "", start
    for k in range(levels):
        at = "r.ds[:f.pos % 16] || [{}] || r.ds[f.pos % 16 + 2:]"
        out += f"""
        {name}{k} AS (SELECT f.* REPLACE (f.pos // 16 AS pos, CASE WHEN r.ds IS NULL THEN f.d ELSE sha256(array_to_string({at.format("f.d")}, '')) END AS d,
          CASE WHEN r.ds IS NULL THEN f.proof ELSE f.proof || array_to_string(r.ds[:f.pos % 16] || r.ds[f.pos % 16 + 2:], '') END AS proof)
          FROM {below} f LEFT JOIN {runs}_r{k} r ON r.tree = f.tree AND r.run = f.pos // 16),"""
        below = f"{name}{k}"
    return out


def _part(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


_HEAD = " || ".join(map(_part, ("doc_id", "source", "lang", "n_chars")))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13_SQL = f"""
        WITH RECURSIVE bits AS (SELECT i, i AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
        crc AS (SELECT list(v::BIGINT ORDER BY i) AS t FROM bits WHERE k = 8),
        told AS (
          SELECT doc_id, coalesce('s' || source, '') AS tree, sha256({_HEAD} || {_part("text")}) AS leaf, sha256({_HEAD} || {_part(_LOWER)}) AS changed,
            xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT)) % 5 = 0 AS picked
          FROM documents, crc),
        leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS d FROM told),{_climbed("s", "leaves", _LEVELS)}
        subroots AS MATERIALIZED (SELECT tree AS name, d, row_number() OVER (ORDER BY tree) - 1 AS pos, '' AS tree FROM s_n{_LEVELS - 1}),{_climbed("t", "subroots", _TOP_LEVELS)}
        start AS (SELECT doc_id, tree, pos, leaf, CASE WHEN picked THEN changed ELSE leaf END AS d, '' AS proof FROM leaves),{_folded("f", "start", "s", _LEVELS)}
        joined AS (SELECT f.doc_id, f.leaf, f.d, f.proof, s.d AS subroot, s.pos, s.tree FROM f{_LEVELS - 1} f JOIN subroots s ON s.name = f.tree),{_folded("g", "joined", "t", _TOP_LEVELS)}
        top AS (SELECT d AS root FROM t_n{_TOP_LEVELS - 1})
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified FROM g{_TOP_LEVELS - 1}, top"""

ORACLES: dict[str, str] = {
    "op12_small_world": """
        WITH RECURSIVE v AS (
          SELECT row_number() OVER () AS at, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
            len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound
          FROM embeddings),
        links AS (
          SELECT a.at AS x, b.at AS y FROM v a JOIN v b ON a.at <> b.at AND len(a.v) = len(b.v)
          WHERE a.sound AND b.sound AND list_cosine_similarity(a.v, b.v) >= 0.95),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
        n AS (SELECT x, count(*) AS n FROM links GROUP BY x),
        c AS (SELECT x, min(v.vec_id) AS id FROM reach JOIN v ON v.at = y GROUP BY x)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(c.id, vec_id), vec_id) AS component_id, coalesce(least(c.id, vec_id), vec_id) IS NOT DISTINCT FROM vec_id AS kept
        FROM v LEFT JOIN n ON n.x = v.at LEFT JOIN c ON c.x = v.at""",
    "op13_manifest": OP13_SQL,
    "op3_pivots": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op7_ngrams": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS c FROM w),
        g AS (SELECT doc_id, i, c, concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o) AS s FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        u AS (SELECT DISTINCT doc_id, s FROM g WHERE i = 0 OR i <= c - 4),
        n AS (SELECT w.doc_id, count(u.s) AS n FROM w LEFT JOIN u ON u.doc_id = w.doc_id GROUP BY w.doc_id),
        links AS (
          SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.s = b.s JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
        SELECT n.doc_id, n.n AS n_shingles, coalesce(min(r.y), n.doc_id) AS component_id
        FROM n LEFT JOIN reach r ON r.x = n.doc_id GROUP BY n.doc_id, n.n""",
}
