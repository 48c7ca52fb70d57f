"""A training corpus from documents: filter, deduplicate, pseudonymise, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the
shared folder and hands the reread table to the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, mixing, ngrams, pseudonyms, quality
from quire.llm.common import settle, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is trained on labelled rows of docs."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more."""
    return ngrams.one_per_group(docs, n=5, percent=80)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms of their format."""
    return pseudonyms.pseudonymised(docs, pseudonyms.session_key(spark)).drop("n_pseudonyms")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, and digests of the ids and of the decoded text."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"))


STAGES = [("quality_filter", quality_filter), ("near_duplicates", near_duplicates), ("pseudonymise", pseudonymise), ("mix_sources", mix_sources), ("encode", encode)]

#: The classifier, the Feistel network and the dual cannot be stated in SQL; tests hold them to plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
