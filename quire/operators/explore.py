"""Queries across documents: type summaries, grouped retrieval, project scopes, taxonomies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: Name of the group of sections without a type.
UNTAGGED = "__untagged__"


def unset(c: Column) -> Column:
    return c.isNull() | (c == "")


def in_documents(rows: DataFrame, documents: DataFrame | None) -> DataFrame:
    """Rows of the given documents; None is no filter, an empty table matches nothing."""
    return rows if documents is None else rows.join(documents.select("doc"), "doc", "left_semi")


def type_summary(sections: DataFrame, types: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """type_name, sections: every type with its number, 0 where none; untagged sections as a group of their own if any.

    Null and empty types are counted together.
    """
    counts = in_documents(sections, documents).groupBy(F.coalesce(F.nullif("section_type", F.lit("")), F.lit(UNTAGGED)).alias("type_name")).agg(F.count("*").alias("sections"))
    known = types.select("type_name").join(counts, "type_name", "left").na.fill(0, ["sections"])
    return known.unionByName(counts.filter(F.col("type_name") == UNTAGGED))


def sections_by_type(sections: DataFrame, titles: DataFrame, wanted: str, documents: DataFrame | None = None) -> DataFrame:
    """doc, title, sections: per document its sections of a type in order; a missing title falls back to the key."""
    hit = unset(F.col("section_type")) if wanted == UNTAGGED else F.col("section_type") == wanted
    rows = in_documents(sections.filter(hit), documents).join(titles, "doc", "left")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("lft", "id"))), lambda x: x["id"]).alias("sections")
    return rows.groupBy("doc", F.coalesce("title", F.col("doc").cast("string")).alias("title")).agg(listed)


def search(sections: DataFrame, words: str) -> DataFrame:
    """Sections whose title or path holds the words, in any case."""
    w = F.lower(F.lit(words))
    return sections.filter(F.contains(F.lower("title"), w) | F.contains(F.lower("path"), w))


def merged_types(types: DataFrame) -> DataFrame:
    """type_name, canonical: of types with one normalised label, the first by creation not named t_..., else the first."""
    form = T.label_form(F.col("label"))
    rank = F.struct(F.col("type_name").startswith("t_"), "creation", "type_name")
    first = types.groupBy(form.alias("form")).agg(F.min_by("type_name", rank).alias("canonical"))
    return types.select("type_name", form.alias("form")).join(first, "form").select("type_name", "canonical")


def retyped(sections: DataFrame, merged: DataFrame) -> DataFrame:
    """Sections pointed to the canonical types."""
    return sections.join(merged.withColumnRenamed("type_name", "section_type"), "section_type", "left").withColumn("section_type", F.coalesce("canonical", "section_type")).drop("canonical")


def missing(rows: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """rows and those seeds whose keys they lack."""
    return rows.unionByName(seeds.join(rows.select(*keys), keys, "left_anti"))
