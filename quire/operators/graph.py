"""Property graphs of documents: nodes, edges, weights, degrees and legends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_weights(edges: DataFrame) -> DataFrame:
    """doc, from_id, to_id, weight (null occurrences count one) and the sorted anchors of each pair of sections."""
    weight = F.sum(F.coalesce("occurrences", F.lit(1))).alias("weight")
    return edges.groupBy("doc", "from_id", "to_id").agg(weight, F.array_sort(F.collect_set("anchor")).alias("anchors"))


def degrees(weights: DataFrame) -> DataFrame:
    """doc, id, degree: weights of references at either end."""
    ends = weights.select("doc", F.col("from_id").alias("id"), "weight").unionByName(weights.select("doc", F.col("to_id").alias("id"), "weight"))
    return ends.groupBy("doc", "id").agg(F.sum("weight").alias("degree"))


def structure(sections: DataFrame) -> DataFrame:
    """doc, source, target, kind: HAS_SECTION from the document to roots, PART_OF from a section to its parent."""
    roots = sections.filter("parent is null").select("doc", F.concat(F.lit("doc:"), "doc").alias("source"), F.col("id").cast("string").alias("target"), F.lit("HAS_SECTION").alias("kind"))
    inner = sections.filter("parent is not null").select("doc", F.col("id").cast("string").alias("source"), F.col("parent").cast("string").alias("target"), F.lit("PART_OF").alias("kind"))
    return roots.unionByName(inner)


def nodes(sections: DataFrame, weights: DataFrame) -> DataFrame:
    """doc, id, section_type, span (0 without a range) and degree of every section."""
    span = F.when((F.col("page_start") > 0) & (F.col("page_end") > 0), F.col("page_end") - F.col("page_start") + 1).otherwise(0)
    return sections.select("doc", "id", "section_type", span.alias("span")).join(degrees(weights), ["doc", "id"], "left").na.fill(0, ["degree"])


def legend(found: DataFrame, types: DataFrame) -> DataFrame:
    """Types present among the nodes with their number, in the order of types (type_name, creation)."""
    return found.groupBy(F.col("section_type").alias("type_name")).agg(F.count("*").alias("nodes")).join(types, "type_name")


def sound_edges(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    ids = found.select("doc", "id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), ["doc", "from_id"], "left_semi").join(ids.withColumnRenamed("id", "to_id"), ["doc", "to_id"], "left_semi")


def neighbours(edges: DataFrame) -> DataFrame:
    """doc, id, neighbours: sorted ends of its edges in either direction, itself included."""
    both = edges.select("doc", F.col("from_id").alias("id"), F.col("to_id").alias("n")).unionByName(edges.select("doc", F.col("to_id").alias("id"), F.col("from_id").alias("n")))
    both = both.unionByName(both.select("doc", "id", F.col("id").alias("n")))
    return both.groupBy("doc", "id").agg(F.array_sort(F.collect_set("n")).alias("neighbours"))


def payload(documents: DataFrame, sections: DataFrame, weights: DataFrame) -> DataFrame:
    """The graph of each project as rows: project, doc, part, source, target, label, value. documents: doc, title, project; sections: doc, id, parent, title, section_type.

    A project's graph is the union of its documents' graphs; references never leave a document. Parts: document (label its
    title), node (a section, label its type or none, value its degree), structure (label HAS_SECTION or PART_OF) and reference
    (value the weight). Documents without a project are in none; sections and references of unknown documents are left out.
    """
    own = documents.filter("project is not null").select("project", "doc", "title")
    in_ = lambda rows: rows.join(own.select("project", "doc"), "doc")
    none, text = F.lit(None).cast("string"), lambda c: F.col(c).cast("string")
    degree = sections.select("doc", "id", "section_type").join(degrees(weights), ["doc", "id"], "left")
    parts = [
        own.select("project", "doc", F.lit("document").alias("part"), F.concat(F.lit("doc:"), "doc").alias("source"), none.alias("target"), F.col("title").alias("label"), F.lit(None).cast("bigint").alias("value")),
        in_(degree).select("project", "doc", F.lit("node"), text("id"), none, "section_type", F.coalesce("degree", F.lit(0)).cast("bigint")),
        in_(structure(sections)).select("project", "doc", F.lit("structure"), "source", "target", "kind", F.lit(None).cast("bigint")),
        in_(weights).select("project", "doc", F.lit("reference"), text("from_id"), text("to_id"), none, F.col("weight").cast("bigint")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def payload_counts(projects: DataFrame, rows: DataFrame) -> DataFrame:
    """project and how many documents, nodes, edges and types its payload has: zeros for a project without documents."""
    is_ = lambda *parts: F.sum(F.col("part").isin(*parts).cast("bigint"))
    types = F.count_distinct(F.when(F.col("part") == "node", F.col("label")))
    found = rows.groupBy("project").agg(is_("document").alias("documents"), is_("node").alias("nodes"), is_("structure", "reference").alias("edges"), types.alias("types"))
    return projects.select("project").distinct().join(found, "project", "left").na.fill(0)
