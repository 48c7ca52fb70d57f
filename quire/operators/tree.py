"""Section trees: nested-set numbers, subtrees, ancestors, and edits as pure functions of a parent table.

A tree is rows doc, id, parent (null for roots), sort_order, title and any other columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import segments


def descend(top: DataFrame, below: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """top, the rows that below gives for it, those that it gives for these, and so on until there are none.

    Each level is written to the shared folder and read back, so plans don't grow with the depth.
    """
    spark = top.sparkSession
    folder = segments.new_folder(spark, "levels")
    paths, level = [], top
    while True:
        paths.append(f"{folder}/{len(paths)}")
        level.write.parquet(paths[-1])
        level = spark.read.schema(top.schema).parquet(paths[-1])
        if level.isEmpty():
            return spark.read.schema(top.schema).parquet(*paths)
        level = below(level)


@segments.tidied
def nested_set(nodes: DataFrame) -> DataFrame:
    """nodes with level (from 1), path, line (ids from the root), is_group, lft and rgt, depth-first by (sort_order, id).

    A row whose parent has no row in its document is a root. Rows on a cycle of parents, and those below one, hang
    from no root and are left out. Paths grow by one join per level until none does, whatever the depth. With m the
    rank in the depth-first order and d the descendants, lft = 2 m - level and rgt = lft + 2 d + 1 (m from 1):
    numbers before a node are two for each node closed and one for each open ancestor. Ranks go on over range
    partitions, so a document may hold any share of all nodes. What is written on the way is deleted; the numbers stay.
    """
    key = F.struct(F.coalesce("sort_order", F.lit(0)).alias("o"), F.col("id").alias("i"))
    step = segments.settle(nodes.select("doc", "id", "parent", "title", key.alias("key")), "nodes")
    top = step.join(step.select("doc", F.col("id").alias("parent")), ["doc", "parent"], "left_anti").select("doc", "id", F.array("key").alias("keys"), F.array("title").alias("path"), F.array("id").alias("line"))

    def below(level: DataFrame) -> DataFrame:
        up = level.select("doc", F.col("id").alias("parent"), F.col("keys").alias("ks"), F.col("path").alias("ps"), F.col("line").alias("ls"))
        return step.join(up, ["doc", "parent"]).select("doc", "id", F.concat("ks", F.array("key")).alias("keys"), F.concat("ps", F.array("title")).alias("path"), F.concat("ls", F.array("id")).alias("line"))

    found = descend(top, below)
    ranks = segments.ranked(found.select("doc", "id", "keys"), "doc", ["keys"], "m").select("doc", "id", "m")
    below = found.select("doc", F.explode("line").alias("id")).groupBy("doc", "id").agg((F.count("*") - 1).alias("d"))
    depth = F.size("path")
    out = found.join(ranks, ["doc", "id"]).join(below, ["doc", "id"]).select(
        "doc", "id", depth.alias("level"), "path", "line", (F.col("d") > 0).alias("is_group"), (2 * F.col("m") - depth).alias("lft"), (2 * F.col("m") - depth + 2 * F.col("d") + 1).alias("rgt")
    )
    drop = [c for c in ("level", "path", "line", "is_group", "lft", "rgt") if c in nodes.columns]
    return nodes.drop(*drop).join(segments.settle(out, "numbers"), ["doc", "id"])


def subtree(numbered: DataFrame, roots: DataFrame) -> DataFrame:
    """doc, id within the subtrees of roots (doc, id), roots included: an equi-join on the ids of a node's line."""
    return numbered.select("doc", "id", F.explode("line").alias("up")).join(roots.select("doc", F.col("id").alias("up")).distinct(), ["doc", "up"]).select("doc", "id").distinct()


def subtree_sizes(numbered: DataFrame) -> DataFrame:
    return numbered.select("doc", "id", ((F.col("rgt") - F.col("lft") + 1) / 2).cast("bigint").alias("nodes"))


def included_ancestor(numbered: DataFrame) -> DataFrame:
    """doc, id, wiki_parent of each included row: its nearest included ancestor, null for the root."""
    ups = numbered.filter("include").select("doc", "id", F.posexplode("line").alias("depth", "up")).filter("up <> id")
    known = numbered.filter("include").select("doc", F.col("id").alias("up"))
    found = ups.join(known, ["doc", "up"]).groupBy("doc", "id").agg(F.max_by("up", "depth").alias("wiki_parent"))
    return numbered.filter("include").select("doc", "id").join(found, ["doc", "id"], "left")


def include(numbered: DataFrame, roots: DataFrame, value: bool) -> DataFrame:
    """The tree with include set throughout the subtrees of roots."""
    hit = subtree(numbered, roots).select("doc", "id", F.lit(value).alias("__to"))
    return numbered.join(hit, ["doc", "id"], "left").withColumn("include", F.coalesce("__to", "include")).drop("__to")


def delete(numbered: DataFrame, roots: DataFrame) -> DataFrame:
    """The tree without the subtrees of roots, numbered anew."""
    return nested_set(numbered.join(subtree(numbered, roots).select("doc", "id"), ["doc", "id"], "left_anti"))


def rename(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """The tree with titles of names (doc, id, title); paths of descendants follow."""
    new = names.select("doc", "id", F.col("title").alias("__to"))
    return nested_set(nodes.join(new, ["doc", "id"], "left").withColumn("title", F.coalesce("__to", "title")).drop("__to"))


def move(numbered: DataFrame, moves: DataFrame) -> DataFrame:
    """The tree after moves (doc, id, parent, index): each row to a 0-based place among its new siblings.

    A move into the row's own subtree is left out. Places beyond the end are the end.
    """
    own = numbered.select("doc", "id", F.col("lft").alias("a"), F.col("rgt").alias("b"))
    target = numbered.select("doc", F.col("id").alias("new_parent"), F.col("lft").alias("t"))
    asked = moves.select("doc", "id", F.col("parent").alias("new_parent"), "index").join(own, ["doc", "id"]).join(target, ["doc", "new_parent"], "left").filter("t is null or t < a or t > b").drop("a", "b", "t")
    order = Window.partitionBy("doc", "parent").orderBy(F.coalesce("sort_order", F.lit(0)), "id")
    moved = numbered.join(asked, ["doc", "id"], "left")
    staying = moved.filter("index is null").withColumn("place", (F.row_number().over(order) - 1).cast("double"))
    going = moved.filter("index is not null").withColumn("parent", F.col("new_parent")).withColumn("place", F.greatest(F.col("index"), F.lit(0)) - 0.5)
    both = staying.unionByName(going)
    place = F.row_number().over(Window.partitionBy("doc", "parent").orderBy("place", "id")) - 1
    return nested_set(both.withColumn("sort_order", place).drop("place", "new_parent", "index"))


def reorder(nodes: DataFrame, orders: DataFrame) -> DataFrame:
    """The tree with the sort_order of rows set to their places in orders (doc, siblings ARRAY of ids)."""
    places = orders.select("doc", F.posexplode("siblings").alias("__to", "id"))
    return nested_set(nodes.join(places, ["doc", "id"], "left").withColumn("sort_order", F.coalesce("__to", "sort_order")).drop("__to"))


def merge(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """The tree after merging siblings: groups (doc, keep, id) gives for each id, keep included, the row that takes it.

    Ranges widen, bodies, trimmed, join in order by an empty line (blank ones are passed over), children go to the row kept. Rows of another
    parent than the kept one's are left as they are.
    """
    kept = nodes.select("doc", F.col("id").alias("keep"), F.col("parent").alias("kp"))
    plan = groups.join(kept, ["doc", "keep"]).join(nodes.select("doc", "id", "parent"), ["doc", "id"]).filter("parent <=> kp").select("doc", "id", "keep")
    rows = nodes.join(plan, ["doc", "id"], "left")
    rows = rows.withColumn("__body", T.strip(F.coalesce("markdown", F.lit(""))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__body") != "", F.struct("sort_order", "id", "__body")))), lambda x: x["__body"]), "\n\n")
    merged = rows.filter("keep is not null").groupBy("doc", F.col("keep").alias("id")).agg(
        F.min(F.nullif("page_start", F.lit(0))).alias("__a"), F.max(F.nullif("page_end", F.lit(0))).alias("__b"), body.alias("__m")
    )
    left = rows.filter("keep is null or keep = id").drop("keep", "__body").join(merged, ["doc", "id"], "left")
    left = left.withColumns({"page_start": F.coalesce("__a", "page_start"), "page_end": F.coalesce("__b", "page_end"), "markdown": F.coalesce("__m", "markdown")}).drop("__a", "__b", "__m")
    new_parent = plan.select("doc", F.col("id").alias("parent"), F.col("keep").alias("__to"))
    return nested_set(left.join(new_parent, ["doc", "parent"], "left").withColumn("parent", F.coalesce("__to", "parent")).drop("__to"))


def split(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """The tree after splits at (doc, id, heading, new_id): the body from that heading line on becomes the next sibling.

    The first line that starts with marks (after blanks) and has the asked text after them, in any case, is where the tail starts;
    the asked heading may carry marks itself. The tail keeps that line and takes its text as title. Both parts are
    trimmed and keep the page range; rows without such a line stay whole.
    """
    bare = lambda x: T.strip(F.regexp_replace(x, r"^\s*#*", ""))
    order = Window.partitionBy("doc", "parent").orderBy(F.coalesce("sort_order", F.lit(0)), "id")
    rows = nodes.withColumn("__o", F.row_number().over(order).cast("double")).join(at.select("doc", "id", "heading", "new_id"), ["doc", "id"], "left").withColumn("__l", F.split(F.coalesce("markdown", F.lit("")), "\n", -1))
    forms = F.transform("__l", lambda x: F.when(x.rlike(r"^\s*#"), F.lower(bare(x))))
    rows = rows.withColumn("__p", F.array_position(forms, F.lower(bare(F.col("heading")))))
    cut = F.col("heading").isNotNull() & (F.coalesce("__p", F.lit(0)) > 0)
    part = lambda first, n: T.strip(F.array_join(F.slice("__l", first.cast("int"), n.cast("int")), "\n"))
    place = F.greatest(F.coalesce("__p", F.lit(0)), F.lit(1))
    head = rows.withColumn("markdown", F.when(cut, part(F.lit(1), place - 1)).otherwise(F.col("markdown")))
    tail = rows.filter(cut).withColumns(
        {"id": F.col("new_id"), "title": bare(F.element_at("__l", F.col("__p").cast("int"))), "__o": F.col("__o") + 0.5, "markdown": part(place, F.size("__l"))}
    )
    both = head.unionByName(tail, allowMissingColumns=True).drop("heading", "new_id", "__l", "__p")
    place = F.row_number().over(Window.partitionBy("doc", "parent").orderBy("__o", "id")) - 1
    return nested_set(both.withColumn("sort_order", place).drop("__o"))


def refused(nodes: DataFrame, new: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """doc, id, reason of the new rows (doc, id, parent, title, and section_type if types are given) that cannot be created.

    Reasons, first come: a blank title, a document without any row, a parent that is none of its rows, an id that is taken, an unknown type
    (of types, type_name; a blank type is none).
    """
    known = nodes.select("doc", "id").withColumn("there", F.lit(True))
    rows = new.join(nodes.select("doc").distinct().withColumn("some", F.lit(True)), "doc", "left")
    rows = rows.join(known.withColumnRenamed("id", "parent").withColumnRenamed("there", "under"), ["doc", "parent"], "left").join(known, ["doc", "id"], "left")
    reason = F.when(T.strip(F.coalesce("title", F.lit(""))) == "", "blank title").when(F.col("some").isNull(), "unknown document")
    reason = reason.when(F.col("parent").isNotNull() & F.col("under").isNull(), "unknown parent").when(F.col("there"), "id taken")
    if types is not None:
        rows = rows.withColumn("__type", F.nullif(T.strip(F.col("section_type")), F.lit(""))).join(types.select(F.col("type_name").alias("__type"), F.lit(True).alias("typed")), "__type", "left")
        reason = reason.when(F.col("__type").isNotNull() & F.col("typed").isNull(), "unknown type")
    return rows.select("doc", "id", reason.alias("reason")).filter("reason is not null")


def create(nodes: DataFrame, new: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """The tree with new rows (columns of nodes, and index): each at a 0-based place among its siblings, last without one.

    Rows that are `refused` are left out; titles are trimmed.
    """
    new = new.join(refused(nodes, new, types).select("doc", "id"), ["doc", "id"], "left_anti").withColumn("title", T.strip(F.col("title")))
    order = Window.partitionBy("doc", "parent").orderBy(F.coalesce("sort_order", F.lit(0)), "id")
    staying = nodes.withColumn("__place", (F.row_number().over(order) - 1).cast("double"))
    both = staying.unionByName(new.withColumn("__place", F.when(F.col("index").isNotNull(), F.greatest(F.col("index"), F.lit(0)) - 0.5).otherwise(1e6)).drop("index"), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("doc", "parent").orderBy("__place", "id")) - 1
    return nested_set(both.withColumn("sort_order", place).drop("__place"))


def rendered(numbered: DataFrame) -> DataFrame:
    """doc, outline: titles in order, indented by level."""
    line = F.concat(F.expr("repeat('  ', level - 1)"), "title")
    return numbered.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lft", line.alias("x")))), lambda x: x["x"]), "\n").alias("outline"))
