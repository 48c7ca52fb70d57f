"""Markdown tables: structural issues and the one safe repair, as islands of pipe lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Issues reported per text.
MOST = 8
# Labels of the issue codes.
LABELS = {"missing_separator": "table missing separator row", "ragged_row": "ragged table rows", "lone_pipe_row": "orphaned table row"}


def marked_lines(texts: DataFrame, keys: list[str], markdown: str = "markdown") -> DataFrame:
    """The lines that are a fence or a pipe line, with fence (is one) and block (the number of its run of pipe lines outside fences, else null).

    Other lines only end a run, which the line numbers tell, so they are left out before anything is ordered.
    """
    all_lines = F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    can = lambda x: F.contains(x, F.lit("|")) | F.contains(x, F.lit("```")) | F.contains(x, F.lit("~~~"))
    rows = texts.select(*keys, F.explode(F.filter(all_lines, lambda e: can(e["line"]))).alias("at")).select(*keys, "at.line_no", "at.line")
    w = Window.partitionBy(*keys).orderBy("line_no")
    rows = rows.withColumn("fence", F.col("line").rlike(T.FENCE))
    rows = rows.withColumn("inside", F.sum(F.col("fence").cast("int")).over(w) % 2 == 1)
    row = T.is_pipe_line(F.col("line")) & ~F.col("inside") & ~F.col("fence")
    follows = F.lag("row").over(w) & (F.lag("line_no").over(w) == F.col("line_no") - 1)
    rows = rows.withColumn("row", row).withColumn("starts", F.col("row") & ~F.coalesce(follows, F.lit(False)))
    return rows.withColumn("block", F.when(F.col("row"), F.sum(F.col("starts").cast("int")).over(w)))


def table_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of blocks with at (place in the block), rows, cells, and whether the second line is a separator."""
    b = Window.partitionBy(*keys, "block")
    o = b.orderBy("line_no")
    rows = lines.filter("block is not null").withColumn("at", F.row_number().over(o) - 1).withColumn("rows", F.count("*").over(b))
    rows = rows.withColumn("separator", F.col("line").rlike(T.SEPARATOR)).withColumn("cells", T.cell_count(F.col("line")))
    return rows.withColumn("has_separator", F.max((F.col("at") == 1) & F.col("separator")).over(b)).withColumn("header_cells", F.max(F.when(F.col("at") == 0, F.col("cells"))).over(b))


def issues(texts: DataFrame, keys: list[str], markdown: str = "markdown") -> DataFrame:
    """keys, code, line (from 1; 0 for the whole text): at most MOST per text, in order."""
    lines = marked_lines(texts, keys, markdown)
    rows = table_rows(lines, keys)
    code = (
        F.when((F.col("rows") == 1), "lone_pipe_row")
        .when((F.col("at") == 0) & ~F.col("has_separator"), "missing_separator")
        .when(F.col("has_separator") & (F.col("at") >= 2) & ~F.col("separator") & (F.col("cells") != F.col("header_cells")), "ragged_row")
    )
    found = rows.select(*keys, code.alias("code"), (F.col("line_no") + 1).alias("line")).filter("code is not null")
    odd = lines.groupBy(*keys).agg(F.sum(F.col("fence").cast("int")).alias("n")).filter("n % 2 = 1").select(*keys, F.lit("unclosed_fence").alias("code"), F.lit(0).alias("line"))
    w = Window.partitionBy(*keys).orderBy(F.when(F.col("line") == 0, 2**31 - 1).otherwise(F.col("line")))
    return found.unionByName(odd).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= MOST).drop("n")


def labels(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys and lint_labels, the distinct labels of a text's table issues in first-seen order."""
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("code")]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", label.alias("label")))), lambda x: x["label"])
    return found.filter(F.col("code") != "unclosed_fence").groupBy(*keys).agg(F.array_distinct(ordered).alias("lint_labels"))


def repaired(texts: DataFrame, keys: list[str], markdown: str = "markdown") -> DataFrame:
    """Texts with a separator row after the header of each block of two rows or more that lacks one.

    Within each text, so none is dealt or written: the lines between two fences are a stretch, and every second one is inside.
    Whether a line is such a header follows from it and its neighbours. Each step is a projection of its own.
    """
    rows = texts.select(*keys, F.coalesce(markdown, F.lit("")).alias(markdown))
    rows = rows.withColumn("__lines", F.when(F.contains(markdown, F.lit("|")), F.split(markdown, "\n", -1)))
    fence = lambda x: (F.contains(x, F.lit("```")) | F.contains(x, F.lit("~~~"))) & x.rlike(T.FENCE)
    rows = rows.withColumn("__fences", F.array_compact(F.transform("__lines", lambda x, i: F.when(fence(x), i))))
    # a stretch starts at its fence, which is no pipe line
    start, end = lambda k: F.coalesce(F.get("__fences", k - 1), F.lit(0)), lambda k: F.coalesce(F.get("__fences", k), F.size("__lines"))
    stretch = lambda k: F.slice("__lines", start(k) + 1, end(k) - start(k))
    row = lambda k: F.transform(stretch(k), lambda x: (k % 2 == 0) & F.contains(x, F.lit("|")) & T.is_pipe_line(x))
    rows = rows.withColumn("__rows", F.flatten(F.transform(F.sequence(F.lit(0), F.size("__fences")), row)))
    at = lambda i: F.coalesce(F.get("__rows", i), F.lit(False))
    bare = lambda i: at(i) & ~at(i - 1) & at(i + 1) & ~F.get("__lines", i + 1).rlike(T.SEPARATOR)
    rows = rows.withColumn("__bare", F.transform("__lines", lambda _, i: bare(i)))
    whole = F.array_join(F.transform("__lines", lambda x, i: F.when(F.get("__bare", i), F.concat(x, F.lit("\n|"), F.repeat(F.lit("---|"), T.cell_count(x)))).otherwise(x)), "\n")
    return rows.select(*keys, F.when(F.array_contains("__bare", True), whole).otherwise(F.col(markdown)).alias(markdown))
