"""Lines to blocks, the kind of a block, and the cells of a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphweave.operators.words import PAGE


def detect_blocks(lines: DataFrame) -> DataFrame:
    """Add block_ord to lines.

    A line starts a block where the gap above it is over 0.9 of the taller line, or
    where it neither starts within two line heights of the line above nor overlaps it.
    """
    down = Window.partitionBy(*PAGE).orderBy("line_ord")
    above = {c: F.lag(c).over(down) for c in "xywh"}
    taller = F.greatest(above["h"], F.col("h"))
    gap = above["y"] - (F.col("y") + F.col("h"))
    aligned = F.abs(above["x"] - F.col("x")) < 2 * taller
    shared = F.least(above["x"] + above["w"], F.col("x") + F.col("w")) - F.greatest(above["x"], F.col("x"))
    breaks = (gap > 0.9 * taller) | (~aligned & (shared <= 0))
    number = F.sum(F.coalesce(breaks.cast("int"), F.lit(0))).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("block_ord", number.cast("int"))


def with_kinds(lines: DataFrame) -> DataFrame:
    """Add the kind of its block to each line (with block_ord).

    Two or more lines with column gaps make a table. A paragraph is at least 18 em
    wide and each of its breaks was forced: the next line's first word would not have
    fit. Everything else, single lines too, is "lines".
    """
    block = Window.partitionBy(*PAGE, "block_ord")
    down = block.orderBy("line_ord")
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    next_w, next_size = F.lead("first_w").over(down), F.lead("first_size").over(down)
    loose = F.col("w") + 0.25 * next_size + next_w <= F.max("w").over(whole) + 2
    marked = lines.withColumn("loose", F.coalesce(loose.cast("int"), F.lit(0)))
    kind = (
        F.when(F.count("*").over(whole) < 2, "lines")
        .when(F.sum((F.col("column_gaps") > 0).cast("int")).over(whole) >= 2, "table")
        .when(F.max("w").over(whole) < 18 * F.coalesce(F.first("first_size").over(whole), F.lit(12.0)), "lines")
        .when(F.sum("loose").over(whole) > 0, "lines")
        .otherwise("paragraph")
    )
    return marked.withColumn("kind", kind).drop("loose")


def classify_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of lines (with block_ord, and kind by `with_kinds`): box, kind, line_lo, line_hi, n_lines, n_words."""
    return lines.groupBy(*PAGE, "block_ord").agg(
        F.first("kind").alias("kind"),
        F.min("line_ord").alias("line_lo"),
        F.max("line_ord").alias("line_hi"),
        F.count("*").alias("n_lines"),
        F.sum("n_words").alias("n_words"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        F.max("baseline").alias("first_baseline"),
        F.coalesce(F.min_by("first_size", "line_ord"), F.lit(12.0)).alias("em"),
    )


def number_cells(placed: DataFrame) -> DataFrame:
    """Add `cell` to placed words: cells of a line are words between gaps of 1.5 em or more of the word before."""
    along = Window.partitionBy(*PAGE, "line_ord").orderBy("pos")
    gap = F.col("x") - (F.lag("x").over(along) + F.lag("w").over(along))
    starts = F.coalesce((gap >= 1.5 * F.lag("font_size").over(along)).cast("int"), F.lit(0))
    return placed.withColumn("starts", starts).withColumn("cell", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("starts")


def group_cells(placed: DataFrame) -> DataFrame:
    """Cells of each line with their text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), " ")
    return number_cells(placed).groupBy(*PAGE, "line_ord", "cell").agg(text.alias("text"), F.count("*").alias("n_words"), F.min("x").alias("x"))


def line_cells(lines: DataFrame) -> DataFrame:
    """group_cells of lines that hold their words, each with its cell; every line's words are added up where they lie."""
    own = lambda k: F.filter("words", lambda w: w["cell"] == k)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("column_gaps")), lambda k: F.struct(k.cast("int").alias("cell"), own(k).alias("own")))
    rows = lines.select(*PAGE, "line_ord", F.inline(cells))
    return rows.select(*PAGE, "line_ord", "cell", F.array_join("own.text", " ").alias("text"), F.size("own").cast("long").alias("n_words"), F.array_min("own.x").alias("x"))


def leading(lines: DataFrame) -> DataFrame:
    """Distance of the first two baselines of each block; 1.25 of the size for a single line."""
    down = Window.partitionBy(*PAGE, "block_ord").orderBy("line_ord")
    step = F.abs(F.col("baseline") - F.lead("baseline").over(down))
    first = lines.withColumn("step", step).withColumn("at", F.row_number().over(down)).where("at = 1")
    return first.select(*PAGE, "block_ord", F.coalesce("step", 1.25 * F.col("first_size")).alias("leading"))
