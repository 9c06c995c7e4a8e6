"""Runs and islands: what holds together along an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], start: str, end: str, order: list[str], strict: bool = False) -> DataFrame:
    """Adds `island`, the number (from 1) of the run of intervals that overlap or touch. With
    strict, touching intervals stay apart."""
    w = Window.partitionBy(*by).orderBy(start, end, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (reach <= F.col(start) if strict else reach < F.col(start))
    return df.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def break_runs(df: DataFrame, by: list[str], order: list[str], new: Column, name: str = "run") -> DataFrame:
    """Adds a running number that grows wherever `new` holds (a condition that may look at the row
    before through lag over the same order)."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = df.withColumn("__new", new.cast("int"))
    return flagged.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def lines(boxes: DataFrame, ratio: float = 0.6) -> DataFrame:
    """Adds `line`: boxes of a page from top to bottom, a new line wherever a box shares no more
    than ratio of the lesser height with the one before it."""
    w = Window.partitionBy("page").orderBy("y0", "pos")
    py0, py1 = F.lag("y0").over(w), F.lag("y1").over(w)
    shared = F.greatest(F.lit(0.0), F.least("y1", py1) - F.greatest("y0", py0))
    least = F.least(F.col("y1") - F.col("y0"), py1 - py0)
    same = F.when(least > 0, shared / F.when(least > 0, least) > ratio).otherwise(F.lit(False))
    return break_runs(boxes, ["page"], ["y0", "pos"], py0.isNull() | ~same, "line")


def type_groups(blocks: DataFrame, text: str = "text", cuts: tuple[str, ...] = ("title", "interline_equation")) -> DataFrame:
    """Adds `grp`: consecutive text blocks are one group, other blocks one each; a text group also
    ends before a block of a cutting type, which its own group does anyway."""
    w = Window.partitionBy("page").orderBy("pos")
    new = F.lag("type").over(w).isNull() | (F.col("type") != text) | (F.lag("type").over(w) != text)
    return break_runs(blocks, ["page"], ["pos"], new, "grp")


def projection(df: DataFrame, by: list[str], start: Column, end: Column) -> DataFrame:
    """Segments of a 1-D projection: by..., at (where the count changes), upto, n (boxes over it).
    Each box adds one at its start and takes one at its end, so work follows the boxes, not their
    lengths."""
    edges = df.select(*by, start.alias("at"), F.lit(1).alias("d")).unionByName(df.select(*by, end.alias("at"), F.lit(-1).alias("d")))
    steps = edges.groupBy(*by, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("at")
    steps = steps.withColumn("n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("upto", F.lead("at").over(w))
    return steps.where("n > 0").select(*by, "at", "upto", F.col("n").cast("int").alias("n"))
