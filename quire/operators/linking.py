"""Links from rendered blocks to the blocks of the source that they come from, and nested lists.

Documents never meet; within one, what depends on the order of steps is one fold over arrays in the
JVM (a row of a few numbers for each step), everything else windows and joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def link(shells: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, md_pos -> block_pos, page_idx, divider: each rendered block's source block.

    shells: doc_id, md_pos, list_id (of the list that a list item is in; null for other blocks).
    sources: doc_id, block_pos, page_idx, kind, merge_id (of blocks that were merged into one; null
    for others). Links never cross: rendered blocks in order take source blocks in order of page,
    then block_pos. Merged blocks count once, at their first. A list (its items in a row, from the
    first on) that comes to merged blocks takes them as one: its items link to them in order, those
    beyond the last to the first; one that comes to a block of kind `content` links all its items to
    it; else each item takes a block of its own. What is left without a block is not returned.
    divider: whether a page starts before the block, that is, its page is not that of the linked
    block before. Items of a list that are not next to each other count with the first.
    """
    order = Window.partitionBy("doc_id").orderBy("page_idx", "block_pos")
    merged = Window.partitionBy("doc_id", "merge_id")
    c = sources.select("doc_id", "block_pos", F.coalesce("page_idx", F.lit(0)).alias("page_idx"), F.lower("kind").alias("kind"), "merge_id")
    nth = F.when(F.col("merge_id").isNull(), F.lit(1)).otherwise(F.row_number().over(merged.orderBy("page_idx", "block_pos")))
    c = c.withColumn("nth", nth)
    heads = c.where("nth = 1").withColumn("at", F.row_number().over(order) - 1)
    heads = heads.withColumn("whole", F.col("merge_id").isNotNull() | (F.coalesce("kind", F.lit("")) == "content"))

    s = shells.select("doc_id", "md_pos", "list_id")
    lists = Window.partitionBy("doc_id", "list_id")
    s = s.withColumn("unit", F.when(F.col("list_id").isNull(), F.col("md_pos")).otherwise(F.min("md_pos").over(lists)))
    s = s.withColumn("item", F.when(F.col("list_id").isNull(), F.lit(0)).otherwise(F.row_number().over(lists.orderBy("md_pos")) - 1))
    units = s.groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("list_id").isNotNull()).alias("list"))
    units = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit", "n", "list"))).alias("units"))
    known = heads.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "whole"))), lambda h: h["whole"]).alias("wholes"))

    def step(acc, u):
        now = acc["at"]
        one = ~u["list"] | F.coalesce(F.try_element_at("wholes", now + 1), F.lit(False))
        return F.struct((now + F.when(one, F.lit(1)).otherwise(u["n"].cast("int"))).alias("at"), F.concat(acc["starts"], F.array(F.struct(now.alias("start"), one.alias("one")))).alias("starts"))

    begin = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,one:boolean>>)").alias("starts"))
    starts = F.aggregate("units", begin, step, lambda acc: acc["starts"])
    taken = units.join(known, "doc_id").select("doc_id", F.explode(F.arrays_zip(F.transform("units", lambda u: u["unit"]).alias("unit"), starts.alias("took"))).alias("z"))
    taken = taken.select("doc_id", F.col("z.unit").alias("unit"), F.col("z.took.start").alias("start"), F.col("z.took.one").alias("one"))

    s = s.join(taken, ["doc_id", "unit"]).withColumn("at", F.when(F.col("one"), F.col("start")).otherwise(F.col("start") + F.col("item")))
    s = s.join(heads.select("doc_id", "at", "merge_id", "block_pos", "page_idx"), ["doc_id", "at"])
    parts = c.where("merge_id IS NOT NULL AND nth > 1").select(F.col("doc_id").alias("d2"), F.col("merge_id").alias("m2"), (F.col("nth") - 1).alias("i2"), F.col("block_pos").alias("b2"), F.col("page_idx").alias("g2"))
    s = s.join(parts, (F.col("doc_id") == F.col("d2")) & (F.col("merge_id") == F.col("m2")) & (F.col("item") == F.col("i2")) & F.col("one") & F.col("list_id").isNotNull(), "left")
    s = s.select("doc_id", "md_pos", F.coalesce("b2", "block_pos").alias("block_pos"), F.coalesce("g2", "page_idx").alias("page_idx"))
    before = F.lag("page_idx").over(Window.partitionBy("doc_id").orderBy("md_pos"))
    return s.withColumn("divider", F.coalesce(before != F.col("page_idx"), F.lit(False)))


def nest(items: DataFrame, levels: int = 9) -> DataFrame:
    """items: doc_id, pos, level (0 at the top), ordered (boolean), start (first number of a list, or
    null). Returns doc_id, pos, depth, parent (pos of the item it lies under, or null), number (null
    where not ordered), path (the numbers from the top, dots between; `-` for an unordered item) and
    marker (four spaces for each level above, then the number and a dot, or a dash).

    An item's parent is the nearest item before it of a lower level; levels may be skipped, so depth
    counts parents. The items of one parent are a list for each run of equal level and kind, and
    numbers begin anew in each, at the run's first start or at 1. Null levels count as 0, null kinds
    as unordered; levels from `levels` on (office formats have nine) count as the last one.
    No recursion: a window keeps the last item of each level, and those that no lower level has
    followed since are what an item lies under.
    """
    level = F.least(F.greatest(F.coalesce("level", F.lit(0)), F.lit(0)), F.lit(levels - 1)).cast("int")
    i = items.select("doc_id", F.col("pos").cast("long").alias("pos"), level.alias("level"), F.coalesce("ordered", F.lit(False)).alias("ordered"), "start")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    above, reach = [], F.lit(None).cast("long")
    for k in range(levels - 1):
        last = F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("pos"))).over(before))
        above.append(F.when(reach.isNull() | (last > reach), last).alias(f"a{k}"))
        reach = F.greatest(reach, last)
    i = i.select("*", F.array_compact(F.array(*above)).alias("above")).withColumn("parent", F.try_element_at("above", F.lit(-1)))
    siblings = Window.partitionBy("doc_id", "parent").orderBy("pos")
    same = F.lag(F.struct("level", "ordered")).over(siblings) == F.struct("level", "ordered")
    i = i.withColumn("run", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("run").over(siblings))
    run = Window.partitionBy("doc_id", "parent", "run").orderBy("pos")
    first = F.first("start", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    i = i.withColumn("number", F.when(F.col("ordered"), F.coalesce(first, F.lit(1)) + F.row_number().over(run) - 1).cast("long"))
    said = F.coalesce(F.col("number").cast("string"), F.lit("-"))
    i = i.withColumn("said", said)
    ups = i.select("doc_id", F.col("pos").alias("own"), F.explode("above").alias("pos")).join(i.select("doc_id", "pos", "said"), ["doc_id", "pos"])
    ups = ups.groupBy("doc_id", F.col("own").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda u: u["said"]), ".").alias("up"))
    depth = F.size("above")
    marker = F.concat(F.repeat(F.lit(" "), 4 * depth), F.when(F.col("ordered"), F.concat("said", F.lit("."))).otherwise("-"))
    return i.join(ups, ["doc_id", "pos"], "left").select("doc_id", "pos", depth.alias("depth"), "parent", "number", F.concat_ws(".", "up", "said").alias("path"), marker.alias("marker"))


def keep_anchors(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """entries: doc_id, pos, anchor (of the lines of a table of contents). Returns them with the
    anchor, without white space around it, where a block of the document's body has it (blocks:
    doc_id, anchor), else null. Documents whose bodies have no anchors at all keep theirs as they
    are. Blank anchors count as none; rows of equal positions each keep or lose their own."""
    bare = lambda c: F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    known = blocks.select(F.col("doc_id").alias("d"), bare(F.col("anchor")).alias("known")).where("known IS NOT NULL").distinct()
    anchored = known.select(F.col("d").alias("d2")).distinct()
    e = entries.select("doc_id", "pos", "anchor", bare(F.col("anchor")).alias("asked"))
    e = e.join(known, (F.col("doc_id") == F.col("d")) & (F.col("asked") == F.col("known")), "left").join(anchored, F.col("doc_id") == F.col("d2"), "left")
    return e.select("doc_id", "pos", F.when(F.col("d2").isNull(), F.col("anchor")).otherwise(F.col("known")).alias("anchor"))
