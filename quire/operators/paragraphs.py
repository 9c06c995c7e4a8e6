"""Lists, indexes and paragraphs from the lines of text blocks.

Everything here is a window or an aggregate: a block's lines meet in one aggregate, a line looks
at its neighbours, and a paragraph is a run of blocks of which each joins the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks that end a sentence or an item, and those that end an item of a list.
STOPS = [".", "!", "?", "。", "！", "？", ")", "）", '"', "”", ":", "：", ";", "；"]
ITEM_ENDS = [".", "。", ";", "；"]
_CJK = "[぀-ヿ㐀-鿿가-힯]"


def classify(lines: DataFrame, key: list[str]) -> DataFrame:
    """Blocks as text, list or index, and where the items of a list begin and end.

    lines: key..., line (order), x0, y0, x1, y1, text, page_width. Adds fx0, fy0, fx1, fy1 (the
    extent of a block's lines), kind, begins and ends. A block of one line is text. Null texts
    count as empty. Rows of one key are one block; a block is a unit of work, so keys spread.
    """
    by = Window.partitionBy(*key)
    order = by.orderBy("line")
    df = lines.withColumn("text", F.coalesce(F.btrim("text"), F.lit("")))
    for name, f, c in (("fx0", F.min, "x0"), ("fy0", F.min, "y0"), ("fx1", F.max, "x1"), ("fy1", F.max, "y1")):
        df = df.withColumn(name, f(c).over(by))
    first = lambda c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = lambda c: F.last(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("tall", first(F.col("y1") - F.col("y0"))).withColumn("wide", F.col("fx1") - F.col("fx0"))
    df = df.withColumn("cjk", F.max(F.col("text").rlike(_CJK)).over(by))
    left, right = F.col("x0") - F.col("fx0"), F.col("fx1") - F.col("x1")
    tall, wide, n = F.col("tall"), F.col("wide"), F.col("n")
    part = F.when(F.col("cjk") | ((F.col("page_width") > 0) & (wide >= 0.5 * F.col("page_width"))), 0.26).otherwise(0.36) * wide
    marks = {
        "at_left": left < tall / 2,
        "off_left": (left >= tall / 2) & (left > tall),
        "at_right": right < tall,
        "off_right": (right >= tall) & (right > part),
        "off_both": (left > 0.7 * tall) & (right > 0.7 * tall),
        "centred": F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("fx0") + F.col("fx1")) / 2) < tall / 2,
        "ended": F.right(F.col("text"), F.lit(1)).isin(ITEM_ENDS),
        "number": F.col("text").rlike(r"^\p{Nd}"),
        "numbered": F.col("text").rlike(r"\p{Nd}$"),
    }
    for name, mark in marks.items():
        df = df.withColumn(name, mark).withColumn(f"n_{name}", F.count_if(F.col(name)).over(by))
    share = lambda name: F.col(f"n_{name}") >= 0.8 * n
    # A block of paragraphs, not items: the first line stands in, the last ends early.
    indented = (first(left) > tall / 2) & (F.abs(last(left)) < tall / 2) & (last(right) > tall)
    df = df.withColumn("indented", indented)
    index = (share("at_left") | share("at_right")) & (share("number") | share("numbered"))
    middle = (F.col("n_off_both") >= 2) & (F.col("n_centred") == n) & (F.col("n_off_both") >= 0.5 * n) & (F.col("fy1") - F.col("fy0") > 0.4 * wide)
    items = (F.col("n_at_left") >= 2) & ((F.col("n_off_right") >= 2) | share("ended") | (F.col("n_off_left") >= 2)) & ~F.col("indented")
    shape = F.when(n < 2, "text").when(index, "index").when(middle, "middle").when(items, "list").otherwise("text")
    df = df.withColumn("shape", shape)
    # Within a list: flush left, items are told by their length, by their end marks or by short lines;
    # numbered items with as many ends by those; others by the indent.
    flush = F.col("n_at_left") > 0.8 * n
    way = (
        F.when(F.col("shape") != "list", F.col("shape"))
        .when(flush & (F.col("n_ended") == 0) & (F.col("n_at_right") < 0.5 * n), "short")
        .when(flush & share("ended"), "marked")
        .when(flush, "gaps")
        .when((F.col("n_number") >= 2) & (F.col("n_number") == F.col("n_ended")), "numbered")
        .otherwise("indent")
    )
    df = df.withColumn("way", way)
    early = right > 0.1 * wide
    ends = F.when(F.col("way") == "marked", F.col("ended")).when(F.col("way") == "gaps", early).when(F.col("way") == "numbered", F.col("ended")).when(F.col("way") == "indent", right > tall).otherwise(F.lit(False))
    df = df.withColumn("ends", ends)
    after = F.coalesce(F.lag("ends").over(order), F.lit(False))
    begins = (
        F.when(F.col("way").isin("index", "middle"), F.lit(True))
        .when(F.col("way").isin("short", "indent"), F.col("at_left"))
        .when(F.col("way").isin("marked", "gaps"), after)
        .when(F.col("way") == "numbered", F.col("number"))
        .otherwise(F.lit(False))
    )
    kind = F.when(F.col("shape") == "middle", "list").otherwise(F.col("shape"))
    return df.withColumn("begins", begins).withColumn("kind", kind).select(*lines.columns, "fx0", "fy0", "fx1", "fy1", "kind", "begins", "ends")


def merge(blocks: DataFrame, doc: str = "doc_id", order: str = "pos") -> DataFrame:
    """Paragraphs of a document: blocks that go on in the next are one, also across pages.

    blocks: doc, order, page_idx, type (`text` or another), kind (of text blocks: text, list,
    index), n_lines, x0, x1 (of the block), fx0, fx1 (of its lines), head_x0, head_tall, head_text
    (of its first line), tail_x1, tail_tall, tail_text (of its last). Returns blocks with `group`
    (runs of text blocks), `para` (order of the block that a block's lines go to) and cross_page
    (moved from another page). Lists join lists, indexes indexes; text goes on if its first line
    stands at the left, the line before it reaches the right and does not end a sentence, widths
    are alike, and it does not begin with a digit or a capital. Runs in which no block has more
    than three lines are lists of short items: their text stays apart.
    """
    w = Window.partitionBy(doc).orderBy(order)
    text = F.col("type") == "text"
    df = blocks.withColumn("__cut", ~(text & F.coalesce(F.lag("type").over(w) == "text", F.lit(False))))
    df = df.withColumn("group", F.count_if(F.col("__cut")).over(w))
    g = Window.partitionBy(doc, "group")
    df = df.withColumn("__short", F.max("n_lines").over(g) <= 3)
    before = {c: F.lag(c).over(w) for c in ("kind", "page_idx", "x0", "x1", "fx1", "tail_x1", "tail_tall", "tail_text")}
    wide, wide_before = F.col("x1") - F.col("x0"), before["x1"] - before["x0"]
    goes_on = (
        (F.abs(F.col("fx0") - F.col("head_x0")) < F.col("head_tall") / 2)
        & (F.abs(before["fx1"] - before["tail_x1"]) < before["tail_tall"])
        & (F.length("head_text") > 0)
        & ~F.right(before["tail_text"], F.lit(1)).isin(STOPS)
        & (F.abs(wide - wide_before) < F.least(wide, wide_before))
        & ~F.col("head_text").rlike(r"^[\p{Nd}\p{Lu}]")
    )
    same = F.col("kind") == before["kind"]
    joins = ~F.col("__cut") & same & F.when(F.col("kind") == "text", ~F.col("__short") & goes_on).otherwise(F.lit(True))
    df = df.withColumn("__joins", F.coalesce(joins, F.lit(False))).withColumn("__moved", F.col("__joins") & (F.col("page_idx") != before["page_idx"]))
    df = df.withColumn("para", F.max(F.when(~F.col("__joins"), F.col(order))).over(w))
    # A block's lines are marked as moved where any step of the way from it crossed a page.
    steps = Window.partitionBy(doc, "para").orderBy(order)
    df = df.withColumn("cross_page", F.max(F.col("__moved")).over(steps))
    return df.select(*blocks.columns, "group", "para", "cross_page")
