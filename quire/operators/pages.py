"""Filters and joins of boxes on a page.

All take DataFrames keyed by page and pos, and join on the page first, so no pair ever crosses
pages and every theta join has an equality to hash by. What only compares with the full set is a
semi- or anti-join; what depends on the order of removals is in `greedy`. Neighbours, which would
be all pairs of a page, are found a page at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators.greedy import by_page

FIELDS = ("x0", "y0", "x1", "y1")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def beside(left: DataFrame, right: DataFrame, rule: Callable[[G.Box, G.Box], Column] | None = None, extra: Column | None = None, how: str = "inner") -> DataFrame:
    """left rows with the right rows of their page (columns b_...) for which rule and extra hold."""
    on = F.col("page") == F.col("b_page")
    if rule is not None:
        on = on & rule(G.Box.of(), G.Box.of("b_"))
    if extra is not None:
        on = on & extra
    return left.join(prefixed(right, "b_"), on, how)


def drop_where(left: DataFrame, right: DataFrame, rule, extra: Column | None = None) -> DataFrame:
    """left rows for which no right row of the page fits the rule."""
    return beside(left, right, rule, extra, "left_anti")


def keep_where(left: DataFrame, right: DataFrame, rule, extra: Column | None = None) -> DataFrame:
    """left rows for which some right row of the page fits the rule."""
    return beside(left, right, rule, extra, "left_semi")


def drop_doubles(boxes: DataFrame, categories: list[int], ratio: float = 0.9) -> DataFrame:
    """Of two boxes of these categories that all but coincide the one with the lower score goes,
    the later one if scores are equal."""
    some = boxes.where(F.col("category_id").isin(categories))
    worse = (F.col("score") < F.col("b_score")) | ((F.col("score") == F.col("b_score")) & (F.col("pos") > F.col("b_pos")))
    return drop_where(boxes, some, lambda a, b: G.iou(a, b) > ratio, worse & F.col("category_id").isin(categories))


def not_contained(boxes: DataFrame) -> DataFrame:
    """Boxes within no other; equal boxes remove each other."""
    return drop_where(boxes, boxes, G.inside, F.col("pos") != F.col("b_pos"))


def refootnote(boxes: DataFrame, footnote: int, figure: int, grid: int) -> DataFrame:
    """Adds `to_figure`: a footnote that lies nearer to a figure than to any table. What lies askew
    (apart on both axes) does not count; nor do footnotes on pages without figures."""
    notes = boxes.where(F.col("category_id") == footnote)
    def nearest(kind: int, name: str) -> DataFrame:
        a, b = G.Box.of(), G.Box.of("b_")
        sides = sum(c.cast("int") for c in G.relative_position(a, b).values())
        near = beside(notes, boxes.where(F.col("category_id") == kind)).where(sides <= 1)
        return near.groupBy("page", "pos").agg(F.min(G.distance(a, b)).alias(name))
    out = notes.join(nearest(figure, "near_figure"), ["page", "pos"], "left").join(nearest(grid, "near_table"), ["page", "pos"], "left")
    return out.withColumn("to_figure", F.col("near_figure").isNotNull() & (F.coalesce("near_table", F.lit(float("inf"))) > F.col("near_figure")))


def first_match(left: DataFrame, right: DataFrame, rule, order: list[Column], extra: Column | None = None) -> DataFrame:
    """Each left row with the first right row (by order) of its page that fits."""
    found = beside(left, right, rule, extra)
    rank = F.row_number().over(Window.partitionBy("page", "pos").orderBy(*order))
    return found.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


#: The kinds of blocks that take a kind of span.
SPAN_FITS = {
    "text": ["text", "title", "image_caption", "image_footnote", "table_caption", "table_footnote", "discarded"],
    "inline_equation": ["text", "title", "image_caption", "image_footnote", "table_caption", "table_footnote", "discarded"],
    "checkbox": ["text", "title", "image_caption", "image_footnote", "table_caption", "table_footnote", "discarded"],
    "interline_equation": ["interline_equation", "text"],
    "image": ["image_body"],
    "table": ["table_body"],
}


def fits(span_type: Column, block_type: Column) -> Column:
    out = F.lit(False)
    for span, blocks in SPAN_FITS.items():
        out = F.when(span_type == span, block_type.isin(blocks)).otherwise(out)
    return out


def spans_to_blocks(spans: DataFrame, blocks: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Each span with the first block that holds more than ratio of it (0.9 for images and tables)
    and takes its type."""
    need = F.when(F.col("type").isin("image", "table"), 0.9).otherwise(ratio)
    return first_match(spans, blocks, lambda a, b: G.overlap_of_first(a, b) > need, [F.col("b_pos")], fits(F.col("type"), F.col("b_type")))


def spans_inside(spans: DataFrame, blocks: DataFrame, discarded: DataFrame) -> DataFrame:
    """Spans that a discarded block covers to more than 0.4, or a block of their kind to more than 0.5."""
    kind = F.when(F.col("type") == "image", F.col("b_type") == "image_body").when(F.col("type") == "table", F.col("b_type") == "table_body").otherwise(~F.col("b_type").isin("image_body", "table_body"))
    # One semi-join over both kinds of blocks: a span is kept once, by either.
    both = blocks.withColumn("gone", F.lit(False)).unionByName(discarded.withColumn("gone", F.lit(True)))
    share = lambda a, b: F.when(F.col("b_gone"), G.overlap_of_first(a, b) > 0.4).otherwise((G.overlap_of_first(a, b) > 0.5) & kind)
    return keep_where(spans, both, share)


def grid_match(points: DataFrame, spans: DataFrame, cell: float, rule) -> DataFrame:
    """Band join: each point (char) with the first span (by y0, then pos) whose band of cells holds
    its centre and that fits. Both sides meet on (page, cell), so a page of many spans costs only
    those near the point."""
    lo, hi = F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell)
    right = spans.withColumn("cell", F.explode(F.sequence(lo, hi)))
    left = points.withColumn("cell", F.floor((F.col("y0") + F.col("y1")) / 2 / cell))
    return first_match(left, right, rule, [F.col("b_y0"), F.col("b_pos")], F.col("cell") == F.col("b_cell"))


def nearest_by_index(objects: DataFrame, subjects: DataFrame) -> DataFrame:
    """As-of join: each object with the subject nearest in reading order (index), then by the gap
    between their boxes, then by their centres, then by pos."""
    a, b = G.Box.of(), G.Box.of("b_")
    order = [F.abs(F.col("index") - F.col("b_index")), G.distance(a, b), G.center_distance(a, b), F.col("b_pos")]
    return first_match(objects, subjects, None, order)


def neighbours(boxes: DataFrame, ratio: float, direction: str = "horizontal") -> DataFrame:
    """For each box the nearest one before and after it among those that overlap it in projection
    by more than ratio of the lesser extent: prev_pos, post_pos (null if there is none)."""
    lo, hi, key = ("x0", "x1", "y0") if direction == "horizontal" else ("y0", "y1", "x0")

    def run(page):
        a, z, at, pos = (page[c].astype(float) for c in (lo, hi, key, "pos"))
        shared = np.minimum(z[:, None], z) - np.maximum(a[:, None], a)
        least = np.minimum((z - a)[:, None], z - a)
        hit = (shared > 0) & (least > 0) & (pos[:, None] != pos)
        hit &= np.divide(shared, least, out=np.zeros_like(shared), where=hit) > ratio
        found = {}
        for name, order, ok in (("prev_pos", np.lexsort((pos, -at)), at <= at[:, None]), ("post_pos", np.lexsort((pos, at)), at > at[:, None])):
            some = (hit & ok)[:, order]
            found[name] = np.where(some.any(1), pos[order][some.argmax(1)], np.nan)
        return np.arange(len(a)), found

    kinds = dict(boxes.dtypes)
    near = by_page(boxes.select("page", "pos", *FIELDS), run, ["pos", *FIELDS], f"page {kinds['page']}, pos {kinds['pos']}, prev_pos double, post_pos double")
    return near.select("page", "pos", *(F.when(~F.isnan(c), F.col(c).cast(kinds["pos"])).alias(c) for c in ("prev_pos", "post_pos")))


def match_cells(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """Each text box with the cell of the largest IoU, then the nearest corners, then the first;
    texts that meet no cell drop out."""
    a, b = G.Box.of(), G.Box.of("b_")
    gap = F.abs(a.x0 - b.x0) + F.abs(a.y0 - b.y0) + F.abs(a.x1 - b.x1) + F.abs(a.y1 - b.y1)
    return first_match(texts, cells, lambda a, b: G.iou(a, b) > 1e-8, [1 - G.iou(a, b), gap, F.col("b_pos")])


def table_images(tables: DataFrame, images: DataFrame, layout: DataFrame, scale: float, most: float = 0.9) -> DataFrame:
    """The pictures inside tables: page, table_pos, pos, source, the box in pixels (x0 to y1) and in the
    table's own picture (tx0 to ty1).

    tables: page, pos, box in pixels, dx, dy (what leads from the page's to the table picture's
    pixels). images: page, pos, box in points, the pictures that the page itself holds: those that lie
    in a table belong to it (`page`), unless one is the table (intersection over union of `most` or
    more). layout: page, table_pos, pos, box in pixels, the pictures that layout detection found in a
    table: they stand in (`layout`) for tables that got none of the page's. A picture in tables that
    lie in each other belongs to each of them.
    """
    t = prefixed(tables, "t_")
    box = G.Box.of()
    points = t.select("*", *(((F.col(f"t_{c}") / scale).alias(f"p_{c}")) for c in FIELDS))
    within = G.Box.of("p_")
    own = images.join(points, (F.col("page") == F.col("t_page")) & G.inside(box, within) & (G.iou(box, within) < most))
    out = ("page", F.col("t_pos").alias("table_pos"), "pos", "source", *FIELDS, "t_dx", "t_dy")
    own = own.select(*(F.col(c) if c not in FIELDS else (F.col(c) * scale).alias(c) for c in ("page", "pos", *FIELDS)), "t_pos", "t_dx", "t_dy", F.lit("page").alias("source")).select(*out)
    served = own.select(F.col("page").alias("s_page"), F.col("table_pos").alias("s_pos")).distinct()
    rest = layout.join(served, (F.col("page") == F.col("s_page")) & (F.col("table_pos") == F.col("s_pos")), "left_anti")
    rest = rest.join(t, (F.col("page") == F.col("t_page")) & (F.col("table_pos") == F.col("t_pos"))).withColumn("source", F.lit("layout")).select(*out)
    moved = [(F.col(c) + F.col("t_dx" if c[0] == "x" else "t_dy")).alias(f"t{c}") for c in FIELDS]
    return own.unionByName(rest).select("page", "table_pos", "pos", "source", *FIELDS, *moved)
