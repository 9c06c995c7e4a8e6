"""Boxes of text from the score maps of a detector.

A map is given as runs (page, y, x0, x1, score): the pixels x0 to x1 of row y have that score; what no
run names has none. Runs of a page do not overlap. Pixels are joined to components, each component
has a least rectangle, and rectangles are scored, grown and scaled. The runs of a page are an array;
pages pass many in a batch, and sorts and searches take all pages of a batch at once. Work follows
runs, not pixels, and only boxes leave the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.operators.greedy import by_page
from quire.operators.ruling import counted, slices

#: A pixel counts above THRESH, a box from SCORE on; GROW scales the distance by which
#: boxes grow; SIDE is the least side of a rectangle (two more when grown, and more than SIDE in the
#: picture).
THRESH, SCORE, GROW, SIDE = 0.3, 0.5, 1.6, 3

Arrays = tuple[np.ndarray, ...]


def _order(page: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of rows in the order of page, y, x; y and x are not below 0."""
    high, wide = int(y.max(initial=0)) + 1, int(x.max(initial=0)) + 1
    if (int(page.max(initial=0)) + 1) * high * wide < 1 << 62:
        return np.argsort((page * high + y) * wide + x, kind="stable")
    return np.lexsort((x, y, page))


def _rows(page: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of sorted rows of pixels: one more for the row below, two for any other."""
    step = np.zeros(len(y), np.int64)
    same = page[1:] == page[:-1]
    step[1:] = np.where(same & (y[1:] == y[:-1]), 0, np.where(same & (y[1:] == y[:-1] + 1), 1, 2))
    return np.cumsum(step)


def masked(page: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: np.ndarray, height: np.ndarray, dilate: bool) -> Arrays:
    """page, y, x0, x1 in this order: runs as long as possible, within the width and height of their
    pages (arrays by the number of the page)."""
    if dilate:
        page, y, x0, x1 = (np.concatenate(v) for v in ((page, page), (y, y + 1), (x0, x0), (x1 + 1, x1 + 1)))
    kept = (x0 < width[page]) & (x1 >= 0) & (y >= 0) & (y < height[page])
    page, y, x0, x1 = page[kept], y[kept], np.maximum(x0[kept], 0), np.minimum(x1[kept], width[page[kept]] - 1)
    order = _order(page, y, x0)
    page, y, x0, x1 = (v[order] for v in (page, y, x0, x1))
    base = _rows(page, y) * (int(width.max(initial=0)) + 2)
    reach, new = np.maximum.accumulate(base + x1), np.ones(len(y), bool)
    new[1:] = base[1:] + x0[1:] > reach[:-1] + 1
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(y))[: len(start)] - 1
    return page[start], y[start], x0[start], (reach - base)[last]


def joined(page: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """For each of the sorted runs of a mask the place of the first run that it is joined to by runs
    that touch in rows next to each other, at corners too."""
    least = int(x0.min(initial=0))
    row = _rows(page, y) * (int(x1.max(initial=0)) - least + 4)
    at, to, above = row + x0 - least, row + x1 - least, row - (int(x1.max(initial=0)) - least + 4)
    lo, hi = np.searchsorted(to, above + x0 - least - 1, "left"), np.searchsorted(at, above + x1 - least + 1, "right")
    sizes = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(y)), sizes)
    b, label = lo[a] + counted(sizes), np.arange(len(y))
    while len(a):
        one, two = label[a], label[b]
        apart = one != two
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label != (up := label[label])).any():
            label = up
    return label


def _convex(chain: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of the points of each chain that turn to one side. A point on or behind the line between
    its neighbours is no corner of the hull, so that all such points drop at once until none is left."""
    left, done = np.arange(len(chain)), []
    while len(left):
        c, v, u = chain[left], y[left], x[left]
        drop = np.zeros(len(left), bool)
        turn = (v[1:-1] - v[:-2]) * (u[2:] - u[:-2]) - (u[1:-1] - u[:-2]) * (v[2:] - v[:-2])
        drop[1:-1] = (c[2:] == c[:-2]) & (turn <= 0)
        busy = np.zeros(int(chain[-1]) + 1, bool)
        busy[c[drop]] = True
        done.append(left[~busy[c]])
        left = left[busy[c] & ~drop]
    return np.sort(np.concatenate(done)) if done else left


def rectangles(component: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> Arrays:
    """component, ex, ey, a0, a1, b0, b1: each component's rectangle of least area, of its runs in the
    order of y and x0.

    One of its sides lies along a side (ex, ey) of the hull. A point's places along and across are
    x ex + y ey and y ex - x ey, whole numbers, so areas that are equal are found equal: ties go to
    the lesser (ex, ey). Components that are a single pixel or one straight line have none.
    """
    order = np.argsort(component, kind="stable")
    component, y, x0, x1 = (v[order] for v in (component, y, x0, x1))
    new = np.ones(len(y), bool)
    new[1:] = (component[1:] != component[:-1]) | (y[1:] != y[:-1])
    start = np.flatnonzero(new)
    component, y, lo, hi = component[start], y[start], x0[start], x1[np.append(start[1:], len(x1))[: len(start)] - 1]
    # down along the left ends of a component's rows, up along the right ends
    number = np.cumsum(np.append(True, component[1:] != component[:-1]))[: len(y)] - 1
    back = np.arange(len(y))[::-1]
    chain, v, u = np.concatenate([2 * number, 2 * number[back] + 1]), np.concatenate([y, y[back]]), np.concatenate([lo, hi[back]])
    order = np.argsort(chain, kind="stable")
    kept = order[_convex(chain[order], v[order], u[order])]
    of, v, u = chain[kept] // 2, v[kept], u[kept]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))[: len(of)]
    last = np.append(first[1:], len(of))[: len(first)] - 1
    again = np.zeros(len(of), bool)  # a row of one pixel ends one chain and begins the other
    again[1:] = (of[1:] == of[:-1]) & (v[1:] == v[:-1]) & (u[1:] == u[:-1])
    again[last] |= (v[last] == v[first]) & (u[last] == u[first])
    of, v, u = of[~again], v[~again], u[~again]
    size = np.bincount(of)
    wide = (size > 2)[of]
    of, v, u = of[wide], v[wide], u[wide]
    names, first, size = np.unique(of, return_index=True, return_counts=True)
    after = np.arange(1, len(of) + 1)
    after[first + size - 1] = first
    ex, ey, places = u[after] - u, v[after] - v, [np.empty(len(of), np.int64) for _ in range(4)]
    for begin, end in slices(size * size):
        sides = np.arange(first[begin], first[end - 1] + size[end - 1])
        sizes = np.repeat(size[begin:end], size[begin:end])
        side = np.repeat(sides, sizes)
        point = np.repeat(np.repeat(first[begin:end], size[begin:end]), sizes) + counted(sizes)
        starts = np.cumsum(sizes) - sizes
        along, across = u[point] * ex[side] + v[point] * ey[side], v[point] * ex[side] - u[point] * ey[side]
        for place, pick, of_side in zip(places, (np.minimum, np.maximum) * 2, (along, along, across, across)):
            place[sides] = pick.reduceat(of_side, starts)
    a0, a1, b0, b1 = places
    area = ((a1 - a0) * (b1 - b0)).astype(float) / (ex * ex + ey * ey)
    best = np.lexsort((ey, ex, area, of))[first]
    return component[np.searchsorted(number, names)], *(w[best] for w in (ex, ey, a0, a1, b0, b1))


def scores(page: np.ndarray, rect: Arrays, runs: Arrays, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """The mean over all pixels of the page whose centres each rectangle (ex, ey, a0, a1, b0, b1) holds,
    NaN where it holds none. Scores of runs (page, y, x0, x1, score) count in millionths, so that sums
    are exact. A row of a rectangle takes the difference of two running sums."""
    ex, ey, a0, a1, b0, b1 = rect
    norm = ex * ex + ey * ey
    ys = [(a * ey + b * ex) / norm for a in (a0, a1) for b in (b0, b1)]
    top, low = np.maximum(0, np.floor(np.minimum.reduce(ys))).astype(np.int64), np.minimum(height[page] - 1, np.ceil(np.maximum.reduce(ys))).astype(np.int64)
    sizes = np.maximum(low - top + 1, 0)
    of = np.repeat(np.arange(len(page)), sizes)
    y = top[of] + counted(sizes)
    lo, hi = np.zeros(len(y)), (width[page[of]] - 1).astype(float)
    # n x lies between p and q: what that says of x
    for n, p, q in ((ex, a0[of] - y * ey[of], a1[of] - y * ey[of]), (-ey, b0[of] - y * ex[of], b1[of] - y * ex[of])):
        n = n[of]
        d = np.where(n != 0, n, 1)
        lo = np.where(n != 0, np.maximum(lo, np.ceil(np.where(n > 0, p, q) / d)), lo)
        hi = np.where(n != 0, np.minimum(hi, np.floor(np.where(n > 0, q, p) / d)), np.where((p > 0) | (q < 0), -1.0, hi))
    held = lo <= hi
    of, y, lo, hi = of[held], y[held], lo[held].astype(np.int64), hi[held].astype(np.int64)
    pixels, total = np.zeros(len(page), np.int64), np.zeros(len(page), np.int64)
    np.add.at(pixels, of, hi - lo + 1)

    at, v, x0, x1, score = runs
    x0, x1, score = np.maximum(x0, 0), np.minimum(x1, width[at] - 1), np.floor(np.nan_to_num(score) * 1e6 + 0.5).astype(np.int64)
    kept = (v >= 0) & (v < height[at]) & (x0 <= x1) & (score != 0)
    at, v, x0, x1, score = (w[kept] for w in (at, v, x0, x1, score))
    if len(v) and len(y):
        high, wide = int(height.max()), int(width.max()) + 2
        rows, number = np.unique(at * high + v, return_inverse=True)
        key = page[of] * high + y
        row = np.minimum(np.searchsorted(rows, key), len(rows) - 1)
        met = rows[row] == key
        row, of, lo, hi = row[met], of[met], lo[met], hi[met]
        for sign, x in ((1, x0), (-1, x1 + 1)):  # what begins, less what has ended
            places = number * wide + x
            order = np.argsort(places, kind="stable")
            places, n, nx = places[order], np.append(0, np.cumsum(score[order])), np.append(0, np.cumsum((score * x)[order]))
            start = np.searchsorted(places, row * wide)
            for side, upto in ((sign, hi + 1), (-sign, lo)):
                k = np.searchsorted(places, row * wide + upto)
                np.add.at(total, of, side * (upto * (n[k] - n[start]) - (nx[k] - nx[start])))
    return np.divide(total, pixels * 1000000, out=np.full(len(page), np.nan), where=pixels > 0)


def _found(runs: Arrays, width: np.ndarray, height: np.ndarray, thresh: float, least: float, side: int, dilate: bool) -> Arrays:
    """page, component, ex, ey, a0, a1, b0, b1, score of the rectangles of all pages; pages are numbers."""
    on = ~(runs[4] <= thresh)
    page, y, x0, x1 = masked(*(v[on] for v in runs[:4]), width, height, dilate)
    component, *rect = rectangles(joined(page, y, x0, x1), y, x0, x1)
    ex, ey, a0, a1, b0, b1 = rect
    n = np.sqrt((ex * ex + ey * ey).astype(float))
    kept = np.minimum((a1 - a0) / n, (b1 - b0) / n) >= side
    component, rect = component[kept], tuple(v[kept] for v in rect)
    score = scores(page[component], rect, runs, width, height)
    kept = score >= least
    component = component[kept]
    return page[component], (y[component] << 32) + x0[component], *(v[kept] for v in rect), score[kept]


def listed(batch: pa.RecordBatch) -> Iterator[Arrays]:
    """Runs from an array of structs y, x0, x1, score in each row: the row that each is from, and these."""
    sizes = pc.fill_null(pc.list_value_length(batch["runs"]), 0).to_numpy()
    for lo, hi in slices(sizes):
        runs = batch["runs"].slice(lo, hi - lo).flatten()
        yield np.repeat(np.arange(lo, hi), sizes[lo:hi]), *(v.to_numpy(zero_copy_only=False) for v in runs.flatten())


def _pages(runs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Pages as rows: the columns of shapes, and runs as listed() reads them."""
    r = runs.select("page", *(F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")), F.col("score").cast("double").alias("score")).dropna()
    return shapes.join(r.groupBy("page").agg(F.collect_list(F.struct("y", "x0", "x1", "score")).alias("runs")), "page")


def _by_batch(pages: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Arrays]], run: Callable[[Arrays, np.ndarray, np.ndarray], Arrays], shown: list[str], made: str) -> DataFrame:
    """The columns `shown` of pages and those that run(runs, widths, heights) makes, whose first array
    is the place of the page."""
    kinds = dict(pages.dtypes)
    out = pages.sparkSession.createDataFrame([], ", ".join([*(f"{c} {kinds[c]}" for c in shown), made])).schema

    def found(batches):
        arrow = to_arrow_schema(out)
        for batch in batches:
            width, height = (batch[c].to_numpy().astype(np.int64) for c in ("width", "height"))
            for runs in read(batch):
                page, *got = run(runs, width, height)
                columns = [*(batch[c].take(pa.array(page)) for c in shown), *map(pa.array, got)]
                yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow).to_batches()

    return pages.dropna(subset=["page", "width", "height"]).mapInArrow(found, out)


def mask(runs: DataFrame, shapes: DataFrame, thresh: float = THRESH, dilate: bool = True) -> DataFrame:
    """page, id, y, x0, x1: runs of what counts, as long as possible. With dilate each pixel also
    sets those right of it, below it and both, within the page (width, height of shapes)."""
    def run(found, width, height):
        on = ~(found[4] <= thresh)
        page, y, x0, x1 = masked(*(v[on] for v in found[:4]), width, height, dilate)
        return page, (y << 32) + x0, y, x0, x1

    return _by_batch(_pages(runs, shapes), listed, run, ["page"], "id long, y long, x0 long, x1 long")


def components(runs: DataFrame) -> DataFrame:
    """Adds `component`, the least id of the runs that a run is joined to by runs that touch in rows
    next to each other, at corners too; ids are in the order of y and x0."""
    def run(page):
        y, x0, x1 = (page[c] for c in ("y", "x0", "x1"))
        return np.arange(len(y)), {"component": page["pos"][joined(np.zeros(len(y), np.int64), y, x0, x1)]}

    columns = ", ".join(f"{name} {kind}" for name, kind in runs.dtypes)
    return by_page(runs.withColumn("pos", F.col("id")), run, ["pos", "y", "x0", "x1"], f"{columns}, component {dict(runs.dtypes)['id']}")


def text_boxes(runs: DataFrame, shapes: DataFrame, thresh: float = THRESH, least: float = SCORE, grow: float = GROW, side: int = SIDE, dilate: bool = True) -> DataFrame:
    """page, component, x1, y1 to x4, y4 (whole pixels of the picture: left top, right top, right
    bottom, left bottom), score: the boxes of text.

    shapes: page, width, height (of the map), src_width, src_height (of the picture). A rectangle
    grows on each side by grow times its area over its perimeter, which is what an offset with round
    corners gives. Rectangles with a side under `side`, a mean score under `least`, or a grown side
    under side + 2 drop, and boxes no longer than `side` in the picture. Of two corners equally far left
    the upper comes first. Holes are no components of their own, and there is no limit to the number
    of boxes of a page. Rows with a null and pages without a shape take no part.
    """
    return page_boxes(_pages(runs, shapes), listed, thresh, least, grow, side, dilate)


def page_boxes(pages: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Arrays]] = listed, thresh: float = THRESH, least: float = SCORE, grow: float = GROW, side: int = SIDE, dilate: bool = True) -> DataFrame:
    """text_boxes of pages that are a row each: the columns of shapes, and columns from which read takes
    their runs, all runs of a page at once."""
    run = lambda runs, width, height: _found(runs, width, height, thresh, least, side, dilate)
    found = _by_batch(pages, read, run, ["page", "width", "height", "src_width", "src_height"], "component long, ex long, ey long, a0 long, a1 long, b0 long, b1 long, score double")
    norm = F.sqrt((F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")).cast("double"))
    found = found.withColumn("n", norm).withColumn("long", (F.col("a1") - F.col("a0")) / F.col("n")).withColumn("wide", (F.col("b1") - F.col("b0")) / F.col("n"))
    found = found.withColumn("d", F.col("long") * F.col("wide") * grow / (2 * (F.col("long") + F.col("wide")))).where(F.least("long", "wide") + 2 * F.col("d") >= side + 2)
    out = lambda c, sign: F.col(c) + sign * F.col("d") * F.col("n")
    fit = lambda v, size, src: F.greatest(F.lit(0.0), F.least(F.floor(v / F.col(size) * F.col(src) + 0.5), F.col(src) - 1)).cast("int")
    n2 = F.col("n") * F.col("n")
    corners = [F.struct(fit((a * F.col("ex") - b * F.col("ey")) / n2, "width", "src_width").alias("x"), fit((a * F.col("ey") + b * F.col("ex")) / n2, "height", "src_height").alias("y")) for a in (out("a0", -1), out("a1", 1)) for b in (out("b0", -1), out("b1", 1))]
    # inline keeps what it is given from being worked out again wherever it is named
    by_x = found.select("page", "component", "score", F.inline(F.array(F.struct(F.array_sort(F.array(*corners)).alias("c")))))
    pair = lambda i: F.array_sort(F.transform(F.slice("c", i, 2), lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    sides = by_x.withColumn("l", pair(1)).withColumn("r", pair(3))
    order = [F.get("l", F.lit(0)), F.get("r", F.lit(0)), F.get("r", F.lit(1)), F.get("l", F.lit(1))]
    boxes = sides.select("page", "component", F.inline(F.array(F.struct(*(p[c].alias(f"{c}{i + 1}") for i, p in enumerate(order) for c in "xy")))), "score")
    length = lambda i: F.floor(F.sqrt((F.col(f"x{i}") - F.col("x1")).cast("double") ** 2 + (F.col(f"y{i}") - F.col("y1")).cast("double") ** 2) + 0.5)
    return boxes.where((length(2) > side) & (length(4) > side))
