"""Cells of a table from its ruling lines.

Segments (page, x0, y0, x1, y1), a table's lines as a detector finds them: broken, a little slanted,
a little off. The segments of a page are an array; pages pass many in a batch, sorts and searches
take all pages of a batch at once, and pages never meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.operators.greedy import FIELDS

#: Pixels: segments this near are on one line, pieces of a line this far apart are joined, and lines
#: may miss or pass the line that they meet by so much.
NEAR, JOIN, REACH = 6.0, 10.0, 8.0
#: Segments, or pairs of pieces that may meet, that are worked on together (or one page's, one piece's).
_AT_ONCE = 1 << 18


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a < b where NaN is the greatest number, as in Spark."""
    return (a < b) | (np.isnan(b) & ~np.isnan(a))


def _differ(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before; the first does."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _nth(new: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The number, from 0 in each group, of the run that a row is in; new marks where runs begin."""
    count = np.cumsum(new)
    first = np.flatnonzero(_differ(group))
    return count - np.repeat(count[first], np.diff(np.append(first, len(group))))


def _before(group: np.ndarray, at: np.ndarray, of: np.ndarray, value: np.ndarray, too: bool) -> np.ndarray:
    """How many of the rows, sorted by group and at, come before the value in the group `of`; with
    too those that are equal count."""
    n = len(group)
    later = np.concatenate([np.full(n, not too), np.full(len(of), too)])
    order = np.lexsort((later, np.concatenate([at, value]), np.concatenate([group, of])))
    count = np.cumsum(order < n)
    out = np.empty(len(order), np.int64)
    out[order] = count
    return out[n:]


def counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 and so on below each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from start up to stop of each row, and the row that each is from."""
    size = np.maximum(stop - start, 0)
    row = np.repeat(np.arange(len(size)), size)
    return start[row] + counted(size), row


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum up to _AT_ONCE at most, or of one row."""
    upto, lo = np.cumsum(sizes), 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _AT_ONCE, "right")))
        yield lo, hi
        lo = hi


def _pieces(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, near: float, join: float) -> tuple[np.ndarray, ...]:
    """group (twice the page, one more for lines that run across), line, at, lo, hi of the pieces of
    lines, sorted by all of them.

    A segment runs across if it is at least as wide as high; it lies at the mean of its ends. Sorted
    by place, segments no further than near from the one before are one line, in the middle of its
    outermost segments; pieces of a line that overlap or are join apart at most are one.
    """
    dx, dy = x1 - x0, y1 - y0
    kept = (dx != 0) | (dy != 0)
    flat = ~_less(np.abs(dx), np.abs(dy))
    at = np.where(flat, y0 + y1, x0 + x1) / 2
    a, b = np.where(flat, x0, y0), np.where(flat, x1, y1)
    group, at, lo, hi = (v[kept] for v in (2 * page + flat, at, np.fmin(a, b), np.maximum(a, b)))
    order = np.lexsort((at, group))
    group, at, lo, hi = (v[order] for v in (group, at, lo, hi))
    new = _differ(group)
    new[1:] |= _less(near, at[1:] - at[:-1]) & _less(at[:-1], at[1:])
    line = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    middle = (at[first] + at[last]) / 2 if len(at) else at
    order = np.lexsort((hi, lo, line))
    line, lo, hi = line[order], lo[order], hi[order]
    # how far the pieces of a line reach up to a row: a running greatest by doubling steps
    reach, step, left = hi.copy(), 1, np.arange(len(line)) - first[line]
    most = int(left.max(initial=0))
    while step <= most:
        reach[step:] = np.where(left[step:] >= step, np.maximum(reach[step:], reach[:-step]), reach[step:])
        step *= 2
    new = _differ(line)
    new[1:] |= _less(reach[:-1] + join, lo[1:])
    start = np.flatnonzero(new)
    if not len(start):
        return group, line, at, lo, hi
    line = line[start]
    return group[first][line], line, middle[line], lo[start], np.maximum.reduceat(hi, start)


def _crossed(group: np.ndarray, line: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, reach: float) -> np.ndarray:
    """Whether a piece meets two lines of the other kind. Those that it may meet lie next to each
    other in the order of place."""
    other = group ^ 1
    start, stop = _before(group, at, other, lo - reach, False), _before(group, at, other, hi + reach, True)
    out = np.zeros(len(group), bool)
    for begin, end in slices(np.maximum(stop - start, 0)):
        b, a = _spread(start[begin:end], stop[begin:end])
        a += begin
        met = ~_less(at[a], lo[b] - reach) & ~_less(hi[b] + reach, at[a])
        a, b = a[met], line[b[met]]
        out[a[1:][(a[1:] == a[:-1]) & (b[1:] != b[:-1])]] = True
    return out


def _drawn(pieces: tuple[np.ndarray, ...], lines: tuple[np.ndarray, ...], kind: int, reach: float) -> tuple[np.ndarray, ...]:
    """page, gap, line, next, each once: where lines of a kind are drawn along the whole of a gap
    between two lines of the other kind, and the next line drawn along the gap; -1: there is none."""
    group, line, _, lo, hi = (v[pieces[0] % 2 == kind] for v in pieces)
    of, number, place = (v[lines[0] % 2 != kind] for v in lines)
    # gap i lies between the i-th line and the one after it
    start, stop = _before(of, place + reach, group ^ 1, lo, False), _before(of, place - reach, group ^ 1, hi, True) - 1
    at, row = _spread(start, stop)
    page, gap, line = group[row] // 2, number[at], line[row]
    order = np.lexsort((line, gap, page))
    page, gap, line = page[order], gap[order], line[order]
    once = _differ(page, gap, line)
    page, gap, line = page[once], gap[once], line[once]
    after = np.full(len(line), -1)
    if len(line):
        after[:-1] = np.where(_differ(page, gap)[1:], -1, line[1:])
    return page, gap, line, after


def _cells(page: np.ndarray, *ends: np.ndarray, near: float, join: float, reach: float) -> tuple[np.ndarray, ...]:
    """page, row, col, row_span, col_span, x0, y0, x1, y1 of the cells of all pages; pages are numbers,
    ends the x0, y0, x1, y1 of segments."""
    pieces = _pieces(page, *ends, near, join)
    pieces = tuple(v[_crossed(*pieces, reach)] for v in pieces)
    group, line, at, lo, hi = pieces
    new = _differ(group, line)
    number = _nth(new, group)
    lines = group[new], number[new], at[new]
    pieces = group, number, at, lo, hi
    left = _drawn(pieces, lines, 0, reach)
    top = _drawn(pieces, lines, 1, reach)
    # left edges are sorted by page, row and column; upper ones by page, column and row
    keys = [np.concatenate(v) for v in ((left[0], top[0]), (left[1], top[2]), (left[2], top[1]))]
    order = np.lexsort((*keys[::-1],))
    keys, end = [k[order] for k in keys], np.concatenate([left[3], top[3]])[order]
    twice = np.flatnonzero(~_differ(*keys))  # a left edge, and then the upper one
    page, row, col = (k[twice] for k in keys)
    col_end, row_end = end[twice - 1], end[twice]
    closed = (col_end >= 0) & (row_end >= 0)
    page, row, col, row_end, col_end = (v[closed] for v in (page, row, col, row_end, col_end))
    first = np.searchsorted(lines[0], 2 * page), np.searchsorted(lines[0], 2 * page + 1)
    place = lines[2]
    return page, row, col, row_end - row, col_end - col, place[first[0] + col], place[first[1] + row], place[first[0] + col_end], place[first[1] + row_end]


def listed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments from an array of structs x0, y0, x1, y1 in each row: the row that each is from, and its
    ends. Those with a null are left out."""
    sizes = pc.fill_null(pc.list_value_length(batch["segments"]), 0).to_numpy()
    for lo, hi in slices(sizes):
        segments, page = batch["segments"].slice(lo, hi - lo).flatten(), np.repeat(np.arange(lo, hi), sizes[lo:hi])
        ends = [segments.flatten()[segments.type.get_field_index(c)] for c in FIELDS]
        whole = np.logical_and.reduce([v.is_valid().to_numpy(zero_copy_only=False) for v in ends])
        yield page[whole], *(v.to_numpy(zero_copy_only=False)[whole].astype(float) for v in ends)


def page_cells(pages: DataFrame, read: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]] = listed, near: float = NEAR, join: float = JOIN, reach: float = REACH) -> DataFrame:
    """cells of pages that are a row each: page, and columns from which read takes their segments, all
    segments of a page at once."""
    out = pages.sparkSession.createDataFrame([], f"page {dict(pages.dtypes)['page']}, row int, col int, row_span int, col_span int, x0 double, y0 double, x1 double, y1 double").schema

    def found(batches):
        arrow = to_arrow_schema(out)
        for batch in batches:
            for segments in read(batch):
                got = _cells(*segments, near=near, join=join, reach=reach)
                columns = [batch["page"].take(pa.array(got[0])), *map(pa.array, got[1:])]
                yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow).to_batches()

    return pages.where("page IS NOT NULL").mapInArrow(found, out)


def cells(segments: DataFrame, near: float = NEAR, join: float = JOIN, reach: float = REACH) -> DataFrame:
    """page, row, col (from 0), row_span, col_span, x0, y0, x1, y1: the cells that the lines enclose.

    Only pieces that meet two lines of the other kind count, so underlines and strokes drop out.
    Lines are numbered by place, and a cell begins where the lines above and left of a gap are drawn;
    it ends at the next gaps of its row and column whose right and lower lines are drawn. A face
    without such an end is open and no cell; one that is not a rectangle is given by its first row
    and column. Segments with a null or without a length take no part.
    """
    return page_cells(segments.where("page IS NOT NULL").groupBy("page").agg(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in FIELDS))).alias("segments")), listed, near, join, reach)
