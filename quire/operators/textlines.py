"""Text lines of layout regions, in either direction of writing.

spans: page, region, pos, label (text or formula), text, x0, y0, x1, y1. Regions never meet. Which
line a span is in depends on the spans before it. A region is a row with its spans as an array, so
that they are shuffled once; regions pass many in a batch.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: The share of the lesser height from which a span is in a line; how much wider than
#: high text may be to run down; a line of a region that runs down is kept up to KEEP times the
#: narrowest if the widest is over twice it and under MOST of all are that narrow.
RATIO, LEAN, KEEP, MOST = 0.6, 1.5, 1.1, 0.4
#: Punctuation after which a line goes on.
GOES_ON = [",", "，", "、", ";", "；", ":", "：", "-", "'", '"', "“"]


#: A letter at the end, or before the end of the last line.
_LETTER = re.compile(r"[A-Za-z](?:\r\n|[\n\r\x85\u2028\u2029])?\Z")
_WORD = re.compile("[A-Za-z0-9]")
#: A span: pos, label, text, and its place along (a0, a1) and across (c0, c1) the lines; a piece of one:
#: the same with the number of the piece after pos.
Span = tuple[int, str, str, float, float, float, float]
Piece = tuple[int, int, str, str, float, float, float, float]


def lines(spans: list[tuple], ratio: float = RATIO) -> tuple[bool, list[tuple[int, list[Span]]]]:
    """Whether the region of the spans (pos, label, text, x0, y0, x1, y1) runs across, and its lines by
    number (from 1).

    A region runs across if at least half of its text spans do. Spans from the top (from the right,
    where it runs down), ties by pos; a span stays in the line if it shares at least ratio of the
    lesser height with the line so far. Where it runs down, lines much wider than most drop (see
    KEEP). Without text spans a region runs across.
    """
    text = [s for s in spans if s[1] == "text"]
    flat = sum((s[5] - s[3]) * LEAN >= s[6] - s[4] for s in text) >= len(text) * 0.5
    turned = [(p, label, said, x0, x1, y0, y1) if flat else (p, label, said, y0, y1, x0, x1) for p, label, said, x0, y0, x1, y1 in spans if p is not None]
    turned.sort(key=lambda s: (s[5] if flat else -s[5], s[0], s[5], s[6]))
    out: list[list[Span]] = []
    reach: list[tuple[float, float]] = []  # from where to where each line goes
    for s in turned:
        lo, hi = s[5:]
        if out:
            low, high = reach[-1]
            shared, least = min(high, hi) - max(low, lo), min(high - low, hi - lo)
            if shared > 0 and least > 0 and shared / least >= ratio:
                out[-1].append(s)
                reach[-1] = min(low, lo), max(high, hi)
                continue
        out.append([s])
        reach.append((lo, hi))
    found = list(enumerate(out, 1))
    if not flat and found:
        heights = [hi - lo for lo, hi in reach]
        thin = min(heights)
        if max(heights) > thin * 2 and sum(h < thin * KEEP for h in heights) < len(heights) * MOST:
            found = [line for line, h in zip(found, heights) if h <= thin * KEEP]
    return flat, found


def pieces(line: list[Span]) -> list[Piece]:
    """The spans of a line, text spans cut around the formulas that lie within them along the line. Parts
    of a cut span no wider than a pixel drop; the others have no text (None), as it must be read anew."""
    formulas = sorted((s[3], s[4]) for s in line if s[1] == "formula")
    starts, out = [f[0] for f in formulas], []
    for pos, label, text, a0, a1, c0, c1 in line:
        inside = [f for f in formulas[bisect_left(starts, a0) : bisect_right(starts, a1)] if f[1] <= a1] if label == "text" and formulas else []
        if not inside:
            out.append((pos, 0, label, text, a0, a1, c0, c1))
            continue
        at, parts = a0, []
        for f0, f1 in inside:
            parts.append((at, f0))
            at = max(at, f1)
        kept = sorted(part for part in (*parts, (at, a1)) if part[1] - part[0] > 1)
        out += [(pos, k, label, None, *part, c0, c1) for k, part in enumerate(kept, 1)]
    return out


def _said(label: str, text: str) -> str:
    if label == "formula":
        return f"${text}$ " if not text.startswith("$") and not text.endswith("$") else f"{text} "
    return f"{text} " if _LETTER.search(text) else text


def region(spans: list[tuple], ratio: float = RATIO) -> Iterator[tuple]:
    """line to y1 of text_lines() of one region's spans (see lines())."""
    flat, found = lines(spans, ratio)
    cut = [(number, sorted(pieces(line), key=lambda p: (math.floor(p[4] / 2), p[6], p[0], p[1]))) for number, line in found]
    cut = [(number, line) for number, line in cut if line]
    low, high = (min(p[4] for _, line in cut for p in line), max(p[5] for _, line in cut for p in line)) if cut else (0.0, 0.0)
    for number, line in cut:
        text = "".join(_said(p[2], p[3] or "") for p in line).rstrip(" ")
        a0, a1, c0, c1 = min(p[4] for p in line), max(p[5] for p in line), min(p[6] for p in line), max(p[7] for p in line)
        last, room, free = text[-1:], (c1 - c0) * 1.5, high - line[-1][5]
        mark = not _WORD.match(last) and last not in GOES_ON
        ends = text != "" and (mark or free > (high - low) * 0.3) and (free > room or (not flat and line[0][4] - low > room))
        place = (a0, c0, a1, c1) if flat else (c0, a0, c1, a1)
        yield number, flat, len(line), sum(p[3] is None for p in line), text.removesuffix("-"), ends, *place


def text_lines(spans: DataFrame, ratio: float = RATIO) -> DataFrame:
    """page, region, line, flat, n (pieces), unread (those without text), text, ends (whether a new
    line begins after it), x0, y0, x1, y1.

    Pieces along the line, those that begin within the same two pixels from the top (or left). A
    formula stands between dollars unless it has one at either end already; a blank follows formulas
    and pieces that end in a letter A-Z; a hyphen at the end of the line is taken away. A line ends
    if it leaves more than three tenths of the region's length free behind it, or more than one and
    a half of its height after a mark other than those of GOES_ON; where the region runs down, room
    of that much height before the first piece counts too. Spans with a null in page, region or a
    corner take no part.
    """
    corners, keys = ("x0", "y0", "x1", "y1"), ("page", "region")
    s = spans.dropna(subset=[*keys, *corners])
    one = F.struct(F.col("pos").cast("long").alias("pos"), "label", "text", *(F.col(c).cast("double").alias(c) for c in corners))
    regions = s.groupBy(*keys).agg(F.collect_list(one).alias("spans"))
    out = spans.sparkSession.createDataFrame([], ", ".join([*(f"{c} {dict(spans.dtypes)[c]}" for c in keys), "line int, flat boolean, n long, unread long, text string, ends boolean, x0 double, y0 double, x1 double, y1 double"])).schema

    def found(batches):
        arrow = to_arrow_schema(out)
        for batch in batches:
            of, ends = batch["spans"], [0, *pc.cumulative_sum(pc.list_value_length(batch["spans"])).to_pylist()]
            every = list(zip(*(v.to_pylist() for v in of.flatten().flatten())))
            at, rows = [], []
            for k in range(len(of)):
                for row in region(every[ends[k] : ends[k + 1]], ratio):
                    at.append(k)
                    rows.append(row)
            columns = [*(batch[c].take(pa.array(at, pa.int64())) for c in keys), *(pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * (len(arrow) - 2), list(arrow)[2:]))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return regions.mapInArrow(found, out)
