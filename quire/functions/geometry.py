"""Geometry of boxes and polygons as native column expressions.

A box is x0, y0, x1, y1 (columns of double). Three conventions of intersection over union live
side by side, as callers rely on each: `iou` (strict areas, 0 for empty boxes), `metric_iou`
(corners put in order, null if a box is missing) and `pixel_iou` (both edge pixels count).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @classmethod
    def named(cls, prefix: str = "") -> Box:
        """As `of`, its columns made when they are used: needs no session before that."""
        return _Named(prefix)

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height


class _Named(Box):
    def __init__(self, prefix: str):
        object.__setattr__(self, "prefix", prefix)

    def __getattribute__(self, name: str):
        if name in ("x0", "y0", "x1", "y1"):
            return F.col(object.__getattribute__(self, "prefix") + name)
        return object.__getattribute__(self, name)


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.when(whole != 0, whole))


def _meet(a: Box, b: Box) -> tuple[Column, Column]:
    """Width and height of the intersection; negative where boxes lie apart."""
    return F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)


def _apart(a: Box, b: Box) -> Column:
    w, h = _meet(a, b)
    return (w < 0) | (h < 0)


def inside(a: Box, b: Box) -> Column:
    """a lies within b; equal boxes lie within each other."""
    return (a.x0 >= b.x0) & (a.y0 >= b.y0) & (a.x1 <= b.x1) & (a.y1 <= b.y1)


def relative_position(a: Box, b: Box) -> dict[str, Column]:
    """Where a lies from b: b ends left of it, a ends left of b, and so on; touching is neither."""
    return {"left": b.x1 < a.x0, "right": a.x1 < b.x0, "bottom": b.y1 < a.y0, "top": a.y1 < b.y0}


def distance(a: Box, b: Box) -> Column:
    """Length of the gap: between corners if the boxes lie askew, 0 if they touch."""
    dx = F.greatest(F.lit(0.0), a.x0 - b.x1, b.x0 - a.x1)
    dy = F.greatest(F.lit(0.0), a.y0 - b.y1, b.y0 - a.y1)
    return F.sqrt(dx * dx + dy * dy)


def center_distance(a: Box, b: Box) -> Column:
    dx, dy = (a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, (a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2
    return F.sqrt(dx * dx + dy * dy)


def iou(a: Box, b: Box) -> Column:
    w, h = _meet(a, b)
    common = w * h
    whole = a.area + b.area - common
    return F.when(_apart(a, b) | (a.area == 0) | (b.area == 0), F.lit(0.0)).otherwise(_ratio(common, whole))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    w, h = _meet(a, b)
    return F.when(_apart(a, b), F.lit(0.0)).otherwise(_ratio(w * h, F.least(a.area, b.area)))


def overlap_of_first(a: Box, b: Box) -> Column:
    """Intersection over the area of a."""
    w, h = _meet(a, b)
    return F.when(_apart(a, b), F.lit(0.0)).otherwise(_ratio(w * h, a.area))


def smaller_if_overlapping(a: Box, b: Box, ratio: float) -> Column:
    """1 or 2 for the smaller box (a on a tie) where more than ratio of it is covered, else null."""
    return F.when(overlap_of_smaller(a, b) > ratio, F.when(a.area <= b.area, F.lit(1)).otherwise(F.lit(2)))


def x_overlap_of_first(a: Box, b: Box) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    return F.when(w < 0, F.lit(0.0)).otherwise(_ratio(w, a.width))


def overlaps_y(a: Box, b: Box, ratio: float = 0.8) -> Column:
    """Shared height over the lesser height exceeds ratio."""
    shared, least = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)), F.least(a.height, b.height)
    return F.when(least > 0, shared / F.when(least > 0, least) > ratio).otherwise(F.lit(False))


def overlaps_x(a: Box, b: Box, ratio: float = 0.8) -> Column:
    shared, least = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)), F.least(a.width, b.width)
    return F.when(least > 0, shared / F.when(least > 0, least) > ratio).otherwise(F.lit(False))


def mostly_inside(a: Box, b: Box, ratio: float = 0.8) -> Column:
    """At least ratio of a lies within b; boxes that only touch do not."""
    w, h = _meet(a, b)
    return (w > 0) & (h > 0) & (w * h >= a.area * ratio)


def projection_overlap(a: Box, b: Box, direction: str = "horizontal", mode: str = "union") -> Column:
    lo_a, hi_a, lo_b, hi_b = (a.x0, a.x1, b.x0, b.x1) if direction == "horizontal" else (a.y0, a.y1, b.y0, b.y1)
    shared = F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b)
    whole = {
        "union": F.greatest(hi_a, hi_b) - F.least(lo_a, lo_b),
        "small": F.least(hi_a - lo_a, hi_b - lo_b),
        "large": F.greatest(hi_a - lo_a, hi_b - lo_b),
    }[mode]
    return F.when((shared <= 0) | (whole <= 0), F.lit(0.0)).otherwise(shared / F.when(whole > 0, whole))


def area_overlap(a: Box, b: Box, mode: str = "union") -> Column:
    w, h = _meet(a, b)
    common = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    one, two = F.abs(a.area), F.abs(b.area)
    whole = {"union": one + two - common, "small": F.least(one, two), "large": F.greatest(one, two)}[mode]
    return _ratio(common, whole)


def edge_distance(a: Box, b: Box, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)) -> Column:
    """Weighted gaps (left, right, up, down) along the axes on which the boxes do not overlap."""
    across, along = projection_overlap(a, b, "horizontal"), projection_overlap(a, b, "vertical")
    dx = F.least(F.abs(a.x0 - b.x1), F.abs(a.x1 - b.x0)) * F.when(a.x1 < b.x0, F.lit(weights[0])).otherwise(F.lit(weights[1]))
    dy = F.least(F.abs(a.y0 - b.y1), F.abs(a.y1 - b.y0)) * F.when(a.y1 < b.y0, F.lit(weights[2])).otherwise(F.lit(weights[3]))
    return F.when((across > 0) & (along > 0), F.lit(0.0)).otherwise(F.when(across == 0, dx).otherwise(F.lit(0.0)) + F.when(along == 0, dy).otherwise(F.lit(0.0)))


def direction(a: Box, ratio: float = 1.0) -> Column:
    return F.when(a.width * ratio >= a.height, "horizontal").otherwise("vertical")


def pixel_iou(a: Box, b: Box) -> Column:
    w, h = _meet(a, b)
    common = F.greatest(F.lit(0.0), w + 1) * F.greatest(F.lit(0.0), h + 1)
    size = lambda x: (x.width + 1) * (x.height + 1)
    return common / (size(a) + size(b) - common)


def contained(a: Box, b: Box, ratio: float = 0.9) -> Column:
    """At least ratio of a's area lies in b; an empty box lies in none."""
    w, h = _meet(a, b)
    common = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    return F.when(a.area > 0, common / F.when(a.area > 0, a.area) >= ratio).otherwise(F.lit(False))


def ordered(a: Box) -> Box:
    return Box(F.least(a.x0, a.x1), F.least(a.y0, a.y1), F.greatest(a.x0, a.x1), F.greatest(a.y0, a.y1))


def metric_iou(a: Box, b: Box) -> Column:
    missing = a.x0.isNull() | a.y0.isNull() | a.x1.isNull() | a.y1.isNull() | b.x0.isNull() | b.y0.isNull() | b.x1.isNull() | b.y1.isNull()
    a, b = ordered(a), ordered(b)
    w, h = _meet(a, b)
    common = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    whole = a.area + b.area - common
    return F.when(missing, F.lit(None)).when(whole <= 0, F.lit(0.0)).otherwise(common / F.when(whole > 0, whole))


def unclip(a: Box, across: Column, along: Column) -> Box:
    """Scaled about the centre."""
    w, h, cx, cy = a.width * across, a.height * along, a.x0 + a.width / 2, a.y0 + a.height / 2
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def to_points(x: Column, scale: Column) -> Column:
    """Pixels to page points, cut to hundredths."""
    return F.floor(x / scale * 100) / 100


def per_mille(value: Column, size: Column) -> Column:
    """Whole thousandths of the page size, cut towards zero."""
    return (value * 1000 / size).cast("int")


def unrotate(poly: Column, angle: Column, width: Column, height: Column) -> Column:
    """A box (8 numbers) found on a rotated image, on the image as it was. Other angles raise."""
    x0, y0, x1, y1 = poly[0], poly[1], poly[2], poly[5]
    def eight(a, b, c, d):
        return F.array(a, b, c, b, c, d, a, d)
    turned = F.when(angle == "90", eight(width - 1 - y1, x0, width - 1 - y0, x1))
    turned = turned.when(angle == "270", eight(y0, height - 1 - x1, y1, height - 1 - x0))
    turned = turned.when(angle == "180", eight(width - 1 - x1, height - 1 - y1, width - 1 - x0, height - 1 - y0))
    return F.when(angle == "0", poly).otherwise(turned.otherwise(F.raise_error(F.concat(F.lit("unsupported angle: "), angle))))


def poly_bounds(poly: Column) -> Box:
    """Smallest box around a flat list of x, y, x, y, ..."""
    xs, ys = F.filter(poly, lambda _, i: i % 2 == 0), F.filter(poly, lambda _, i: i % 2 == 1)
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def whole_box(poly: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Box of whole numbers around 4 numbers (a box) or 8 and more (points), within an image if
    its size is given; null for other lengths and for boxes without extent."""
    b = poly_bounds(poly)
    four = F.size(poly) == 4
    corners = [F.when(four, poly[k]).otherwise(c) for k, c in enumerate((b.x0, b.y0, b.x1, b.y1))]
    whole = [F.floor(c) if k < 2 else F.ceil(c) for k, c in enumerate(corners)]
    if width is not None:
        whole = [F.greatest(F.lit(0), F.least(height if k % 2 else width, c)) for k, c in enumerate(whole)]
    fits = (four | (F.size(poly) >= 8)) & (whole[2] > whole[0]) & (whole[3] > whole[1])
    return F.when(fits, F.array(*(c.cast("int") for c in whole)))


def char_in_span(char: Box, span: Box, text: Column, stops: list[str], starts: list[str], ratio: float | None = 0.33) -> Column:
    """A character's centre lies within a span near its middle line; marks that end or begin a
    line may stick out by one span height. ratio None: at any height within the span."""
    cx, cy = (char.x0 + char.x1) / 2, (char.y0 + char.y1) / 2
    tall = span.height
    level = (cy > span.y0) & (cy < span.y1)
    if ratio is not None:
        level = level & (F.abs(cy - (span.y0 + span.y1) / 2) < tall * ratio)
    within = (cx > span.x0) & (cx < span.x1)
    after = text.isin(stops) & (char.x0 > span.x1 - tall) & (char.x0 < span.x1) & (cx > span.x0)
    before = ~text.isin(stops) & text.isin(starts) & (char.x1 > span.x0) & (char.x1 < span.x0 + tall) & (cx < span.x1)
    return level & (within | after | before)


def tilted(poly: Column) -> Column:
    """Of 8 numbers clockwise from the top left: whether its height strays by more than a fifth."""
    tall = ((poly[7] - poly[1]) + (poly[5] - poly[3])) / 2
    rise = poly[5] - poly[1]
    return ~((rise >= tall * 0.8) & (rise <= tall * 1.2))


def canvas(a: Box, rotation: int, width: Column, height: Column) -> Box:
    """A box of a page (origin top left) on the canvas (origin bottom left) of a rotated page."""
    if rotation == 270:
        return Box(width - a.y1, height - a.x1, width - a.y0, height - a.x0)
    if rotation == 180:
        return Box(width - a.x1, a.y0, width - a.x0, a.y1)
    if rotation == 90:
        return Box(a.y0, a.x0, a.y1, a.x1)
    return Box(a.x0, height - a.y1, a.x1, height - a.y0)
