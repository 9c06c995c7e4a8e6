"""Geometry of boxes, one query for each expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.plans.views import BOXES, EVERY, PAIRS, boxes, micro, micro_sql, pairs

A, B = G.Box.named("a_"), G.Box.named("b_")
#: Pieces of SQL: width and height of the intersection, areas.
_W = "(least(a_x1, b_x1) - greatest(a_x0, b_x0))"
_H = "(least(a_y1, b_y1) - greatest(a_y0, b_y0))"
_AREA = {k: f"(({k}_x1 - {k}_x0) * ({k}_y1 - {k}_y0))" for k in "ab"}
_CUT = f"(greatest(0.0::DOUBLE, {_W}) * greatest(0.0::DOUBLE, {_H}))"


def _pair(out, sql: str, every: bool = False):
    """A number for each pair, in millionths."""
    def run(spark, sf_dir):
        return pairs(spark, sf_dir, every).select("page", "i", "j", micro(out()).alias("v"))
    return run, f"WITH {EVERY if every else PAIRS} SELECT page, i, j, {micro_sql(sql)} AS v FROM pairs"


def _flag(out, sql: str, every: bool = False):
    """A truth value for each pair."""
    def run(spark, sf_dir):
        return pairs(spark, sf_dir, every).select("page", "i", "j", out().alias("v"))
    return run, f"WITH {EVERY if every else PAIRS} SELECT page, i, j, {sql} AS v FROM pairs"


def _box(columns, sql: dict, where: str | None = None):
    """Columns for each box."""
    def run(spark, sf_dir):
        b = boxes(spark, sf_dir)
        b = b.where(where) if where else b
        return b.select("page", "pos", *(c.alias(k) for k, c in columns().items()))
    return run, f"WITH {BOXES} SELECT page, pos, {', '.join(f'{s} AS {k}' for k, s in sql.items())} FROM boxes" + (f" WHERE {where}" if where else "")


def _relative(spark, sf_dir):
    return pairs(spark, sf_dir).select("page", "i", "j", *(c.alias(k) for k, c in G.relative_position(A, B).items()))


P = G.Box.named()
ANGLE = lambda: F.element_at(F.array(F.lit("0"), F.lit("90"), F.lit("180"), F.lit("270")), (F.col("pos") % 4 + 1).cast("int"))
POLY = lambda: F.array(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("x0"), F.col("y1"))
_BACK = lambda: G.unrotate(POLY(), ANGLE(), F.lit(1000.0), F.lit(1400.0))
_ODD = lambda: F.array(F.col("x0") + 0.3, F.col("y0") - 5.6, F.col("x1") + 0.7, F.col("y0") - 5.6, F.col("x1") + 0.7, F.col("y1") + 0.2, F.col("x0") + 0.3, F.col("y1") + 0.2)
_WHOLE = lambda: G.whole_box(_ODD(), F.lit(600).cast("long"), F.lit(720).cast("long"))
_TILT = lambda: F.array(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y0") + F.col("pos"), F.col("x1"), F.col("y1") + F.col("pos") * 2, F.col("x0"), F.col("y1"))
_BIG = lambda: G.unclip(P, F.when(F.col("category_id") == 3, 1.2).otherwise(1.0), F.when(F.col("category_id") == 3, 1.1).otherwise(1.0))
_GAIN = 0.5


def _scaled(x, pad: float, most: float):
    return F.greatest(F.lit(0.0), F.least(F.lit(most), (x - pad) / _GAIN))


def _canvas():
    turns = (0, 90, 180, 270)

    def columns():
        out = {}
        for r in turns:
            c = G.canvas(P, r, F.lit(700.0), F.lit(800.0))
            out |= {f"x_{r}": micro(c.x0), f"y_{r}": micro(c.y0), f"w_{r}": micro(c.width), f"h_{r}": micro(c.height)}
        return out

    sql = {}
    for r in turns:
        x, y = {0: ("x0", "800 - y1"), 90: ("y0", "x0"), 180: ("700 - x1", "y0"), 270: ("700 - y1", "800 - x1")}[r]
        w, h = ("y1 - y0", "x1 - x0") if r in (90, 270) else ("x1 - x0", "y1 - y0")
        sql |= {f"x_{r}": micro_sql(x), f"y_{r}": micro_sql(y), f"w_{r}": micro_sql(w), f"h_{r}": micro_sql(h)}
    return _box(columns, sql)


def _eight(k: int, cases: dict[str, tuple[str, str, str, str]]) -> str:
    at = [0, 1, 2, 1, 2, 3, 0, 3][k]
    return micro_sql("CASE pos % 4 " + " ".join(f"WHEN {a} THEN {c[at]}" for a, c in cases.items()) + " END")


_TURNS = {"0": ("x0", "y0", "x1", "y1"), "1": ("999 - y1", "x0", "999 - y0", "x1"), "2": ("999 - x1", "1399 - y1", "999 - x0", "1399 - y0"), "3": ("y0", "1399 - x1", "y1", "1399 - x0")}
_XO = "(greatest(a_x0, b_x0) < least(a_x1, b_x1))"
_YO = "(greatest(a_y0, b_y0) < least(a_y1, b_y1))"

QUERIES = {
    "geo_is_in": _flag(lambda: G.inside(A, B), "a_x0 >= b_x0 AND a_y0 >= b_y0 AND a_x1 <= b_x1 AND a_y1 <= b_y1", every=True),
    "geo_relpos": (_relative, f'WITH {PAIRS} SELECT page, i, j, b_x1 < a_x0 AS "left", a_x1 < b_x0 AS "right", b_y1 < a_y0 AS bottom, a_y1 < b_y0 AS top FROM pairs'),
    "geo_distance": _pair(lambda: G.distance(A, B), "sqrt(pow(greatest(0.0::DOUBLE, a_x0 - b_x1, b_x0 - a_x1), 2) + pow(greatest(0.0::DOUBLE, a_y0 - b_y1, b_y0 - a_y1), 2))"),
    "geo_center": _pair(lambda: G.center_distance(A, B), "sqrt(pow((a_x0 + a_x1) / 2 - (b_x0 + b_x1) / 2, 2) + pow((a_y0 + a_y1) / 2 - (b_y0 + b_y1) / 2, 2))"),
    "geo_iou": _pair(lambda: G.iou(A, B), f"{_CUT} / ({_AREA['a']} + {_AREA['b']} - {_CUT})"),
    "geo_minbox": _flag(lambda: G.smaller_if_overlapping(A, B, 0.3), f"CASE WHEN {_CUT} / least({_AREA['a']}, {_AREA['b']}) > 0.3::DOUBLE THEN CASE WHEN {_AREA['a']} <= {_AREA['b']} THEN 1 ELSE 2 END END"),
    "geo_overlap1": _pair(lambda: G.overlap_of_first(A, B), f"{_CUT} / {_AREA['a']}", every=True),
    "geo_vproj": _pair(lambda: G.x_overlap_of_first(A, B), f"greatest(0.0::DOUBLE, {_W}) / (a_x1 - a_x0)", every=True),
    "geo_yoverlap": _flag(lambda: G.overlaps_y(A, B, 0.6), f"greatest(0.0::DOUBLE, {_H}) / least(a_y1 - a_y0, b_y1 - b_y0) > 0.6::DOUBLE"),
    "geo_inside": _flag(lambda: G.mostly_inside(A, B), f"{_W} > 0 AND {_H} > 0 AND {_W} * {_H} >= {_AREA['a']} * 0.8::DOUBLE", every=True),
    "geo_proj": (
        lambda spark, sf_dir: pairs(spark, sf_dir).select("page", "i", "j", *(micro(G.projection_overlap(A, B, d, m)).alias(f"{d[0]}_{m}") for d in ("horizontal", "vertical") for m in ("union", "small", "large"))),
        f"WITH {PAIRS} SELECT page, i, j, " + ", ".join(
            micro_sql(f"CASE WHEN {s} > 0 THEN {s} / {w} ELSE 0 END") + f" AS {d}_{m}"
            for d, s, c in (("h", _W, "x"), ("v", _H, "y"))
            for m, w in (("union", f"(greatest(a_{c}1, b_{c}1) - least(a_{c}0, b_{c}0))"), ("small", f"least(a_{c}1 - a_{c}0, b_{c}1 - b_{c}0)"), ("large", f"greatest(a_{c}1 - a_{c}0, b_{c}1 - b_{c}0)"))
        ) + " FROM pairs",
    ),
    "geo_overlap_mode": (
        lambda spark, sf_dir: pairs(spark, sf_dir).select("page", "i", "j", *(micro(G.area_overlap(A, B, m)).alias(f"o_{m}") for m in ("union", "small", "large"))),
        f"WITH {PAIRS} SELECT page, i, j, {micro_sql(f'{_CUT} / ({_AREA["a"]} + {_AREA["b"]} - {_CUT})')} AS o_union, {micro_sql(f'{_CUT} / least({_AREA["a"]}, {_AREA["b"]})')} AS o_small, {micro_sql(f'{_CUT} / greatest({_AREA["a"]}, {_AREA["b"]})')} AS o_large FROM pairs",
    ),
    "geo_edge": _pair(lambda: G.edge_distance(A, B, (1.0, 0.1, 2.0, 1.0)),
        f"CASE WHEN {_XO} AND {_YO} THEN 0 ELSE CASE WHEN {_XO} THEN 0 ELSE least(abs(a_x0 - b_x1), abs(a_x1 - b_x0)) * CASE WHEN a_x1 < b_x0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END END"
        f" + CASE WHEN {_YO} THEN 0 ELSE least(abs(a_y0 - b_y1), abs(a_y1 - b_y0)) * CASE WHEN a_y1 < b_y0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END END END",
    ),
    "geo_iou_px": _pair(lambda: G.pixel_iou(A, B),
        f"(greatest(0.0::DOUBLE, {_W} + 1) * greatest(0.0::DOUBLE, {_H} + 1)) / ((a_x1 - a_x0 + 1) * (a_y1 - a_y0 + 1) + (b_x1 - b_x0 + 1) * (b_y1 - b_y0 + 1) - greatest(0.0::DOUBLE, {_W} + 1) * greatest(0.0::DOUBLE, {_H} + 1))",
    ),
    "metric_iou": (
        lambda spark, sf_dir: pairs(spark, sf_dir).select("page", "i", "j", micro(G.metric_iou(G.Box(A.x1, F.when(F.col("i") % 5 != 0, A.y0), A.x0, A.y1), B)).alias("v")),
        f"WITH {PAIRS} SELECT page, i, j, CASE WHEN i % 5 = 0 THEN NULL ELSE {micro_sql(f'{_CUT} / ({_AREA["a"]} + {_AREA["b"]} - {_CUT})')} END AS v FROM pairs",
    ),
    "bbox_dir": _box(lambda: {"dir": G.direction(P), "dir15": G.direction(P, 1.5)}, {"dir": "CASE WHEN x1 - x0 >= y1 - y0 THEN 'horizontal' ELSE 'vertical' END", "dir15": "CASE WHEN (x1 - x0) * 1.5::DOUBLE >= y1 - y0 THEN 'horizontal' ELSE 'vertical' END"}),
    "restore_poly": _box(lambda: {f"p{k}": micro(_BACK()[k]) for k in range(8)}, {f"p{k}": _eight(k, _TURNS) for k in range(8)}),
    "int_bbox": _box(lambda: {f"b{k}": _WHOLE()[k] for k in range(4)},
        {
            f"b{k}": f"CASE WHEN least(600, ceil(x1 + 0.7::DOUBLE)) > least(600, floor(x0 + 0.3::DOUBLE)) AND least(720, ceil(y1 + 0.2::DOUBLE)) > greatest(0, floor(y0 - 5.6::DOUBLE)) THEN CAST({c} AS INTEGER) END"
            for k, c in enumerate(("least(600, floor(x0 + 0.3::DOUBLE))", "greatest(0, floor(y0 - 5.6::DOUBLE))", "least(600, ceil(x1 + 0.7::DOUBLE))", "least(720, ceil(y1 + 0.2::DOUBLE))"))
        },
    ),
    "bbox_points": _box(lambda: {f"{a}{k}": micro(p) for k, (x, y) in enumerate(((P.x0, P.y0), (P.x1, P.y0), (P.x1, P.y1), (P.x0, P.y1))) for a, p in (("x", x), ("y", y))},
        {f"{a}{k}": micro_sql(p) for k, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))) for a, p in (("x", x), ("y", y))},
    ),
    "tilt": _box(lambda: {"tilted": G.tilted(_TILT())}, {"tilted": "NOT ((y1 + pos * 2) - y0 BETWEEN 0.8::DOUBLE * (((y1 - y0) + (y1 + pos * 2 - (y0 + pos))) / 2) AND 1.2::DOUBLE * (((y1 - y0) + (y1 + pos * 2 - (y0 + pos))) / 2))"}),
    "unclip": _box(lambda: {k: micro(v) for k, v in zip(("u0", "u1", "u2", "u3"), (_BIG().x0, _BIG().y0, _BIG().x1, _BIG().y1))},
        {
            k: micro_sql(f"CASE WHEN category_id = 3 THEN {lo} + ({hi} - {lo}) / 2 {sign} ({hi} - {lo}) * {ratio}::DOUBLE / 2 ELSE {lo if sign == '-' else hi} END")
            for k, lo, hi, sign, ratio in (("u0", "x0", "x1", "-", 1.2), ("u1", "y0", "y1", "-", 1.1), ("u2", "x0", "x1", "+", 1.2), ("u3", "y0", "y1", "+", 1.1))
        },
    ),
    "scale_boxes": _box(lambda: {"s0": micro(_scaled(P.x0, 16.0, 900.0)), "s1": micro(_scaled(P.y0, 0.0, 1280.0)), "s2": micro(_scaled(P.x1, 16.0, 900.0)), "s3": micro(_scaled(P.y1, 0.0, 1280.0))},
        {"s0": micro_sql("greatest(0, least(900, (x0 - 16) / 0.5::DOUBLE))"), "s1": micro_sql("greatest(0, least(1280, y0 / 0.5::DOUBLE))"), "s2": micro_sql("greatest(0, least(900, (x1 - 16) / 0.5::DOUBLE))"), "s3": micro_sql("greatest(0, least(1280, y1 / 0.5::DOUBLE))")},
    ),
    "bbox_1000": _box(lambda: {k: F.floor(c * 1000 / s * 100 + 0.5).cast("long") for k, c, s in (("n0", P.x0, 720.0), ("n1", P.y0, 760.0), ("n2", P.x1, 720.0), ("n3", P.y1, 760.0))}, {k: f"CAST(floor({c} * 1000 / {s}::DOUBLE * 100 + 0.5) AS BIGINT)" for k, c, s in (("n0", "x0", 720), ("n1", "y0", 760), ("n2", "x1", 720), ("n3", "y1", 760))}),
    "fix_axis": (
        lambda spark, sf_dir: boxes(spark, sf_dir).select("page", "pos", *(F.floor(F.col(c) / 3.7 * 100).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1"))).where("x1 > x0 AND y1 > y0"),
        f"WITH {BOXES}, f AS (SELECT page, pos, " + ", ".join(f"CAST(floor({c} / 3.7::DOUBLE * 100) AS BIGINT) AS {c}" for c in ("x0", "y0", "x1", "y1")) + " FROM boxes) SELECT * FROM f WHERE x1 > x0 AND y1 > y0",
    ),
    "canvas_rect": _canvas(),
    "valid_bbox": _box(lambda: {"ok": (F.col("x0") < F.col("x1") - 100) & (F.col("y0") < F.col("y1"))}, {"ok": "x0 < x1 - 100 AND y0 < y1"}),
    "low_conf": _box(lambda: {"score": micro(F.col("score"))}, {"score": micro_sql("score")}, where="score > 0.95"),
    "enclosing": (
        lambda spark, sf_dir: boxes(spark, sf_dir).groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")),
        f"WITH {BOXES} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page",
    ),
    "line_dir": (
        lambda spark, sf_dir: boxes(spark, sf_dir).groupBy("page").agg(F.when(F.count_if(P.width * 0.3 >= P.height) >= F.count(F.lit(1)) * 0.5, "horizontal").otherwise("vertical").alias("dir")),
        f"WITH {BOXES} SELECT page, CASE WHEN count(*) FILTER ((x1 - x0) * 0.3::DOUBLE >= y1 - y0) >= count(*) * 0.5::DOUBLE THEN 'horizontal' ELSE 'vertical' END AS dir FROM boxes GROUP BY page",
    ),
    "vertical_block": (
        lambda spark, sf_dir: boxes(spark, sf_dir).where("x1 > x0 AND y1 > y0").groupBy("page").agg((F.count_if(P.height / P.width > 0.2) > F.count(F.lit(1)) * 0.8).alias("vertical")),
        f"WITH {BOXES} SELECT page, count(*) FILTER ((y1 - y0) / (x1 - x0) > 0.2::DOUBLE) > count(*) * 0.8::DOUBLE AS vertical FROM boxes WHERE x1 > x0 AND y1 > y0 GROUP BY page",
    ),
    "median_line": (
        lambda spark, sf_dir: boxes(spark, sf_dir).groupBy("page").agg(F.coalesce(F.median(F.when(F.col("category_id") == 1, F.floor(P.height))), F.lit(10.0)).alias("line_height")),
        f"WITH {BOXES} SELECT page, coalesce(median(CASE WHEN category_id = 1 THEN floor(y1 - y0) END), 10.0) AS line_height FROM boxes GROUP BY page",
    ),
    "containment": (
        lambda spark, sf_dir: pairs(spark, sf_dir, True).groupBy("page", "i").agg(F.max(G.contained(A, B).cast("int")).alias("contained_by_other"), F.max(G.contained(B, A).cast("int")).alias("contains_other")),
        f"WITH {EVERY} SELECT page, i, max(CAST({_CUT} / {_AREA['a']} >= 0.9::DOUBLE AS INTEGER)) AS contained_by_other, max(CAST({_CUT} / {_AREA['b']} >= 0.9::DOUBLE AS INTEGER)) AS contains_other FROM pairs GROUP BY page, i",
    ),
}
