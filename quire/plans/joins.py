"""Filters and joins of boxes, spans and blocks on pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import pages as P
from quire.plans.views import BOXES, boxes

TEXT, IMAGE, TABLE = 1, 3, 5
_IOU = "({c} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {c}))".format(c="(greatest(0.0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0::DOUBLE, least(a.y1, b.y1) - greatest(a.y0, b.y0)))")
_ONE = "((greatest(0.0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0::DOUBLE, least(a.y1, b.y1) - greatest(a.y0, b.y0))) / ((a.x1 - a.x0) * (a.y1 - a.y0)))"
_GAP = "sqrt(pow(greatest(0.0::DOUBLE, a.x0 - b.x1, b.x0 - a.x1), 2) + pow(greatest(0.0::DOUBLE, a.y0 - b.y1, b.y0 - a.y1), 2))"
_CENTER = "sqrt(pow((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, 2) + pow((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2, 2))"


def dense(spark, sf_dir):
    """Twenty orders a page: pages are crowded, and their number grows with the table."""
    # the page is a column before the window: what comes after finds its pages dealt already
    b = boxes(spark, sf_dir).withColumnRenamed("page", "order").withColumn("page", F.floor(F.col("order") / 20).cast("long"))
    pos = F.row_number().over(Window.partitionBy("page").orderBy("order", "pos"))
    return b.select("page", pos.alias("pos"), "category_id", "score", *P.FIELDS)


DENSE = f"{BOXES}, dense AS MATERIALIZED (SELECT page // 20 AS page, CAST(row_number() OVER (PARTITION BY page // 20 ORDER BY page, pos) AS INTEGER) AS pos, category_id, score, x0, y0, x1, y1 FROM boxes)"


def typed(spark, sf_dir):
    """Dense boxes with types of blocks and spans, and an index of reading order."""
    kinds = F.array(*map(F.lit, ["text", "title", "image_body", "table_body", "discarded", "interline_equation"]))
    spans = F.array(*map(F.lit, ["text", "image", "table", "inline_equation", "interline_equation"]))
    d = dense(spark, sf_dir)
    return d.withColumn("block", kinds[(F.col("pos") % 6).cast("int")]).withColumn("span", spans[(F.col("pos") % 5).cast("int")]).withColumn("index", F.col("pos") % 97)


TYPED = DENSE + """, typed AS (SELECT *,
    ['text', 'title', 'image_body', 'table_body', 'discarded', 'interline_equation'][pos % 6 + 1] AS block,
    ['text', 'image', 'table', 'inline_equation', 'interline_equation'][pos % 5 + 1] AS span, pos % 97 AS "index" FROM dense)"""


def _ids(df):
    return df.select("page", "pos")


def _of(spark, sf_dir, category):
    return dense(spark, sf_dir).where(F.col("category_id") == category)


def title_vs_text(spark, sf_dir):
    d = dense(spark, sf_dir)
    title, text = F.col("category_id") == IMAGE, F.col("category_id") == TEXT
    return _ids(P.drop_where(d, d.where(text), lambda a, b: G.iou(a, b) > 0.5, title))


def under_footnote(spark, sf_dir):
    d = dense(spark, sf_dir)
    return _ids(P.keep_where(d, d.where("category_id = 5"), lambda a, b: (a.y0 >= b.y1) & (G.x_overlap_of_first(a, b) >= 0.8)))


def refootnote(spark, sf_dir):
    return P.refootnote(dense(spark, sf_dir), TEXT, IMAGE, TABLE).select("page", "pos", "to_figure")


def _typed_sides(spark, sf_dir):
    t = typed(spark, sf_dir)
    spans = t.where("pos % 2 = 0").withColumn("type", F.col("span"))
    blocks = t.where("pos % 2 = 1").withColumn("type", F.col("block"))
    return spans, blocks


def span_to_block(spark, sf_dir):
    spans, blocks = _typed_sides(spark, sf_dir)
    return P.spans_to_blocks(spans, blocks).select("page", "pos", "type", F.col("b_pos").alias("block_pos"), F.col("b_type").alias("block_type"))


def spans_inside(spark, sf_dir):
    spans, blocks = _typed_sides(spark, sf_dir)
    return P.spans_inside(spans, blocks.where("type <> 'discarded'"), blocks.where("type = 'discarded'")).select("page", "pos", "type")


def type_matrix(spark, sf_dir):
    t = typed(spark, sf_dir)
    return t.groupBy("span", "block").agg(F.max(P.fits(F.col("span"), F.col("block"))).alias("fits"), F.count(F.lit(1)).alias("n"))


def _chars(d):
    """Small boxes inside the given ones, as characters."""
    mid = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * t
    return d.where("pos % 3 = 0").select("page", "pos", F.col("x0").alias("x0"), mid("y0", "y1", 0.4).alias("y0"), (F.col("x0") + 4).alias("x1"), mid("y0", "y1", 0.6).alias("y1"), F.when(F.col("pos") % 2 == 0, ".").otherwise("a").alias("char"))


STOPS, STARTS = [".", "!", "?", ")", ",", ";", ":"], ["(", "[", "<"]


def grid_join(spark, sf_dir):
    d = dense(spark, sf_dir)
    rule = lambda a, b: G.char_in_span(a, b, F.col("char"), STOPS, STARTS)
    return P.grid_match(_chars(d), d.where("pos % 3 <> 0"), 20.0, rule).select("page", "pos", F.col("b_pos").alias("span_pos"))


def char_in_span(spark, sf_dir):
    d = dense(spark, sf_dir)
    both = P.beside(_chars(d), d.where("pos % 3 <> 0"))
    a, b = G.Box.of(), G.Box.of("b_")
    return both.select("page", "pos", "b_pos", G.char_in_span(a, b, F.col("char"), STOPS, STARTS).alias("char"), G.char_in_span(a, b, F.col("char"), STOPS, STARTS, None).alias("text"))


_CHARS = "chars AS (SELECT page, pos, x0, y0 + (y1 - y0) * 0.4::DOUBLE AS y0, x0 + 4 AS x1, y0 + (y1 - y0) * 0.6::DOUBLE AS y1, CASE WHEN pos % 2 = 0 THEN '.' ELSE 'a' END AS ch FROM dense WHERE pos % 3 = 0)"
_LEVEL = "((a.y0 + a.y1) / 2 > b.y0 AND (a.y0 + a.y1) / 2 < b.y1)"
_MIDDLE = "abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) < (b.y1 - b.y0) * 0.33::DOUBLE"
_WITHIN = "(((a.x0 + a.x1) / 2 > b.x0 AND (a.x0 + a.x1) / 2 < b.x1) OR (a.ch = '.' AND a.x0 > b.x1 - (b.y1 - b.y0) AND a.x0 < b.x1 AND (a.x0 + a.x1) / 2 > b.x0))"


def asof_index(spark, sf_dir):
    t = typed(spark, sf_dir)
    return P.nearest_by_index(t.where("pos % 4 = 1"), t.where("category_id = 3")).select("page", "pos", F.col("b_pos").alias("subject_pos"))


def nearest_blocks(spark, sf_dir):
    return P.neighbours(dense(spark, sf_dir), 0.3)


def cell_match(spark, sf_dir):
    d = dense(spark, sf_dir)
    return P.match_cells(d.where("pos % 2 = 0"), d.where("pos % 2 = 1")).select("page", "pos", F.col("b_pos").alias("cell_pos"))


def overlap_idx(spark, sf_dir):
    d = dense(spark, sf_dir)
    over = lambda a, b: (F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0) > 3) & (F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0) > 3)
    return P.beside(d.where("pos % 2 = 0"), d.where("pos % 2 = 1"), over).select("page", "pos", F.col("b_pos").alias("ref_pos"))


def replace_in_image(spark, sf_dir):
    """Boxes covered by an image (category 3) give way to one row for each image that covers any."""
    d = dense(spark, sf_dir)
    rest, images = d.where("category_id <> 3"), d.where("category_id = 3")
    covered = lambda a, b: G.overlap_of_first(a, b) > 0.8
    kept = P.drop_where(rest, images, covered).select("page", "pos", F.lit(False).alias("synthetic"))
    hit = P.keep_where(images, rest, lambda a, b: G.overlap_of_first(b, a) > 0.8).select("page", "pos", F.lit(True).alias("synthetic"))
    return kept.unionByName(hit)


def route_regions(spark, sf_dir):
    """Regions by category, and for each table the images at least 0.8 inside it."""
    d = dense(spark, sf_dir)
    tables = d.where("category_id = 5")
    inside = P.beside(d.where("category_id = 3"), tables, lambda a, b: G.mostly_inside(a, b)).groupBy("b_page", "b_pos").agg(F.sort_array(F.collect_list("pos")).alias("images"))
    return tables.join(inside, (F.col("page") == F.col("b_page")) & (F.col("pos") == F.col("b_pos")), "left").select("page", "pos", F.coalesce(F.array_join("images", ","), F.lit("")).alias("images"))


#: Class thresholds of the sample detector.
THRESHOLDS = {1: 0.92, 3: 0.95, 5: 0.97}


def class_threshold(spark, sf_dir):
    out = F.lit(0.5)
    for category, least in THRESHOLDS.items():
        out = F.when(F.col("category_id") == category, least).otherwise(out)
    return _ids(dense(spark, sf_dir).where(F.col("score") > out))


def label_map(spark, sf_dir):
    """Labels through a small dimension table; ignored labels become abandon."""
    names = spark.createDataFrame([(1, "text", False), (3, "image", False), (5, "table", True)], "category_id int, label string, ignored boolean")
    named = dense(spark, sf_dir).join(F.broadcast(names), "category_id", "left")
    return named.groupBy(F.when(F.coalesce("ignored", F.lit(True)), "abandon").otherwise(F.col("label")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def low_score_text(spark, sf_dir):
    tall = F.col("x1") - F.col("x0") < F.col("y1") - F.col("y0")
    low = (F.col("score") < 0.93) | ((F.col("pos") % 7 == 0) & (F.col("score") < 0.98) & tall)
    return dense(spark, sf_dir).select("page", "pos", F.when(low, "low_score_text").otherwise("text").alias("type"))


def group_media(spark, sf_dir):
    """Bodies with their captions and footnotes by a common sub-index."""
    d = dense(spark, sf_dir).withColumn("sub", F.col("pos") % 11)
    part = lambda category, name: d.where(F.col("category_id") == category).groupBy("page", "sub").agg(F.sort_array(F.collect_list("pos")).alias(name))
    body = d.where("category_id = 3").select("page", "pos", "sub")
    both = body.join(part(1, "captions"), ["page", "sub"], "left").join(part(5, "footnotes"), ["page", "sub"], "left")
    return both.select("page", "pos", F.coalesce(F.array_join("captions", ","), F.lit("")).alias("captions"), F.coalesce(F.array_join("footnotes", ","), F.lit("")).alias("footnotes"))


def dedup_first(spark, sf_dir):
    """The first of structurally equal rows."""
    from pyspark.sql import Window

    d = dense(spark, sf_dir).select("page", "pos", F.floor(F.col("x0") / 50).cast("int").alias("gx"), F.floor(F.col("y0") / 50).cast("int").alias("gy"))
    rank = F.row_number().over(Window.partitionBy("page", "gx", "gy").orderBy("pos"))
    return d.withColumn("r", rank).where("r = 1").drop("r")


def _first(where: str, order: str, left: str = "dense", right: str = "dense", out: str = "b.pos") -> str:
    return f"SELECT page, pos, other FROM (SELECT a.page, a.pos, {out} AS other, row_number() OVER (PARTITION BY a.page, a.pos ORDER BY {order}) AS r FROM {left} a JOIN {right} b ON a.page = b.page AND {where}) WHERE r = 1"


_FITS = """(CASE span WHEN 'text' THEN block IN ('text', 'title', 'discarded') WHEN 'inline_equation' THEN block IN ('text', 'title', 'discarded')
    WHEN 'interline_equation' THEN block IN ('interline_equation', 'text') WHEN 'image' THEN block = 'image_body' WHEN 'table' THEN block = 'table_body' ELSE false END)"""

QUERIES = {
    "iou_dedup": (lambda s, d: _ids(P.drop_doubles(dense(s, d), [1, 3], 0.4)), f"WITH {DENSE} SELECT a.page, a.pos FROM dense a WHERE NOT EXISTS (SELECT 1 FROM dense b WHERE a.page = b.page AND a.pos <> b.pos AND a.category_id IN (1, 3) AND b.category_id IN (1, 3) AND {_IOU} > 0.4::DOUBLE AND (a.score < b.score OR (a.score = b.score AND a.pos > b.pos)))"),
    "not_contained": (lambda s, d: _ids(P.not_contained(dense(s, d))), f"WITH {DENSE} SELECT a.page, a.pos FROM dense a WHERE NOT EXISTS (SELECT 1 FROM dense b WHERE a.page = b.page AND a.pos <> b.pos AND a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x1 <= b.x1 AND a.y1 <= b.y1)"),
    "title_vs_text": (title_vs_text, f"WITH {DENSE} SELECT a.page, a.pos FROM dense a WHERE NOT (a.category_id = 3 AND EXISTS (SELECT 1 FROM dense b WHERE a.page = b.page AND b.category_id = 1 AND {_IOU} > 0.5::DOUBLE))"),
    "drop_covered": (lambda s, d: _ids(P.drop_where(dense(s, d).where("category_id <> 5"), _of(s, d, TABLE), lambda a, b: G.overlap_of_first(a, b) > 0.6)), f"WITH {DENSE} SELECT a.page, a.pos FROM dense a WHERE a.category_id <> 5 AND NOT EXISTS (SELECT 1 FROM dense b WHERE a.page = b.page AND b.category_id = 5 AND {_ONE} > 0.6::DOUBLE)"),
    "under_footnote": (under_footnote, f"WITH {DENSE} SELECT a.page, a.pos FROM dense a WHERE EXISTS (SELECT 1 FROM dense b WHERE a.page = b.page AND b.category_id = 5 AND a.y0 >= b.y1 AND greatest(0.0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / (a.x1 - a.x0) >= 0.8::DOUBLE)"),
    "refootnote": (
        refootnote,
        f"""WITH {DENSE}, near AS (SELECT a.page, a.pos, b.category_id AS kind, min({_GAP}) AS gap FROM dense a JOIN dense b ON a.page = b.page AND a.category_id = 1 AND b.category_id IN (3, 5)
        AND CAST(b.x1 < a.x0 AS INTEGER) + CAST(a.x1 < b.x0 AS INTEGER) + CAST(b.y1 < a.y0 AS INTEGER) + CAST(a.y1 < b.y0 AS INTEGER) <= 1 GROUP BY ALL)
        SELECT d.page, d.pos, f.gap IS NOT NULL AND coalesce(t.gap > f.gap, true) AS to_figure FROM dense d
        LEFT JOIN near f ON d.page = f.page AND d.pos = f.pos AND f.kind = 3 LEFT JOIN near t ON d.page = t.page AND d.pos = t.pos AND t.kind = 5 WHERE d.category_id = 1""",
    ),
    "span_to_block": (
        span_to_block,
        f"""WITH {TYPED}, m AS (SELECT a.page, a.pos, a.span AS type, b.pos AS block_pos, b.block AS block_type, row_number() OVER (PARTITION BY a.page, a.pos ORDER BY b.pos) AS r
        FROM typed a JOIN typed b ON a.page = b.page AND a.pos % 2 = 0 AND b.pos % 2 = 1 AND {_ONE} > CASE WHEN a.span IN ('image', 'table') THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END
        AND {_FITS.replace('span', 'a.span').replace('block', 'b.block')}) SELECT page, pos, type, block_pos, block_type FROM m WHERE r = 1""",
    ),
    "spans_inside": (
        spans_inside,
        f"""WITH {TYPED} SELECT a.page, a.pos, a.span AS type FROM typed a WHERE a.pos % 2 = 0 AND EXISTS (SELECT 1 FROM typed b WHERE a.page = b.page AND b.pos % 2 = 1 AND
        CASE WHEN b.block = 'discarded' THEN {_ONE} > 0.4::DOUBLE ELSE {_ONE} > 0.5::DOUBLE AND CASE a.span WHEN 'image' THEN b.block = 'image_body' WHEN 'table' THEN b.block = 'table_body' ELSE b.block NOT IN ('image_body', 'table_body') END END)""",
    ),
    "type_matrix": (type_matrix, f"WITH {TYPED} SELECT span, block, bool_or({_FITS}) AS fits, count(*) AS n FROM typed GROUP BY ALL"),
    "grid_join": (grid_join, f"WITH {DENSE}, {_CHARS}, m AS ({_first(f'b.pos % 3 <> 0 AND {_LEVEL} AND {_MIDDLE} AND {_WITHIN}', 'b.y0, b.pos', left='chars')}) SELECT page, pos, other AS span_pos FROM m"),
    "char_in_span": (char_in_span, f'WITH {DENSE}, {_CHARS} SELECT a.page, a.pos, b.pos AS b_pos, {_LEVEL} AND {_MIDDLE} AND {_WITHIN} AS "char", {_LEVEL} AND {_WITHIN} AS text FROM chars a JOIN dense b ON a.page = b.page AND b.pos % 3 <> 0'),
    "asof_index": (asof_index, f"WITH {TYPED}, m AS ({_first('a.pos % 4 = 1 AND b.category_id = 3', f'abs(a.index - b.index), {_GAP}, {_CENTER}, b.pos', 'typed', 'typed')}) SELECT page, pos, other AS subject_pos FROM m"),
    "nearest_blocks": (
        nearest_blocks,
        f"""WITH {DENSE}, n AS (SELECT a.page, a.pos, b.pos AS p, b.y0 AS y, b.y0 <= a.y0 AS ahead FROM dense a JOIN dense b ON a.page = b.page AND a.pos <> b.pos
        AND greatest(0.0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) > 0.3::DOUBLE),
        r AS (SELECT *, row_number() OVER (PARTITION BY page, pos, ahead ORDER BY CASE WHEN ahead THEN -y ELSE y END, p) AS k FROM n)
        SELECT d.page, d.pos, x.p AS prev_pos, y.p AS post_pos FROM dense d LEFT JOIN r x ON x.page = d.page AND x.pos = d.pos AND x.ahead AND x.k = 1 LEFT JOIN r y ON y.page = d.page AND y.pos = d.pos AND NOT y.ahead AND y.k = 1""",
    ),
    "cell_match": (cell_match, f"WITH {DENSE}, m AS ({_first(f'a.pos % 2 = 0 AND b.pos % 2 = 1 AND {_IOU} > 1e-8::DOUBLE', f'1 - {_IOU}, abs(a.x0 - b.x0) + abs(a.y0 - b.y0) + abs(a.x1 - b.x1) + abs(a.y1 - b.y1), b.pos')}) SELECT page, pos, other AS cell_pos FROM m"),
    "overlap_idx": (overlap_idx, f"WITH {DENSE} SELECT a.page, a.pos, b.pos AS ref_pos FROM dense a JOIN dense b ON a.page = b.page AND a.pos % 2 = 0 AND b.pos % 2 = 1 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 3 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 3"),
    "replace_in_image": (
        replace_in_image,
        f"""WITH {DENSE}, hits AS (SELECT a.page, a.pos, b.pos AS image FROM dense a JOIN dense b ON a.page = b.page AND a.category_id <> 3 AND b.category_id = 3 AND {_ONE} > 0.8::DOUBLE)
        SELECT page, pos, false AS synthetic FROM dense d WHERE category_id <> 3 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.page = d.page AND h.pos = d.pos)
        UNION ALL SELECT DISTINCT page, image, true FROM hits""",
    ),
    "route_regions": (
        route_regions,
        f"""WITH {DENSE}, i AS (SELECT b.page, b.pos, string_agg(a.pos, ',' ORDER BY a.pos) AS images FROM dense a JOIN dense b ON a.page = b.page AND a.category_id = 3 AND b.category_id = 5
        AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= (a.x1 - a.x0) * (a.y1 - a.y0) * 0.8::DOUBLE GROUP BY ALL)
        SELECT d.page, d.pos, coalesce(i.images, '') AS images FROM dense d LEFT JOIN i ON d.page = i.page AND d.pos = i.pos WHERE d.category_id = 5""",
    ),
    "class_threshold": (class_threshold, f"WITH {DENSE} SELECT page, pos FROM dense WHERE score > CASE category_id WHEN 1 THEN 0.92::DOUBLE WHEN 3 THEN 0.95::DOUBLE WHEN 5 THEN 0.97::DOUBLE ELSE 0.5::DOUBLE END"),
    "label_map": (label_map, f"WITH {DENSE} SELECT CASE category_id WHEN 1 THEN 'text' WHEN 3 THEN 'image' ELSE 'abandon' END AS label, count(*) AS n FROM dense GROUP BY ALL"),
    "low_score_text": (low_score_text, f"WITH {DENSE} SELECT page, pos, CASE WHEN score < 0.93::DOUBLE OR (pos % 7 = 0 AND score < 0.98::DOUBLE AND x1 - x0 < y1 - y0) THEN 'low_score_text' ELSE 'text' END AS type FROM dense"),
    "group_media": (
        group_media,
        f"""WITH {DENSE}, p AS (SELECT page, pos % 11 AS sub, category_id, string_agg(pos, ',' ORDER BY pos) AS l FROM dense GROUP BY ALL)
        SELECT d.page, d.pos, coalesce(c.l, '') AS captions, coalesce(f.l, '') AS footnotes FROM dense d
        LEFT JOIN p c ON c.page = d.page AND c.sub = d.pos % 11 AND c.category_id = 1 LEFT JOIN p f ON f.page = d.page AND f.sub = d.pos % 11 AND f.category_id = 5 WHERE d.category_id = 3""",
    ),
    "dedup_first": (dedup_first, f"WITH {DENSE} SELECT page, min(pos) AS pos, CAST(floor(x0 / 50) AS INTEGER) AS gx, CAST(floor(y0 / 50) AS INTEGER) AS gy FROM dense GROUP BY page, gx, gy"),
}
