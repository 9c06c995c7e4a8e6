"""Queries of reading order on pages with columns, titles and figures drawn from lineitem."""

from __future__ import annotations


from pyspark.sql import functions as F

from quire.operators import reading as R
from quire.plans.views import table

_LABEL = """CASE (l_partkey * 7 + l_linenumber) % 23 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' WHEN 2 THEN 'number' WHEN 3 THEN 'doc_title' WHEN 4 THEN 'paragraph_title'
    WHEN 5 THEN 'paragraph_title' WHEN 6 THEN 'abstract_title' WHEN 7 THEN 'image' WHEN 8 THEN 'figure' WHEN 9 THEN 'table' WHEN 10 THEN 'figure_title' WHEN 11 THEN 'table_title' ELSE 'text' END"""


def _layout(div: str) -> str:
    """Four orders a page; three columns, each eleventh block across them, rows of 15 pixels, one to
    four lines of 12 pixels. The same text for both engines but for whole division."""
    at = "l_orderkey {d} 4".format(d=div)
    return f"""SELECT {at} AS page, CAST(row_number() OVER (PARTITION BY {at} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos,
        {_LABEL} AS label, CASE WHEN l_partkey % 11 = 0 THEN 40 ELSE 40 + 220 * (l_partkey % 3) END AS x0, 40 + l_suppkey * 7 % 64 * 15 AS y0,
        CASE WHEN l_partkey % 11 = 0 THEN 680 - l_partkey % 30 ELSE 190 + 220 * (l_partkey % 3) + l_partkey % 60 END AS x1,
        40 + l_suppkey * 7 % 64 * 15 + 12 * (1 + l_partkey {div} 3 % 4) AS y1, CAST(1 + l_partkey {div} 3 % 4 AS INT) AS lines FROM lineitem"""


def layout(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("quire_reading")
    return spark.sql(_layout("div").replace("FROM lineitem", "FROM quire_reading"))


def title_children(spark, sf_dir):
    return R.children(layout(spark, sf_dir))


def reading_order(spark, sf_dir):
    return R.order(layout(spark, sf_dir))


_ROLE = "CASE " + " ".join(f"WHEN label IN ({', '.join(repr(x) for x in labels)}) THEN '{role}'" for role, labels in R.ROLES.items()) + " ELSE 'text' END"
_MEET = {c: f"least(a.{c}1, r.{c}1) - greatest(a.{c}0, r.{c}0)" for c in "xy"}
_GAP = f"greatest(0, -({_MEET['x']})) + greatest(0, -({_MEET['y']}))"
_COMMON = f"greatest(0, {_MEET['x']}) * greatest(0, {_MEET['y']})"
_AT = {t: f"CASE WHEN x THEN {t}.y0 ELSE {t}.x0 END" for t in "ar"}

_KIN = f"""b0 AS MATERIALIZED (
    SELECT *, x1 - x0 >= y1 - y0 AS flat, greatest(x1 - x0, y1 - y0) AS wide, least(x1 - x0, y1 - y0) AS thin, (x1 - x0) * (y1 - y0) AS area,
        greatest(CAST(1 AS DOUBLE), CASE WHEN x1 - x0 >= y1 - y0 THEN y1 - y0 ELSE x1 - x0 END / lines) AS line
    FROM (SELECT page, pos, {_ROLE} AS role, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, lines FROM ({_layout("//")}))
), pp AS MATERIALIZED (
    SELECT a, r, a.page AS page, a.pos AS apos, r.pos AS rpos, turn, x, {_AT['r']} > {_AT['a']} AS after, abs({_AT['r']} - ({_AT['a']})) AS far, {_GAP} AS gap, {_COMMON} * 10 > least(a.area, r.area) * 9 AS inside, a.flat = r.flat AS alike,
        CASE WHEN x THEN {_MEET['x']} ELSE {_MEET['y']} END * 10 > CASE WHEN x THEN least(a.x1 - a.x0, r.x1 - r.x0) ELSE least(a.y1 - a.y0, r.y1 - r.y0) END AS near
    FROM (SELECT a, r, t.turn, a.flat = (t.turn = 1) AS x FROM b0 a JOIN b0 r ON a.page = r.page AND a.pos <> r.pos AND (a.role = 'doc_title' AND r.role = 'text' OR a.role = 'title' AND r.role IN ('title', 'text') OR a.role = 'vision' AND r.role IN ('text', 'caption'))
        JOIN (VALUES (1), (2)) t(turn) ON t.turn = 1 OR a.role = 'vision')
), nn AS MATERIALIZED (
    SELECT *, row_number() OVER w AS nth, sum(CASE WHEN r.role = 'text' THEN 1 ELSE 0 END) OVER w AS texts, sum(CASE WHEN r.role = 'text' THEN 1 ELSE 0 END) OVER w - CASE WHEN r.role = 'text' THEN 1 ELSE 0 END AS before
    FROM pp WHERE near WINDOW w AS (PARTITION BY page, apos, turn, after ORDER BY far, rpos ROWS UNBOUNDED PRECEDING)
), subs AS MATERIALIZED (
    SELECT * FROM nn WHERE a.role = 'title' AND r.role = 'title' AND texts = 0 AND alike AND apos < rpos AND abs(CASE WHEN a.flat THEN r.x0 - a.x0 ELSE r.y0 - a.y0 END) < 2 * least(a.line, r.line) AND gap <= 1.5::DOUBLE * least(a.line, r.line)
), seen AS MATERIALIZED (SELECT page, rpos, list(DISTINCT apos) AS by_, row_number() OVER (PARTITION BY page ORDER BY rpos) AS k FROM subs GROUP BY page, rpos
), fold AS (
    SELECT page, 0 AS k, CAST([] AS INTEGER[]) AS taken FROM seen GROUP BY page
    UNION ALL SELECT f.page, CAST(s.k AS INTEGER), CASE WHEN len(list_filter(by_, lambda t: NOT list_contains(taken, t))) > 0 THEN list_append(taken, rpos) ELSE taken END FROM fold f JOIN seen s ON f.page = s.page AND s.k = f.k + 1
), taken AS MATERIALIZED (SELECT page, arg_max(taken, k) AS taken FROM fold GROUP BY page
), titled AS MATERIALIZED (SELECT * FROM nn WHERE a.role = 'vision' AND r.role = 'caption' AND before = 0 AND gap <= 2 * r.line
), once AS (SELECT DISTINCT page, apos FROM titled WHERE turn = 1
), claims AS (
    SELECT page, rpos, apos, 'doc_title_text' AS kind, gap FROM nn WHERE a.role = 'doc_title' AND nth = 1 AND alike AND 10 * r.thin < 8 * a.thin AND (r.wide < a.wide OR 2 * r.wide > 3 * a.wide) AND r.lines < 3 AND gap < 2 * r.line
    UNION ALL SELECT s.page, rpos, apos, 'sub_title', gap FROM subs s JOIN taken t ON s.page = t.page AND list_contains(taken, rpos) AND NOT list_contains(taken, apos)
    UNION ALL SELECT page, rpos, apos, 'vision_title', gap FROM titled t WHERE turn = 1 OR NOT EXISTS (SELECT 1 FROM once o WHERE o.page = t.page AND o.apos = t.apos)
    UNION ALL SELECT page, rpos, apos, 'vision_footnote', gap FROM (
        SELECT n.*, row_number() OVER (PARTITION BY n.page, n.apos ORDER BY turn, after) AS one FROM nn n LEFT JOIN once o ON n.page = o.page AND n.apos = o.apos
        WHERE a.role = 'vision' AND r.role = 'text' AND before = 0 AND alike AND r.wide < a.wide AND gap <= 2 * r.line AND (turn = 1 OR o.apos IS NULL)
            AND (2 * r.wide < a.wide AND r.thin < a.thin AND abs(a.x0 + a.x1 - r.x0 - r.x1) < 20 OR r.lines = 1 AND (a.x0 - r.x0 < 10 OR a.x1 - r.x1 < 10))) WHERE one = 1
    UNION ALL SELECT page, rpos, apos, CASE a.role WHEN 'vision' THEN 'vision_footnote' ELSE 'doc_title_text' END, gap FROM pp WHERE turn = 1 AND inside AND r.role = 'text' AND (a.role = 'vision' OR a.role = 'doc_title' AND alike)
), kin AS MATERIALIZED (SELECT page, rpos AS child, apos AS parent, kind FROM claims QUALIFY row_number() OVER (PARTITION BY page, rpos ORDER BY gap, apos, kind) = 1)"""

_CHILDREN = f"WITH RECURSIVE {_KIN} SELECT page, child, parent, kind FROM kin"


def _runs(source: str, lo: str, hi: str, name: str, by: str, columns: str, slack: int = 0) -> str:
    """SELECT of source with the number of the run of overlapping intervals."""
    w = f"PARTITION BY {by} ORDER BY {lo}, {hi}, pos"
    return f"SELECT {columns}, CAST(sum(brk) OVER ({w} ROWS UNBOUNDED PRECEDING) AS INTEGER) AS {name} FROM (SELECT *, CASE WHEN {lo} > max({hi}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {slack} THEN 1 ELSE 0 END AS brk FROM {source})"


def _level(k: int) -> str:
    axis = ("down", "NOT down")[k % 2]
    lo, hi = f"CASE WHEN {axis} THEN y0 ELSE x0 END", f"CASE WHEN {axis} THEN y1 ELSE x1 END"
    return f"l{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (i, brk, path), path || lpad(CAST(i AS VARCHAR), 5, '0') AS path FROM ({_runs(f'l{k}', lo, hi, 'i', 'page, part, path', '*', R.SLACK)}))"


#: Levels that the SQL spells out; regions of the given tables need fewer.
_DEEP = 20
_W = [f"CASE WHEN m.role = 'doc_title' THEN {t} ELSE {c} END" for t, c in zip(R.TITLE_WEIGHTS, R.CROSS_WEIGHTS)]
_ORDER = f"""WITH RECURSIVE {_KIN}, b AS MATERIALIZED (
    SELECT b0.*, parent, b0.role NOT IN ('header', 'footer', 'unordered') AND parent IS NULL AS body, min(x0) OVER (PARTITION BY b0.page) + max(x1) OVER (PARTITION BY b0.page) AS middle,
        greatest(CAST(1 AS DOUBLE), coalesce(median(CASE WHEN role = 'text' THEN line END) OVER (PARTITION BY b0.page), 10)) AS lh
    FROM b0 LEFT JOIN kin ON b0.page = kin.page AND b0.pos = kin.child
), m1 AS MATERIALIZED ({_runs("(SELECT * FROM b WHERE body)", "y0", "y1", "row_", "page", "* EXCLUDE (brk)")}
), m2 AS MATERIALIZED ({_runs("(SELECT *, role <> 'vision' AS shown FROM m1)", "x0", "x1", "col", "page, shown", "* EXCLUDE (brk)")}
), rows0 AS (
    SELECT page, row_, CASE WHEN count(*) = 1 AND bool_or(abs(x0 + x1 - middle) <= 2 * CASE WHEN flat THEN wide // 5 ELSE thin // 10 END) THEN 1 ELSE 0 END AS alone, min(y0) AS top, max(y1) AS bottom, max(CASE WHEN shown THEN col END) AS col, max(lh) AS lh FROM m2 GROUP BY page, row_
), rows1 AS (
    SELECT *, CASE WHEN alone = 1 OR (coalesce(max(col) OVER (PARTITION BY page) = 0, false) AND lead(top) OVER (PARTITION BY page ORDER BY row_) - bottom >= 3 * lh) THEN 1 ELSE 0 END AS ends FROM rows0
), rows2 AS (SELECT page, row_, sum(alone + ends) OVER (PARTITION BY page ORDER BY row_) - ends AS part FROM rows1
), m3 AS MATERIALIZED (SELECT m2.* EXCLUDE (col), part FROM m2 JOIN rows2 USING (page, row_)
), two AS (
    SELECT a.page, a.pos, max(CASE WHEN {_COMMON} > 0 AND (a.role = 'vision' OR 10 * {_COMMON} > a.area + r.area - {_COMMON} AND a.area < r.area) THEN 1 ELSE 0 END) AS touched,
        min(CASE WHEN {_MEET['y']} > 0 AND a.x1 <= r.x0 THEN r.x0 END) AS anyone, min(CASE WHEN {_MEET['y']} > 0 AND a.x1 <= r.x0 AND a.role = 'text' AND r.role = 'text' AND a.wide > {R.WORDS} * a.line AND r.wide > {R.WORDS} * r.line THEN r.x0 END) AS longs
    FROM m3 a JOIN m3 r ON a.page = r.page AND a.part = r.part AND a.pos <> r.pos AND a.role <> 'doc_title' AND r.role <> 'doc_title' GROUP BY a.page, a.pos
), m4 AS MATERIALIZED (SELECT m3.*, touched, anyone, longs FROM m3 LEFT JOIN two USING (page, pos)
), m AS MATERIALIZED (
    SELECT a.*, a.role <> 'doc_title' AND (coalesce(touched, 0) = 1 OR EXISTS (SELECT 1 FROM m4 r WHERE r.page = a.page AND r.part = a.part AND r.x1 > a.x0 AND CASE WHEN a.role = 'vision' THEN r.anyone ELSE r.longs END < a.x1)) AS masked FROM m4 a
), plain AS ({_runs("(SELECT * FROM m WHERE NOT masked AND role <> 'doc_title')", "x0", "x1", "col", "page, part", "* EXCLUDE (brk)")}
), l0 AS MATERIALIZED (
    SELECT page, part, pos, x0, y0, x1, y1, max(col) OVER (PARTITION BY page, part) = 0 OR max(lines) OVER (PARTITION BY page, part) = 1 AS down, '' AS path FROM plain
), {", ".join(_level(k) for k in range(_DEEP))}, placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY page ORDER BY part, path, CASE WHEN down THEN x0 ELSE y0 END, CASE WHEN down THEN y0 ELSE x0 END, pos) AS nth FROM l{_DEEP}
), rest AS MATERIALIZED (
    SELECT *, role = 'doc_title' AND row_number() OVER (PARTITION BY page, part, role ORDER BY floor(y0 / lh), floor(x0 / lh), pos) = 1 AS leads FROM m WHERE masked OR role = 'doc_title'
), near AS (
    SELECT m.page, m.pos, m.part, m.leads, s.nth, CASE WHEN m.y0 // 2 <> s.y0 // 2 THEN m.y0 > s.y0 ELSE m.x0 > s.x0 END AS below,
        (CASE WHEN m.x1 < s.x0 THEN (s.x0 - m.x1) * {_W[0]} ELSE greatest(0, m.x0 - s.x1) * {_W[1]} END + CASE WHEN m.y1 < s.y0 THEN (s.y0 - m.y1) * {_W[2]} ELSE greatest(0, m.y0 - s.y1) * {_W[3]} END) * {R.EDGE}
            + CASE WHEN s.y1 < m.y0 THEN -1 ELSE 1 END * (s.y0 * {R.UP} + s.x0) AS far,
        coalesce(sum(CASE WHEN s.part < m.part THEN 1 ELSE 0 END) OVER (PARTITION BY m.page, m.pos), 0) AS ahead
    FROM rest m LEFT JOIN placed s ON m.page = s.page
), keyed AS (
    SELECT page, pos, part, CASE WHEN leads OR nth IS NULL THEN 4 * ahead + 2 ELSE 4 * nth + CASE WHEN below THEN 1 ELSE -1 END END AS key FROM near QUALIFY row_number() OVER (PARTITION BY page, pos ORDER BY far, nth) = 1
    UNION ALL SELECT page, pos, part, 4 * nth FROM placed
), whole AS MATERIALIZED (
    SELECT b.page, b.pos, b.x0, b.y0, row_number() OVER (PARTITION BY b.page ORDER BY CASE role WHEN 'header' THEN 0 WHEN 'footer' THEN 2 WHEN 'unordered' THEN 3 ELSE 1 END, key NULLS FIRST, part NULLS FIRST, floor(b.y0 / lh), floor(b.x0 / lh), b.pos) AS nth
    FROM b LEFT JOIN keyed k ON b.page = k.page AND b.pos = k.pos WHERE parent IS NULL
)
SELECT page, pos, CAST(row_number() OVER (PARTITION BY page ORDER BY nth, y0, x0, pos) AS INTEGER) AS place FROM (
    SELECT * FROM whole UNION ALL SELECT b.page, b.pos, b.x0, b.y0, w.nth FROM b JOIN whole w ON b.page = w.page AND b.parent = w.pos)"""

def slide_order(spark, sf_dir):
    return R.slide_order(_slides(layout(spark, sf_dir)))


def slide_order_wide(spark, sf_dir):
    return R.slide_order(_slides(layout(spark, sf_dir)), beta=0.95)


def _slides(boxes):
    """Shapes of fewer pixels a row, so that rows part, and narrow ones between the columns."""
    thin = F.col("pos") % 7 == 3
    x1 = F.when(thin, F.col("x0") + 20).otherwise(F.col("x1"))
    return boxes.select("page", "pos", F.when(thin, F.col("x0") + 190).otherwise(F.col("x0")).alias("x0"), "y0", F.when(thin, x1 + 190).otherwise(x1).alias("x1"), (F.col("y0") + 8 + F.col("pos") % 3).alias("y1"))


#: Levels that the SQL of slides spells out: a page of n shapes needs n - 1 at most.
_PARTS = 30


def _gap_sql(lo: str, hi: str, by: str) -> str:
    return f"{lo} - max({hi}) OVER (PARTITION BY {by} ORDER BY {lo}, {hi}, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _part(k: int) -> str:
    """One level of a slide's cuts."""
    w = "OVER (PARTITION BY page, path)"
    big = lambda c, only="": f"max(CASE WHEN {c} > 0 {only} THEN {c} END) {w}"
    first = lambda c, lo, of, only="": f"min(CASE WHEN {c} = {of} {only} THEN {lo} END) {w}"
    return f"""s{k + 1} AS MATERIALIZED (
    SELECT page, pos, x0, y0, x1, y1, path || CASE WHEN ygap >= {R.GAP} AND (xgap < {R.GAP} OR ygap > xgap) THEN CASE WHEN (y0 + y1) / 2 >= yat - ygap / 2 THEN '1' ELSE '0' END
        WHEN xgap >= {R.GAP} THEN CASE WHEN (x0 + x1) / 2 >= xat - xgap / 2 THEN '1' ELSE '0' END ELSE '' END AS path
    FROM (SELECT *, coalesce(CASE WHEN slim THEN g2 ELSE gx END, 0) AS xgap, CASE WHEN slim THEN at2 ELSE atx END AS xat, coalesce(gy, 0) AS ygap, aty AS yat
        FROM (SELECT *, {first('dy', 'y0', 'gy')} AS aty, {first('dx', 'x0', 'gx')} AS atx, {first('dw', 'x0', 'g2', 'AND wide')} AS at2, coalesce(gx, 0) < {R.GAP} AND n >= 3 AND nw BETWEEN 2 AND n - 1 AND coalesce(g2, 0) > coalesce(gx, 0) AS slim
            FROM (SELECT *, {big('dy')} AS gy, {big('dx')} AS gx, {big('dw', 'AND wide')} AS g2, count(*) {w} AS n, sum(CASE WHEN wide THEN 1 ELSE 0 END) {w} AS nw
                FROM (SELECT *, {_gap_sql('y0', 'y1', 'page, path')} AS dy, {_gap_sql('x0', 'x1', 'page, path')} AS dx, {_gap_sql('x0', 'x1', 'page, path, wide')} AS dw
                    FROM (SELECT *, x1 - x0 >= {R.NARROW}::DOUBLE * (max(x1) {w} - min(x0) {w}) AS wide FROM s{k}))))))"""


def _slide_sql(beta: float) -> str:
    return f"""WITH v AS MATERIALIZED (
    SELECT page, pos, CAST(x0 + CASE WHEN pos % 7 = 3 THEN 190 ELSE 0 END AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(CASE WHEN pos % 7 = 3 THEN x0 + 210 ELSE x1 END AS DOUBLE) AS x1, CAST(y0 + 8 + pos % 3 AS DOUBLE) AS y1 FROM ({_layout("//")})
), c AS (SELECT *, count(*) OVER (PARTITION BY page) >= 3 AND x1 - x0 >= {beta}::DOUBLE * max(x1 - x0) OVER (PARTITION BY page) AS candidate FROM v
), o AS (
    SELECT *, candidate AND (SELECT count(*) FROM v WHERE v.page = c.page AND v.pos <> c.pos AND least(v.x1, c.x1) - greatest(v.x0, c.x0) >= {R.OVERLAP}::DOUBLE * least(v.x1 - v.x0, c.x1 - c.x0)) >= {R.OVERLAPS} AS aside FROM c
), p AS MATERIALIZED (SELECT *, aside AND bool_or(NOT aside) OVER (PARTITION BY page) AS rest FROM o
), s0 AS MATERIALIZED (SELECT page, pos, x0, y0, x1, y1, '' AS path FROM p WHERE NOT rest
), {", ".join(_part(k) for k in range(_PARTS))}, m AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY page ORDER BY path, y0, x0, pos) AS nth FROM s{_PARTS}
), k AS (
    SELECT page, pos, y0, x0, 2 * nth AS key FROM m
    UNION ALL SELECT page, pos, y0, x0, coalesce(2 * (SELECT min(nth) FROM m WHERE m.page = p.page AND m.y0 >= p.y0) - 1, 2147483648) FROM p WHERE rest
)
SELECT page, pos, CAST(row_number() OVER (PARTITION BY page ORDER BY key, y0, x0, pos) AS INTEGER) AS place FROM k"""


QUERIES = {
    "slide_order": (slide_order, _slide_sql(2.0)),
    "slide_order_wide": (slide_order_wide, _slide_sql(0.95)),
    "title_children": (title_children, _CHILDREN),
    "xycut_enhanced": (reading_order, _ORDER),
}
