"""Queries of text lines: regions of twelve spans in four rows, every fifth a formula within its neighbour."""

from __future__ import annotations

from quire.operators import textlines as T
from quire.plans.joins import DENSE, dense

#: Every third region runs down; spans of a row are a few pixels off, some far too high.
_SPANS = """SELECT page, region, pos, label, text, CASE WHEN down THEN v0 ELSE u0 END AS x0, CASE WHEN down THEN u0 ELSE v0 END AS y0, CASE WHEN down THEN v1 ELSE u1 END AS x1, CASE WHEN down THEN u1 ELSE v1 END AS y1
    FROM (SELECT page, region, CAST(pos AS BIGINT) AS pos, (page + region) % 3 = 0 AS down, CASE WHEN pos % 5 = 2 THEN 'formula' ELSE 'text' END AS label,
                 CASE WHEN pos % 5 = 2 THEN CASE WHEN pos % 2 = 0 THEN 'x+y' ELSE '$z$' END ELSE CASE pos % 7 WHEN 0 THEN 'ab' WHEN 1 THEN 'c9' WHEN 2 THEN 'd-' WHEN 3 THEN 'e,' WHEN 4 THEN 'f.' ELSE 'gh' END END AS text,
                 CASE WHEN pos % 5 = 2 THEN 160.0 * ((pos + 2) % 3) + 45 ELSE 160.0 * (pos % 3) + w % 40 END AS u0, CASE WHEN pos % 5 = 2 THEN 160.0 * ((pos + 2) % 3) + 60 + pos % 3 ELSE 160.0 * (pos % 3) + w % 40 + 20 + w % 110 END AS u1,
                 40.0 * r + z % 9 AS v0, 40.0 * r + z % 9 + 10 + w % 13 + CASE WHEN z % 11 = 0 THEN 35 ELSE 0 END AS v1
          FROM (SELECT page, CAST(floor(pos / 12.0) AS BIGINT) AS region, pos, CAST(floor(pos % 12 / 3.0) AS BIGINT) AS r, CAST(x0 AS BIGINT) AS w, CAST(y0 AS BIGINT) AS z FROM dense) q0) q1"""


def region_lines(spark, sf_dir):
    dense(spark, sf_dir).createOrReplaceTempView("quire_dense")
    return T.text_lines(spark.sql(f"WITH dense AS (SELECT * FROM quire_dense) {_SPANS}"))


_MARKS = ", ".join("'" + m.replace("'", "''") + "'" for m in T.GOES_ON)
_SQL = f"""WITH RECURSIVE {DENSE}, sp AS MATERIALIZED (SELECT page, region, pos, label, text, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM ({_SPANS})
), di AS (SELECT *, count(*) FILTER (label = 'text' AND (x1 - x0) * CAST({T.LEAN} AS DOUBLE) >= y1 - y0) OVER g >= count(*) FILTER (label = 'text') OVER g * CAST(0.5 AS DOUBLE) AS flat FROM sp WINDOW g AS (PARTITION BY page, region)
), s AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY page, region ORDER BY CASE WHEN flat THEN c0 ELSE -c0 END, pos) AS nth
    FROM (SELECT *, CASE WHEN flat THEN x0 ELSE y0 END AS a0, CASE WHEN flat THEN x1 ELSE y1 END AS a1, CASE WHEN flat THEN y0 ELSE x0 END AS c0, CASE WHEN flat THEN y1 ELSE x1 END AS c1 FROM di)
), fold AS (
    SELECT page, region, nth, 1 AS line, c0 AS lo, c1 AS hi FROM s WHERE nth = 1
    UNION ALL SELECT page, region, nth, CASE WHEN same THEN line ELSE line + 1 END, CASE WHEN same THEN least(lo, c0) ELSE c0 END, CASE WHEN same THEN greatest(hi, c1) ELSE c1 END
    FROM (SELECT s.page, s.region, s.nth, f.line, f.lo, f.hi, c0, c1, least(hi, c1) > greatest(lo, c0) AND least(hi - lo, c1 - c0) > 0 AND (least(hi, c1) - greatest(lo, c0)) / least(hi - lo, c1 - c0) >= CAST({T.RATIO} AS DOUBLE) AS same
          FROM fold f JOIN s ON s.page = f.page AND s.region = f.region AND s.nth = f.nth + 1)
), h AS (
    SELECT s.*, line, max(c1) OVER l - min(c0) OVER l AS height, CASE WHEN row_number() OVER (PARTITION BY page, region, line ORDER BY pos) = 1 THEN 1 ELSE 0 END AS first
    FROM s JOIN fold USING (page, region, nth) WINDOW l AS (PARTITION BY page, region, line)
), t AS (SELECT *, min(height) OVER (PARTITION BY page, region) AS thin, max(height) OVER (PARTITION BY page, region) AS thick, sum(first) OVER (PARTITION BY page, region) AS lines FROM h
), u AS MATERIALIZED (
    SELECT * FROM (SELECT *, sum(CASE WHEN height < thin * CAST({T.KEEP} AS DOUBLE) THEN first ELSE 0 END) OVER (PARTITION BY page, region) < lines * CAST({T.MOST} AS DOUBLE) AS few FROM t)
    WHERE flat OR NOT (thick > thin * 2 AND few AND height > thin * CAST({T.KEEP} AS DOUBLE))
), hit AS MATERIALIZED (
    SELECT a.*, b.a0 AS f0, b.a1 AS f1 FROM u a JOIN u b ON a.page = b.page AND a.region = b.region AND a.line = b.line AND a.label = 'text' AND b.label = 'formula' AND a.a0 <= b.a0 AND b.a1 <= a.a1
), edge AS (SELECT page, region, flat, line, pos, c0, c1, unnest(list_concat([a0], list_sort(list(f1)))) AS low, 0 AS k FROM hit GROUP BY page, region, flat, line, pos, c0, c1, a0
), part AS ( -- from each end of a formula (or the span's start) to the next start of one (or the span's end), where no formula lies over it
    SELECT e.page, e.region, e.flat, e.line, e.pos, e.c0, e.c1, e.low AS a0, coalesce(min(x.f0) FILTER (x.f0 >= e.low), any_value(x.a1)) AS a1
    FROM (SELECT DISTINCT * FROM edge) e JOIN hit x USING (page, region, line, pos) GROUP BY ALL HAVING count(*) FILTER (x.f0 < e.low AND x.f1 > e.low) = 0
), p0 AS (
    SELECT page, region, flat, line, pos, 0 AS piece, label, text, a0, a1, c0, c1 FROM u WHERE NOT EXISTS (SELECT 1 FROM hit x WHERE x.page = u.page AND x.region = u.region AND x.pos = u.pos)
    UNION ALL SELECT page, region, flat, line, pos, row_number() OVER (PARTITION BY page, region, pos ORDER BY a0), 'text', NULL, a0, a1, c0, c1 FROM part WHERE a1 - a0 > 1
), p1 AS (
    SELECT *, min(a0) OVER (PARTITION BY page, region) AS low, max(a1) OVER (PARTITION BY page, region) AS high,
           CASE WHEN label = 'formula' AND NOT starts_with(text, '$') AND NOT ends_with(text, '$') THEN '$' || text || '$' ELSE coalesce(text, '') END AS said0 FROM p0
), p2 AS (SELECT *, CASE WHEN label = 'formula' OR regexp_matches(said0, '[A-Za-z]$') THEN said0 || ' ' ELSE said0 END AS said FROM p1
), g AS (
    SELECT page, region, line, flat, count(*) AS n, count(*) - count(text) AS unread, rtrim(string_agg(said, '' ORDER BY floor(a0 / 2), c0, pos, piece)) AS whole, arg_max(a1, [floor(a0 / 2), c0, pos, piece]) AS last_end, arg_min(a0, [floor(a0 / 2), c0, pos, piece]) AS first_start,
           any_value(low) AS low, any_value(high) AS high, min(a0) AS a0, max(a1) AS a1, min(c0) AS c0, max(c1) AS c1
    FROM p2 GROUP BY page, region, line, flat
)
SELECT page, region, CAST(line AS INTEGER) AS line, flat, n, unread, CASE WHEN ends_with(whole, '-') THEN left(whole, length(whole) - 1) ELSE whole END AS text,
    whole <> '' AND ((NOT regexp_matches(right(whole, 1), '[A-Za-z0-9]') AND right(whole, 1) NOT IN ({_MARKS})) OR high - last_end > (high - low) * CAST(0.3 AS DOUBLE))
        AND (high - last_end > (c1 - c0) * CAST(1.5 AS DOUBLE) OR (NOT flat AND first_start - low > (c1 - c0) * CAST(1.5 AS DOUBLE))) AS ends,
    CASE WHEN flat THEN a0 ELSE c0 END AS x0, CASE WHEN flat THEN c0 ELSE a0 END AS y0, CASE WHEN flat THEN a1 ELSE c1 END AS x1, CASE WHEN flat THEN c1 ELSE a1 END AS y1
FROM g"""

QUERIES = {"region_lines": (region_lines, _SQL)}
