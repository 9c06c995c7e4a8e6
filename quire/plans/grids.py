"""Queries on HTML tables (one table for each page of crowded boxes, five cells a row, spans that
depend on the boxes) and on pictures inside tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import grids as G
from quire.operators import pages as P
from quire.plans.joins import DENSE, dense


def tables(spark, sf_dir):
    """page, html; the first row is of headings, some cells have no end tag, some texts have signs
    that HTML and Markdown write in their own way."""
    d = dense(spark, sf_dir)
    x, y = F.col("x0").cast("int"), F.col("y0").cast("int")
    span = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n, F.lit('"'))).otherwise(F.when(x % 5 == 0, F.lit(f" {name}='1'")).otherwise(""))
    tag = F.when(F.col("pos") <= 5, "th").otherwise("td")
    text = F.concat(F.lit("<b>"), x, F.lit("</b>  &lt; "), y, F.when(x % 4 == 0, " | x").otherwise(""))
    end = F.when(y % 3 == 0, "").otherwise(F.concat(F.lit("</"), tag, F.lit(">")))
    cell = F.concat(F.lit("<"), tag, span("rowspan", 1 + x % 3), span("colspan", 1 + y % 2 * (y % 3)), F.lit(">"), text, end)
    rows = d.groupBy("page", F.floor((F.col("pos") - 1) / 5).alias("r")).agg(F.array_sort(F.collect_list(F.struct("pos", cell.alias("c")))).alias("l"))
    rows = rows.withColumn("tr", F.concat(F.lit("<tr>"), F.array_join(F.transform("l", lambda s: s["c"]), ""), F.lit("</tr>")))
    t = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("r", "tr"))).alias("l"))
    return t.select("page", F.concat(F.lit("<table>"), F.array_join(F.transform("l", lambda s: s["tr"]), ""), F.lit("</table>")).alias("html"))


def _placed(spark, sf_dir):
    return G.place_tables(tables(spark, sf_dir), "page", "html")


def table_cells(spark, sf_dir):
    return _placed(spark, sf_dir)


def table_segments(spark, sf_dir):
    return G.segments(_placed(spark, sf_dir), "page")


def table_pipes(spark, sf_dir):
    return G.markdown_tables(tables(spark, sf_dir), "page", "html")


_PLACED = f"""WITH RECURSIVE {DENSE}, c AS MATERIALIZED (
    SELECT page, pos, CAST((pos - 1) // 5 AS INTEGER) AS row_no, CAST((pos - 1) % 5 AS INTEGER) AS cell, pos <= 5 AS header,
           CAST(1 + x % 3 AS INTEGER) AS rowspan, CAST(1 + y % 2 * (y % 3) AS INTEGER) AS colspan, x || ' < ' || y || CASE WHEN x % 4 = 0 THEN ' | x' ELSE '' END AS text
    FROM (SELECT page, pos, CAST(x0 AS INTEGER) AS x, CAST(y0 AS INTEGER) AS y FROM dense)
), f AS (
    SELECT page, 0 AS pos, -1 AS row_no, 0 AS after, CAST([] AS INTEGER[]) AS busy, 0 AS col FROM c GROUP BY page
    UNION ALL
    SELECT page, pos, row_no, CAST(spot + colspan AS INTEGER),
           list_transform(range(0, greatest(len(busy), spot + colspan)), lambda i: CAST(CASE WHEN i >= spot AND i < spot + colspan THEN greatest(coalesce(busy[i + 1], -1), row_no + rowspan - 1) ELSE coalesce(busy[i + 1], -1) END AS INTEGER)),
           CAST(spot AS INTEGER)
    FROM (
        SELECT c.page, c.pos, c.row_no, c.rowspan, c.colspan, f.busy,
               list_min(list_filter(range(CASE WHEN f.row_no = c.row_no THEN f.after ELSE 0 END, greatest(len(f.busy), f.after) + 1), lambda i: coalesce(f.busy[i + 1], -1) < c.row_no)) AS spot
        FROM f JOIN c ON f.page = c.page AND c.pos = f.pos + 1)
), p AS MATERIALIZED (SELECT c.*, f.col, max(c.row_no) OVER (PARTITION BY c.page) AS last FROM c JOIN f ON c.page = f.page AND c.pos = f.pos
), o AS MATERIALIZED (
    SELECT page, row_no, col, max(pos) AS own FROM (
        SELECT page, pos, row_no, unnest(range(col, col + colspan)) AS col FROM (
            SELECT page, pos, col, colspan, unnest(range(row_no, least(row_no + rowspan - 1, last) + 1)) AS row_no FROM p))
    GROUP BY ALL)"""
_CELLS = f"{_PLACED} SELECT page, row_no, cell, header, rowspan, colspan, text, col FROM p"
_SEGMENTS = f"""{_PLACED}, n AS (
    SELECT *, CASE WHEN lag(own) OVER w = own AND lag(col) OVER w = col - 1 THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY page, row_no ORDER BY col)
), g AS (SELECT page, row_no, CAST(sum(fresh) AS INTEGER) AS segments, CAST(max(col) + 1 AS INTEGER) AS reach FROM n GROUP BY page, row_no)
SELECT page, CAST(row_no AS INTEGER) AS row_no, segments, max(reach) OVER (PARTITION BY page ORDER BY row_no) AS width FROM g"""
_PIPES = f"""{_PLACED}, w AS (SELECT page, max(col) AS most FROM o GROUP BY page
), r AS (SELECT DISTINCT o.page, o.row_no, w.most FROM o JOIN w ON o.page = w.page
), a AS (SELECT page, row_no, most, unnest(range(0, most + 1)) AS col FROM r
), l AS (
    SELECT a.page, a.row_no, a.most, '| ' || string_agg(coalesce(replace(p.text, '|', '\\|'), ''), ' | ' ORDER BY a.col) || ' |' AS line
    FROM a LEFT JOIN o ON o.page = a.page AND o.row_no = a.row_no AND o.col = a.col
    LEFT JOIN p ON p.page = o.page AND p.pos = o.own AND p.row_no = a.row_no AND p.col = a.col
    GROUP BY a.page, a.row_no, a.most
)
SELECT page, string_agg(CASE WHEN row_no = 0 THEN line || chr(10) || '|' || repeat(' --- |', CAST(most + 1 AS INTEGER)) ELSE line END, chr(10) ORDER BY row_no) AS md FROM l GROUP BY page"""



def table_images(spark, sf_dir):
    """Boxes of one kind stretched to tables, those of the second as the page's pictures, those of the
    third, where they lie in a table, as its detected ones; two pixels a point. Some tables are a
    picture themselves."""
    d = dense(spark, sf_dir)
    x1, y1 = F.col("x1") + F.when(F.col("pos") % 4 == 0, 0).otherwise(60), F.col("y1") + F.when(F.col("pos") % 4 == 0, 0).otherwise(40)
    px = [(c * 2).alias(n) for n, c in zip(P.FIELDS, (F.col("x0"), F.col("y0"), x1, y1))]
    tables = d.where("category_id = 5").select("page", "pos", *px, (10 - 2 * F.col("x0")).alias("dx"), (20 - 2 * F.col("y0")).alias("dy"))
    same = d.where("category_id = 5 AND pos % 8 = 0").select("page", (F.col("pos") + 1000).alias("pos"), *P.FIELDS)
    images = d.where("category_id = 3").select("page", "pos", *P.FIELDS).unionByName(same)
    one = d.where("category_id = 1").select("page", "pos", *((F.col(c) * 2).alias(c) for c in P.FIELDS))
    layout = P.beside(one, tables, P.G.inside).select("page", F.col("b_pos").alias("table_pos"), "pos", *P.FIELDS)
    return P.table_images(tables, images, layout, 2.0)


_IMAGES = f"""WITH {DENSE}, t AS MATERIALIZED (
    SELECT page, pos, x0, y0, x1 + CASE WHEN pos % 4 = 0 THEN 0 ELSE 60 END AS x1, y1 + CASE WHEN pos % 4 = 0 THEN 0 ELSE 40 END AS y1 FROM dense WHERE category_id = 5
), i AS (
    SELECT page, pos, x0, y0, x1, y1 FROM dense WHERE category_id = 3
    UNION ALL SELECT page, pos + 1000, x0, y0, x1, y1 FROM dense WHERE category_id = 5 AND pos % 8 = 0
), own AS MATERIALIZED (
    SELECT t.page, t.pos AS table_pos, i.pos, 'page' AS source, i.x0, i.y0, i.x1, i.y1, t.x0 AS tx, t.y0 AS ty
    FROM i JOIN t ON i.page = t.page AND i.x0 >= t.x0 AND i.y0 >= t.y0 AND i.x1 <= t.x1 AND i.y1 <= t.y1
    WHERE (i.x1 - i.x0) * (i.y1 - i.y0) / ((t.x1 - t.x0) * (t.y1 - t.y0)) < 0.9
), every AS (
    SELECT * FROM own
    UNION ALL
    SELECT t.page, t.pos, d.pos, 'layout', d.x0, d.y0, d.x1, d.y1, t.x0, t.y0
    FROM dense d JOIN t ON d.page = t.page AND d.x0 >= t.x0 AND d.y0 >= t.y0 AND d.x1 <= t.x1 AND d.y1 <= t.y1
    WHERE d.category_id = 1 AND NOT EXISTS (SELECT 1 FROM own WHERE own.page = t.page AND own.table_pos = t.pos)
)
SELECT page, table_pos, pos, source, x0 * 2 AS x0, y0 * 2 AS y0, x1 * 2 AS x1, y1 * 2 AS y1,
       (x0 - tx) * 2 + 10 AS tx0, (y0 - ty) * 2 + 20 AS ty0, (x1 - tx) * 2 + 10 AS tx1, (y1 - ty) * 2 + 20 AS ty1 FROM every"""

QUERIES = {
    "table_images": (table_images, _IMAGES),
    "table_cells": (table_cells, _CELLS),
    "table_segments": (table_segments, _SEGMENTS),
    "table_pipes": (table_pipes, _PIPES),
}
