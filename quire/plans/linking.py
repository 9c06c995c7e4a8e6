"""Queries that link rendered blocks to their sources and rebuild nested lists, on the lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import linking as L
from quire.plans.views import ITEMS, items


def link_markdown(spark, sf_dir):
    i = items(spark, sf_dir)
    pos = F.col("item_pos")
    shells = i.select("doc_id", pos.alias("md_pos"), F.when((pos % 9).between(3, 6), F.floor(pos / 9).cast("int")).alias("list_id"))
    kind = F.when(pos % 13 == 5, "Content").otherwise("text")
    merge = F.when(pos % 10 >= 7, F.floor(pos / 10).cast("int"))
    return L.link(shells, i.select("doc_id", pos.alias("block_pos"), "page_idx", kind.alias("kind"), merge.alias("merge_id")))


_LINK = f"""WITH RECURSIVE {ITEMS}, s AS MATERIALIZED (
    SELECT *, CASE WHEN list_id IS NULL THEN md_pos ELSE min(md_pos) OVER (PARTITION BY doc_id, list_id) END AS unit, CASE WHEN list_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, list_id ORDER BY md_pos) - 1 END AS item
    FROM (SELECT doc_id, item_pos AS md_pos, CASE WHEN item_pos % 9 BETWEEN 3 AND 6 THEN item_pos // 9 END AS list_id FROM items)
), c AS MATERIALIZED (
    SELECT *, CASE WHEN merge_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY doc_id, merge_id ORDER BY page_idx, block_pos) END AS nth
    FROM (SELECT doc_id, item_pos AS block_pos, page_idx, item_pos % 13 = 5 AS content, CASE WHEN item_pos % 10 >= 7 THEN item_pos // 10 END AS merge_id FROM items)
), h AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, block_pos) - 1 AS place, content OR merge_id IS NOT NULL AS whole FROM c WHERE nth = 1
), u AS MATERIALIZED (SELECT doc_id, unit, count(*) AS n, bool_or(list_id IS NOT NULL) AS is_list, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS k FROM s GROUP BY doc_id, unit
), f AS (
    SELECT doc_id, 0 AS k, CAST(0 AS BIGINT) AS now, CAST(NULL AS BIGINT) AS unit, CAST(NULL AS BIGINT) AS start, true AS one FROM u GROUP BY doc_id
    UNION ALL SELECT f.doc_id, CAST(u.k AS INTEGER), now + CASE WHEN NOT is_list OR coalesce(whole, false) THEN 1 ELSE n END, u.unit, now, NOT is_list OR coalesce(whole, false)
    FROM f JOIN u ON f.doc_id = u.doc_id AND u.k = f.k + 1 LEFT JOIN h ON f.doc_id = h.doc_id AND h.place = f.now
), l AS (
    SELECT s.doc_id, s.md_pos, coalesce(p.block_pos, h.block_pos) AS block_pos, coalesce(p.page_idx, h.page_idx) AS page_idx
    FROM s JOIN f ON s.doc_id = f.doc_id AND s.unit = f.unit JOIN h ON s.doc_id = h.doc_id AND h.place = CASE WHEN one THEN start ELSE start + item END
    LEFT JOIN c p ON p.doc_id = s.doc_id AND p.merge_id = h.merge_id AND p.nth > 1 AND p.nth = s.item + 1 AND one AND s.list_id IS NOT NULL
)
SELECT *, coalesce(lag(page_idx) OVER (PARTITION BY doc_id ORDER BY md_pos) <> page_idx, false) AS divider FROM l"""


def nested_lists(spark, sf_dir):
    n = F.length("text")
    return L.nest(items(spark, sf_dir).select("doc_id", F.col("item_pos").alias("pos"), (n % 6).alias("level"), (n % 4 != 0).alias("ordered"), F.when(n % 7 == 0, n % 5 + 1).alias("start")))


_NEST = f"""WITH RECURSIVE {ITEMS}, i AS MATERIALIZED (
    SELECT doc_id, CAST(item_pos AS BIGINT) AS pos, length(text) % 6 AS level, length(text) % 4 <> 0 AS ordered, CASE WHEN length(text) % 7 = 0 THEN length(text) % 5 + 1 END AS start FROM items
), p AS MATERIALIZED (SELECT *, (SELECT max(b.pos) FROM i b WHERE b.doc_id = i.doc_id AND b.pos < i.pos AND b.level < i.level) AS parent FROM i
), r AS (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, parent ORDER BY pos) AS run FROM (
        SELECT *, CASE WHEN lag(level) OVER w = level AND lag(ordered) OVER w = ordered THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY doc_id, parent ORDER BY pos))
), n AS MATERIALIZED (
    SELECT *, CASE WHEN ordered THEN coalesce(arg_min(start, pos) OVER (PARTITION BY doc_id, parent, run), 1) + row_number() OVER (PARTITION BY doc_id, parent, run ORDER BY pos) - 1 END AS number FROM r
), t AS (
    SELECT doc_id, pos, 0 AS depth, parent, number, ordered, coalesce(CAST(number AS VARCHAR), '-') AS path FROM n WHERE parent IS NULL
    UNION ALL SELECT n.doc_id, n.pos, t.depth + 1, n.parent, n.number, n.ordered, t.path || '.' || coalesce(CAST(n.number AS VARCHAR), '-') FROM n JOIN t ON n.doc_id = t.doc_id AND n.parent = t.pos
)
SELECT doc_id, pos, depth, parent, number, path, repeat(' ', 4 * depth) || CASE WHEN ordered THEN number || '.' ELSE '-' END AS marker FROM t"""



def toc_anchors(spark, sf_dir):
    """Lines of contents lists and blocks of bodies, anchored by their first words."""
    i, n = items(spark, sf_dir), F.length("text")
    word = F.split_part("text", F.lit(" "), F.lit(1))
    entries = i.where(n % 3 != 0).select("doc_id", F.col("item_pos").alias("pos"), F.when(n % 7 != 0, F.concat(F.lit(" "), word)).alias("anchor"))
    blocks = i.where(n % 3 == 0).select("doc_id", F.when(n % 11 == 0, "  ").otherwise(F.concat(word, F.lit("  "))).alias("anchor"))
    return L.keep_anchors(entries, blocks)


_ANCHORS = f"""WITH {ITEMS}, w AS (SELECT doc_id, item_pos AS pos, length(text) AS n, split_part(text, ' ', 1) AS word FROM items
), known AS (SELECT doc_id, trim(word) AS anchor FROM w WHERE n % 3 = 0 AND n % 11 <> 0 AND trim(word) <> ''
), e AS (SELECT doc_id, pos, CASE WHEN n % 7 <> 0 THEN ' ' || word END AS anchor FROM w WHERE n % 3 <> 0)
SELECT doc_id, pos, CASE WHEN doc_id NOT IN (SELECT doc_id FROM known) THEN anchor
    WHEN (doc_id, trim(anchor)) IN (SELECT (doc_id, anchor) FROM known) THEN trim(anchor) END AS anchor FROM e"""

QUERIES = {
    "toc_anchors": (toc_anchors, _ANCHORS),
    "link_markdown": (link_markdown, _LINK),
    "nested_lists": (nested_lists, _NEST),
}
