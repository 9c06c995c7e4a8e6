"""Documents put together, order-dependent operators, evaluation by alignment, windows and models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import evaluation as E
from quire.operators import greedy as Y
from quire.operators.models import BatchModel, apply_model
from quire.plans.joins import DENSE, dense
from quire.plans.views import ITEMS, ITEMS_B, boxes, edits_sql, items, items_b, micro, micro_sql, table
from quire.sources import files
from quire.streaming import windows as W


def _labelled(spark, sf_dir):
    label = F.when(F.col("category_id") == 1, "text").when(F.col("category_id") == 3, "image").otherwise("table")
    return dense(spark, sf_dir).withColumn("label", label)


def _boxes(df):
    return df.select("page", "pos", *Y.FIELDS)


def _html(kind: str, drop: int):
    """A table for each order: one row for each line."""
    def run(spark, sf_dir):
        d = boxes(spark, sf_dir).where(f"pos % {drop} <> 1")
        cell = F.concat(F.lit("<tr><td>"), F.col("x0").cast("long"), F.lit("</td><td>"), F.col("category_id"), F.lit("</td></tr>"))
        rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", cell.alias("c")))), lambda s: s["c"]), "")
        return d.groupBy("page").agg(F.concat(F.lit("<table><tr><th>part</th><th>qty</th></tr>"), rows, F.lit("</table>")).alias(kind))
    return run


def teds(spark, sf_dir):
    a, b = _html("a", 9)(spark, sf_dir), _html("b", 3)(spark, sf_dir)
    j = a.join(b, "page")
    both = j.select("page", E.teds_columns(F.col("a"), F.col("b")).alias("v"))
    return both.select("page", micro(F.col("v.teds")).alias("teds"), micro(F.col("v.teds_struct")).alias("teds_struct"))


class Backwards(BatchModel):
    """A model of our own: the text read from its end."""

    def predict(self, batch: pd.Series) -> pd.Series:
        return batch.str[::-1]


def custom_model(spark, sf_dir):
    return items(spark, sf_dir).select("doc_id", "item_pos", apply_model(Backwards, F.col("text")).alias("out"))


def stage_chain(spark, sf_dir):
    """Stages one after the other: detections to regions, regions to a model, results to pages."""
    d = items(spark, sf_dir)
    read = d.withColumn("out", F.when(F.col("item_pos") % 2 == 0, apply_model(Backwards, F.col("text"))).otherwise(F.col("text")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_pos", "out"))), lambda s: s["out"]), "\n")
    return read.groupBy("doc_id", "page_idx").agg(F.md5(F.encode(whole, "UTF-8")).alias("page"))


def to_markdown(spark, sf_dir):
    """Blocks by type: titles with their level, lists, text."""
    d = items(spark, sf_dir)
    kind = F.when(F.col("item_pos") % 20 == 0, "title").when(F.col("item_pos") % 5 == 4, "list").otherwise("text")
    body = T.escape_markdown(F.col("text"))
    level = T.title_level((F.col("doc_id") % 7 - 1).cast("int"))
    md = F.when(kind == "title", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), body)).when(kind == "list", F.concat(F.lit("- "), body)).otherwise(body)
    return d.select("doc_id", "item_pos", kind.alias("type"), F.md5(F.encode(md, "UTF-8")).alias("md"))


def content_list_v2(spark, sf_dir):
    page = items(spark, sf_dir).groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(F.struct("item_pos", "type"))).alias("l"), F.sum(F.length("text")).alias("chars"))
    return page.select("doc_id", "page_idx", F.size("l").alias("n"), "chars", F.array_join(F.transform("l", lambda s: s["type"]), ",").alias("types"))


def caption_adjacent(spark, sf_dir):
    """The type of a caption by the blocks beside it: that of the block after, else before."""
    d = _labelled(spark, sf_dir)
    w = Window.partitionBy("page").orderBy("pos")
    after, before = F.lead("label").over(w), F.lag("label").over(w)
    kind = F.when(after.isin("image", "table"), after).when(before.isin("image", "table"), before).otherwise(F.lit("text"))
    return d.select("page", "pos", "label", kind.alias("owner")).where("label = 'text'").select("page", "pos", "owner")


def toc_semi(spark, sf_dir):
    """Entries of a contents list keep their anchor only if the body has it."""
    d = items(spark, sf_dir)
    entries, body = d, d.where("item_pos % 3 = 0").select(F.col("doc_id").alias("d"), F.col("item_pos").alias("anchor"))
    j = entries.join(body, (F.col("doc_id") == F.col("d")) & (F.col("item_pos") == F.col("anchor")), "left")
    return j.select("doc_id", "item_pos", "anchor")


def lineage_match(spark, sf_dir):
    """Each item of system B with the first item of A of its page that reads alike, claimed by place."""
    a, b = items(spark, sf_dir), items_b(spark, sf_dir)
    a = a.select(F.col("doc_id").alias("d"), F.col("page_idx").alias("p"), F.col("item_pos").alias("source"), F.md5(F.encode(T.comparable(F.col("text")), "UTF-8")).alias("h"))
    b = b.withColumn("g", F.md5(F.encode(T.comparable(F.col("text")), "UTF-8")))
    j = b.join(a, (F.col("doc_id") == F.col("d")) & (F.col("page_idx") == F.col("p")) & (F.col("g") == F.col("h")))
    return j.groupBy("doc_id", "item_pos").agg(F.min("source").alias("source"))


def chunk_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("stem"))
    k = F.floor((F.row_number().over(Window.partitionBy("stem").orderBy("doc_id")) - 1) / 5).cast("long")
    return d.withColumn("chunk", k).groupBy("stem", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), (F.countDistinct("doc_id") == F.count(F.lit(1))).alias("distinct_ids"))


def micro_batch(spark, sf_dir):
    d = items(spark, sf_dir).groupBy("doc_id", F.floor(F.col("item_pos") / 8).cast("long").alias("batch"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def type_seq(spark, sf_dir):
    """Edit rate of the type sequences of two systems on a page."""
    def coded(df, name):
        one = F.when(F.col("type") == "text", "t").otherwise("e")
        return df.groupBy("doc_id", "page_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_pos", one.alias("c")))), lambda s: s["c"]), "").alias(name))
    j = coded(items(spark, sf_dir), "a").join(coded(items_b(spark, sf_dir), "b"), ["doc_id", "page_idx"])
    return j.select("doc_id", "page_idx", micro(T.edit_rate(F.col("a"), F.col("b"))).alias("v"))


def sketch_cost(spark, sf_dir):
    """Cost of matching long texts: by their ends, and by their lengths."""
    d = table(spark, sf_dir, "documents").where("length(text) > 320")
    hyp = F.concat(F.translate("text", "e", "a"), F.repeat(F.lit("e"), (F.col("doc_id") % 50).cast("int")))
    ends = lambda s: F.concat(F.left(s, F.lit(160)), F.lit("\n"), F.right(s, F.lit(160)))
    n = F.greatest(F.length("text"), F.length(hyp))
    v = F.least(F.lit(1.0), T.edit_rate(ends(F.col("text")), ends(hyp)) * 0.8 + F.abs(F.length("text") - F.length(hyp)) / n * 0.2)
    return d.select("doc_id", micro(v).alias("v"))


def chart_pivot(spark, sf_dir):
    """A chart's cells, series by category, as rows of a table."""
    e = table(spark, sf_dir, "events").withColumn("c", F.floor(F.col("value") * 100 + 0.5).cast("long"))
    p = e.groupBy("user_id").pivot("event_type", ["click", "view", "error"]).agg(F.sum("c"))
    return p.select("user_id", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("click", "view", "error")))


def sheet_bounds(spark, sf_dir):
    """Bounds of the filled cells of a sheet."""
    d = boxes(spark, sf_dir).select((F.col("page") % 50).alias("sheet"), F.floor(F.col("x0") / 10).cast("int").alias("c"), F.floor(F.col("y0") / 10).cast("int").alias("r")).distinct()
    return d.groupBy("sheet").agg(F.min("r").alias("top"), F.max("r").alias("bottom"), F.min("c").alias("first_col"), F.max("c").alias("last_col"), F.count(F.lit(1)).alias("cells"))


def recover_rows(spark, sf_dir):
    """Rows of a table's cells: a new row wherever the top falls by more than 10."""
    from quire.operators.runs import break_runs

    w = Window.partitionBy("page").orderBy("y0", "pos")
    before = F.lag("y0").over(w)
    d = break_runs(dense(spark, sf_dir), ["page"], ["y0", "pos"], before.isNull() | (F.col("y0") - before > 10), "row")
    return d.groupBy("page", "row").agg(F.count(F.lit(1)).alias("cells"), F.min("y0").alias("top"))


def union_routes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    office, other = d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0")
    return office.select("doc_id", F.lit("office").alias("route")).unionByName(other.select("doc_id", F.lit("pipeline").alias("route")))


def resume_offset(spark, sf_dir):
    """Pages of a resumed run counted on from where the first one stopped."""
    d = items(spark, sf_dir).groupBy("doc_id").agg(F.max("page_idx").alias("last"))
    return items(spark, sf_dir).join(d, "doc_id").select("doc_id", "item_pos", (F.col("page_idx") + F.col("last") + 1).cast("int").alias("page_idx"))


def greedy(step):
    return lambda spark, sf_dir: _boxes(step(_labelled(spark, sf_dir)))


_MD = "CASE WHEN item_pos % 20 = 0 THEN repeat('#', CAST(CASE WHEN doc_id % 7 - 1 > 4 THEN 4 WHEN doc_id % 7 - 1 < 1 THEN 0 ELSE doc_id % 7 - 1 END AS INTEGER)) || ' ' || body WHEN item_pos % 5 = 4 THEN '- ' || body ELSE body END"
_NORM = "md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')))"

_W, _H = "least(a.x1, b.x1) - greatest(a.x0, b.x0)", "least(a.y1, b.y1) - greatest(a.y0, b.y0)"
_MEET = f"(greatest({_W}, 0) * greatest({_H}, 0))"
_AREA = lambda t: f"(({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0))"
_MEET1 = f"(greatest({_W} + 1, 0) * greatest({_H} + 1, 0))"
_AREA1 = lambda t: f"(({t}.x1 - {t}.x0 + 1) * ({t}.y1 - {t}.y0 + 1))"
# What stays depends on what stayed before: a step for each box, or for each pair, in order.
_NMS = f"""WITH {DENSE}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, pos DESC) AS k FROM dense),
rv AS (SELECT a.page, a.k, list(b.k) FILTER (b.k IS NOT NULL) AS rivals FROM o a LEFT JOIN o b ON a.page = b.page AND b.k < a.k AND {_MEET1} / ({_AREA1('a')} + {_AREA1('b')} - {_MEET1}) >= CASE WHEN a.category_id = b.category_id THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END GROUP BY ALL),
st AS (SELECT page, list({{'k': k, 'rv': coalesce(rivals, CAST([] AS BIGINT[])), 'kept': CAST([] AS BIGINT[])}} ORDER BY k) AS steps FROM rv GROUP BY page),
e AS (SELECT page, list_reduce(steps, lambda s, x: CASE WHEN list_has_any(s.kept, x.rv) THEN s ELSE {{'k': CAST(0 AS BIGINT), 'rv': CAST([] AS BIGINT[]), 'kept': list_append(s.kept, x.k)}} END, {{'k': CAST(0 AS BIGINT), 'rv': CAST([] AS BIGINT[]), 'kept': CAST([] AS BIGINT[])}}).kept AS kept FROM st)
SELECT o.page, pos, x0, y0, x1, y1 FROM o JOIN e ON o.page = e.page AND list_contains(kept, k)"""


def _pairwise(name: str, source: str, hit: str, first_goes: str, each: str) -> str:
    """Pairs of `source` in order; of one whose boxes both are there, one goes."""
    return f"""{name}_p AS (SELECT a.page, list({{'i': a.pos, 'j': b.pos, 'f': {first_goes}, 'gone': CAST([] AS INTEGER[])}} ORDER BY a.pos, b.pos) AS steps FROM {source} a JOIN {source} b ON a.page = b.page AND {each} AND {hit} GROUP BY a.page),
{name}_g AS (SELECT page, list_reduce(steps, lambda s, x: CASE WHEN list_contains(s.gone, x.i) OR list_contains(s.gone, x.j) THEN s ELSE {{'i': 0, 'j': 0, 'f': false, 'gone': list_append(s.gone, CASE WHEN x.f THEN x.i ELSE x.j END)}} END, {{'i': 0, 'j': 0, 'f': false, 'gone': CAST([] AS INTEGER[])}}).gone AS gone FROM {name}_p),
{name} AS (SELECT s.* FROM {source} s LEFT JOIN {name}_g g ON s.page = g.page WHERE g.page IS NULL OR NOT list_contains(gone, s.pos))"""


_OVERLAPS = f"""WITH {DENSE}, {_pairwise('kept', 'dense', f"{_MEET} / least({_AREA('a')}, {_AREA('b')}) > 0.5::DOUBLE AND (a.category_id = b.category_id OR NOT (a.category_id = 3 OR b.category_id = 3))", f"{_AREA('a')} < {_AREA('b')}", 'a.pos < b.pos')}
SELECT page, pos, x0, y0, x1, y1 FROM kept"""
_SHARE = f"{_MEET} / least({_AREA('a')}, {_AREA('b')}) > 0.5::DOUBLE"
_SMALLER = f"""WITH {DENSE}, {_pairwise('kept', 'dense', _SHARE, f"CASE WHEN (a.category_id = 3) <> (b.category_id = 3) THEN a.category_id = 3 ELSE {_AREA('a')} <= {_AREA('b')} END", 'a.pos < b.pos')} SELECT page, pos, x0, y0, x1, y1 FROM kept"""
_LARGER = f"""WITH {DENSE}, {_pairwise('kept', 'dense', _SHARE, f"{_AREA('a')} >= {_AREA('b')}", 'a.pos < b.pos')} SELECT page, pos, x0, y0, x1, y1 FROM kept"""
_TWINS = f"""WITH {DENSE}, {_pairwise('one', 'dense', f"{_MEET} / ({_AREA('a')} + {_AREA('b')} - {_MEET}) > 0.5::DOUBLE", 'a.score < b.score', 'a.pos <> b.pos')},
{_pairwise('kept', 'one', f"{_MEET} / least({_AREA('a')}, {_AREA('b')}) > 0.5::DOUBLE", f"{_AREA('a')} <= {_AREA('b')}", 'a.pos <> b.pos')} SELECT page, pos, x0, y0, x1, y1 FROM kept"""
_FAR = "sqrt(pow(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + pow(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2))"
_CAPTIONS = f"""WITH RECURSIVE {DENSE}, p AS (SELECT a.page, a.pos AS i, b.pos AS j, {_FAR} AS far, row_number() OVER (PARTITION BY a.page ORDER BY {_FAR}, a.pos, b.pos) AS k FROM dense a JOIN dense b ON a.page = b.page AND a.category_id = 1 AND b.category_id = 3),
r AS (SELECT page, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS c, CAST([] AS INTEGER[]) AS f FROM p GROUP BY page UNION ALL
    SELECT r.page, r.k + 1, CASE WHEN list_contains(c, i) OR list_contains(f, j) THEN c ELSE list_append(c, i) END, CASE WHEN list_contains(c, i) OR list_contains(f, j) THEN f ELSE list_append(f, j) END FROM r JOIN p ON p.page = r.page AND p.k = r.k + 1),
e AS (SELECT page, arg_max(c, k) AS c, arg_max(f, k) AS f FROM r GROUP BY page), n AS (SELECT page, i, arg_min(j, (far, j)) AS nearest FROM p GROUP BY ALL)
SELECT n.page, n.i AS pos, coalesce(f[list_position(c, i)], nearest) AS subject_pos FROM n JOIN e USING (page)"""
# The second table has some rows of the first: what differs is left out, three nodes a row.
_TEDS = f"""WITH {DENSE}, n AS (SELECT page, count(*) FILTER (pos % 9 <> 1) AS a, count(*) FILTER (pos % 3 <> 1) AS b FROM boxes GROUP BY page)
SELECT page, {micro_sql('1 - 3 * (a - b) / CAST(5 + 3 * a AS DOUBLE)')} AS teds, {micro_sql('1 - 3 * (a - b) / CAST(5 + 3 * a AS DOUBLE)')} AS teds_struct FROM n WHERE a > 0 AND b > 0"""

QUERIES = {
    "nms": (greedy(lambda d: Y.suppress(d, 0.3, 0.5)), _NMS),
    "overlap_filter": (greedy(lambda d: Y.drop_overlaps(d, 0.5)), _OVERLAPS),
    "overlap_blocks": (greedy(lambda d: Y.drop_smaller(d, 0.5)), _SMALLER),
    "overlap_boxes": (greedy(lambda d: Y.drop_smaller(d, 0.5, False, None)), _LARGER),
    "greedy_spans": (greedy(lambda d: Y.drop_twins(d, 0.5, 0.5)), _TWINS),
    "absorb": (greedy(lambda d: Y.absorb(d, 0.5)), None),
    "xycut": (lambda s, d: Y.reading_order(dense(s, d)), None),
    "sorted_boxes": (lambda s, d: Y.row_order(dense(s, d)), None),
    "merge_adjacent": (lambda s, d: Y.merge_words(dense(s, d)), None),
    "knn_caption": (lambda s, d: Y.pair_captions(dense(s, d).where("category_id = 1"), dense(s, d).where("category_id = 3")), _CAPTIONS),
    "align_page": (lambda s, d: E.align_pages(items(s, d), items_b(s, d)), None),
    "order_corr": (lambda s, d: E.match_orders(items(s, d), items_b(s, d)), None),
    "teds": (teds, _TEDS),
    "custom_model": (custom_model, f"WITH {ITEMS} SELECT doc_id, item_pos, reverse(text) AS out FROM items"),
    "stage_chain": (stage_chain, f"WITH {ITEMS} SELECT doc_id, page_idx, md5(string_agg(CASE WHEN item_pos % 2 = 0 THEN reverse(text) ELSE text END, chr(10) ORDER BY item_pos)) AS page FROM items GROUP BY ALL"),
    "to_markdown": (to_markdown, f"WITH {ITEMS}, b AS (SELECT *, regexp_replace(text, '([*`~])', '\\\\\\1', 'g') AS body FROM items) SELECT doc_id, item_pos, CASE WHEN item_pos % 20 = 0 THEN 'title' WHEN item_pos % 5 = 4 THEN 'list' ELSE 'text' END AS type, md5({_MD}) AS md FROM b"),
    "content_list_v2": (content_list_v2, f"WITH {ITEMS} SELECT doc_id, page_idx, CAST(count(*) AS INTEGER) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(type, ',' ORDER BY item_pos) AS types FROM items GROUP BY ALL"),
    "caption_adjacent": (caption_adjacent, f"WITH {DENSE}, l AS (SELECT page, pos, CASE category_id WHEN 1 THEN 'text' WHEN 3 THEN 'image' ELSE 'table' END AS label FROM dense), n AS (SELECT *, lead(label) OVER w AS a, lag(label) OVER w AS b FROM l WINDOW w AS (PARTITION BY page ORDER BY pos)) SELECT page, pos, CASE WHEN a IN ('image', 'table') THEN a WHEN b IN ('image', 'table') THEN b ELSE 'text' END AS owner FROM n WHERE label = 'text'"),
    "toc_semi": (toc_semi, f"WITH {ITEMS} SELECT doc_id, item_pos, CASE WHEN item_pos % 3 = 0 THEN item_pos END AS anchor FROM items"),
    "lineage_match": (lineage_match, f"WITH {ITEMS_B} SELECT b.doc_id, b.item_pos, min(a.item_pos) AS source FROM items_b b JOIN items a ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND {_NORM.replace('text', 'a.text')} = {_NORM.replace('text', 'b.text')} GROUP BY ALL"),
    "chunk_ids": (chunk_ids, "WITH k AS (SELECT source || '-' || lang AS stem, doc_id, (row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1) // 5 AS chunk FROM documents) SELECT stem, chunk, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT doc_id) = count(*) AS distinct_ids FROM k GROUP BY ALL"),
    "micro_batch": (micro_batch, f"WITH {ITEMS} SELECT doc_id, CAST(item_pos // 8 AS BIGINT) AS batch, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM items GROUP BY ALL"),
    "page_window": (lambda s, d: W.windows(items(s, d), 2), f"WITH {ITEMS}, w AS (SELECT doc_id, CAST(page_idx // 2 AS BIGINT) AS win, count(DISTINCT page_idx) AS pages, count(*) AS items FROM items GROUP BY ALL) SELECT *, win = max(win) OVER (PARTITION BY doc_id) AS file_end FROM w"),
    "coalesce_latest": (lambda s, d: W.latest(table(s, d, "events"), "user_id", "ts").select("user_id", F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_id", "n"), "SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY ALL"),
    "resume_offset": (resume_offset, f"WITH {ITEMS}, l AS (SELECT doc_id, max(page_idx) AS last FROM items GROUP BY doc_id) SELECT doc_id, item_pos, CAST(page_idx + last + 1 AS INTEGER) AS page_idx FROM items JOIN l USING (doc_id)"),
    "batch_ratio": (lambda s, d: table(s, d, "documents").groupBy(F.when(F.col("n_chars") >= 16000, 16).when(F.col("n_chars") >= 8000, 8).when(F.col("n_chars") >= 4000, 4).when(F.col("n_chars") >= 2000, 2).otherwise(1).alias("ratio")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN n_chars >= 16000 THEN 16 WHEN n_chars >= 8000 THEN 8 WHEN n_chars >= 4000 THEN 4 WHEN n_chars >= 2000 THEN 2 ELSE 1 END AS ratio, count(*) AS n FROM documents GROUP BY ALL"),
    "type_seq": (type_seq, f"WITH {ITEMS_B}, a AS (SELECT doc_id, page_idx, repeat('t', CAST(count(*) AS INTEGER)) AS a FROM items GROUP BY ALL), b AS (SELECT doc_id, page_idx, string_agg(CASE WHEN type = 'text' THEN 't' ELSE 'e' END, '' ORDER BY item_pos) AS b FROM items_b GROUP BY ALL) SELECT doc_id, page_idx, {micro_sql('levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE)')} AS v FROM a JOIN b USING (doc_id, page_idx)"),
    "sketch_cost": (sketch_cost, f"WITH d AS (SELECT doc_id, text AS a, replace(text, 'e', 'a') || repeat('e', doc_id % 50) AS b FROM documents WHERE length(text) > 320), e AS (SELECT *, left(a, 160) || chr(10) || right(a, 160) AS x, left(b, 160) || chr(10) || right(b, 160) AS y FROM d) SELECT doc_id, {micro_sql('least(1.0::DOUBLE, (' + edits_sql('x', 'y') + ') / CAST(greatest(length(x), length(y)) AS DOUBLE) * 0.8::DOUBLE + abs(length(a) - length(b)) / CAST(greatest(length(a), length(b)) AS DOUBLE) * 0.2::DOUBLE)')} AS v FROM e"),
    "chart_pivot": (chart_pivot, "WITH c AS (SELECT user_id, event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c FROM events) SELECT user_id, " + ", ".join(f"CAST(coalesce(sum(c) FILTER (event_type = '{k}'), 0) AS BIGINT) AS {k}" for k in ("click", "view", "error")) + " FROM c GROUP BY user_id"),
    "sheet_bounds": (sheet_bounds, f"WITH {DENSE}, c AS (SELECT DISTINCT page % 50 AS sheet, CAST(floor(x0 / 10) AS INTEGER) AS c, CAST(floor(y0 / 10) AS INTEGER) AS r FROM boxes) SELECT sheet, min(r) AS top, max(r) AS bottom, min(c) AS first_col, max(c) AS last_col, count(*) AS cells FROM c GROUP BY sheet"),
    "recover_rows": (recover_rows, f'WITH {DENSE}, l AS (SELECT *, lag(y0) OVER (PARTITION BY page ORDER BY y0, pos) AS b FROM dense), g AS (SELECT *, CAST(sum(CASE WHEN b IS NULL OR y0 - b > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, pos ROWS UNBOUNDED PRECEDING) AS INTEGER) AS "row" FROM l) SELECT page, "row", count(*) AS cells, min(y0) AS top FROM g GROUP BY ALL'),
    "union_routes": (union_routes, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'office' ELSE 'pipeline' END AS route FROM documents"),
    "csv_export": (lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.encode(files.csv_row(F.col("doc_id"), F.col("source"), F.concat(F.lit('"'), "text")), "UTF-8")).alias("row")), """SELECT doc_id, md5('"' || doc_id || '","' || source || '","' || replace('"' || text, '"', '""') || '"') AS row FROM documents"""),
}
