"""Runs, aggregates, statistics and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import evaluation as E
from quire.operators import runs as R
from quire.operators import stats as S
from quire.plans.joins import DENSE, TYPED, dense, typed
from quire.plans.views import BOXES, ITEMS, ITEMS_B, RUNS, TEXT_PAIRS, boxes, items, items_b, micro, micro_sql, ned_sql, runs, table, text_pairs


def merge_intervals(spark, sf_dir):
    d = R.islands(dense(spark, sf_dir), ["page"], "x0", "x1", ["pos"])
    return d.groupBy("page", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def islands(spark, sf_dir):
    d = R.islands(dense(spark, sf_dir), ["page"], "y0", "y1", ["pos"])
    return d.groupBy("page", "island").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n"))


def _islands_sql(lo: str, hi: str) -> str:
    return f"""WITH {DENSE}, f AS (SELECT *, CASE WHEN max({hi}) OVER (PARTITION BY page ORDER BY {lo}, {hi}, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {lo} THEN 0 ELSE 1 END AS nw FROM dense),
    g AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY page ORDER BY {lo}, {hi}, pos ROWS UNBOUNDED PRECEDING) AS INTEGER) AS island FROM f)"""


def merge_spans(spark, sf_dir):
    """Spans of a line that overlap in x become one, in lines wider than four heights."""
    d = R.lines(dense(spark, sf_dir))
    m = R.islands(d, ["page", "line"], "x0", "x1", ["pos"]).groupBy("page", "line", "island").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return m.where("x1 - x0 > 4 * (y1 - y0)")


_LINES = f"""{DENSE}, pl AS (SELECT *, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM dense WINDOW w AS (PARTITION BY page ORDER BY y0, pos)),
fl AS (SELECT *, CASE WHEN py0 IS NULL OR NOT (greatest(0.0::DOUBLE, least(y1, py1) - greatest(y0, py0)) / least(y1 - y0, py1 - py0) > 0.6::DOUBLE) THEN 1 ELSE 0 END AS nw FROM pl),
lines AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY page ORDER BY y0, pos ROWS UNBOUNDED PRECEDING) AS INTEGER) AS line FROM fl)"""


def line_bbox(spark, sf_dir):
    d = R.lines(dense(spark, sf_dir))
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "pos"))), lambda s: s["pos"].cast("string")), ",")
    return d.groupBy("page", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), order.alias("spans"))


def text_groups(spark, sf_dir):
    d = typed(spark, sf_dir).withColumn("type", F.when(F.col("pos") % 4 == 0, F.col("block")).otherwise(F.lit("text")))
    return R.type_groups(d).groupBy("page", "grp").agg(F.min("type").alias("type"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def projection(spark, sf_dir):
    return R.projection(dense(spark, sf_dir), ["page"], F.col("y0").cast("int"), F.col("y1").cast("int"))


def virtual_lines(spark, sf_dir):
    """Tall boxes as lines of equal height: as many as fit, 1 to 3 for low ones."""
    d = boxes(spark, sf_dir).withColumn("n", F.greatest(F.lit(1), F.floor((F.col("y1") - F.col("y0")) / 10)).cast("int"))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    step = (F.col("y1") - F.col("y0")) / F.col("n")
    return d.select("page", "pos", "k", micro(F.col("y0") + step * F.col("k")).alias("y0"), micro(F.col("y0") + step * (F.col("k") + 1)).alias("y1"))


def dense_line_index(spark, sf_dir):
    w = Window.partitionBy("page").orderBy("y0", "x0", "pos")
    return dense(spark, sf_dir).select("page", "pos", (F.row_number().over(w) - 1).alias("index"))


def regroup(spark, sf_dir):
    d = typed(spark, sf_dir).withColumn("g", F.col("pos") % 7)
    body = F.max(F.when(F.col("category_id") == 3, F.struct("pos", "x0", "y0")))
    return d.groupBy("page", "g").agg(F.median("index").alias("index"), body["pos"].alias("body"), F.count_if(F.col("category_id") == 1).alias("captions"))


def flatten_groups(spark, sf_dir):
    d = dense(spark, sf_dir)
    w = Window.partitionBy("page").orderBy(F.col("x0") + F.col("y0"), "pos")
    note = (F.col("x1") - F.col("x0") > 120) & (F.col("y1") - F.col("y0") > 10) & (F.col("y0") > 400)
    return d.select("page", "pos", F.row_number().over(w).alias("k"), note.alias("footnote"))


def res_bucket(spark, sf_dir):
    side = lambda lo, hi: (F.ceil((F.col(hi) - F.col(lo)) / 64) * 64).cast("long")
    return boxes(spark, sf_dir).groupBy("category_id", side("y0", "y1").alias("h"), side("x0", "x1").alias("w")).agg(F.count(F.lit(1)).alias("n"))


def agg_stats(spark, sf_dir):
    return runs(spark, sf_dir).agg(*(micro(c).alias(k) for k, c in S.summary(F.col("a").cast("double") / F.col("b")).items() if k != "geomean"), F.floor(S.geometric_mean(F.col("a") / F.col("b")) * 1e4 + 0.5).cast("long").alias("geomean"))


def js_stats(spark, sf_dir):
    x = (F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(micro(F.avg(x)).alias("mean"), micro(F.median(x)).alias("median"), F.floor(F.coalesce(F.stddev_pop(x), F.lit(0.0)) * 1e4 + 0.5).cast("long").alias("stddev"))


def strata_report(spark, sf_dir):
    """NED of the two systems by source and language, with totals, over the items both have."""
    ref = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    d = text_pairs(spark, sf_dir).withColumn("v", micro(E.edit_rate(F.col("ref"), F.col("hyp")))).join(ref, "doc_id")
    return d.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most")).select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "total", "least", "most")


def modality_counts(spark, sf_dir):
    b = items_b(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("type") == "text").alias("texts"), F.count_if(F.col("type") == "equation").alias("equations"))
    return b.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("texts") > 0).alias("with_text"), F.count_if(F.col("equations") > 0).alias("with_equation"), F.sum("equations").alias("equations"))


def paired_docs(spark, sf_dir):
    return runs(spark, sf_dir).where("a IS NOT NULL AND b IS NOT NULL")


def pair_stems(spark, sf_dir):
    a, b = items(spark, sf_dir).where("item_pos = 3").select("doc_id"), items_b(spark, sf_dir).where("item_pos = 5").select("doc_id")
    return a.intersect(b)


def manifest_status(spark, sf_dir):
    """Each document of the manifest with the state of its runs."""
    m = table(spark, sf_dir, "documents").select("doc_id")
    b = items_b(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    j = m.join(b, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("n").isNull(), "missing").when(F.col("n") < 3, "short").otherwise("ok").alias("status"))


def alloc(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").groupBy(F.concat_ws("|", "source", "lang").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return S.allocate(sizes, "stratum", "n", 350, 3)


_SIZES = "sizes AS (SELECT source || '|' || lang AS stratum, count(*) AS n FROM documents GROUP BY ALL)"
_ALLOC = f"""{_SIZES}, a1 AS (SELECT *, least(3, n) AS base, least(350, sum(n) OVER ()) AS goal FROM sizes),
a2 AS (SELECT *, sum(base) OVER () AS used, n - base AS room FROM a1),
a3 AS (SELECT *, greatest(goal - used, 0) AS spare, coalesce(CAST(greatest(goal - used, 0) AS DOUBLE) * room / nullif(sum(room) OVER (), 0), 0) AS ideal FROM a2),
a4 AS (SELECT *, least(floor(ideal), room) AS whole FROM a3),
a5 AS (SELECT *, spare - sum(whole) OVER () AS lft, row_number() OVER (ORDER BY CASE WHEN whole < room THEN ideal - floor(ideal) ELSE -1 END DESC, stratum) AS turn, row_number() OVER (ORDER BY base DESC, stratum) AS place, count(*) OVER () AS m FROM a4),
alloc AS (SELECT stratum, n, CAST(CASE WHEN used > goal THEN greatest(base - floor((used - goal) / m) - CASE WHEN place <= (used - goal) % m THEN 1 ELSE 0 END, 0) ELSE base + whole + CASE WHEN turn <= lft AND whole < room THEN 1 ELSE 0 END END AS BIGINT) AS alloc FROM a5)"""


def strat_sample(spark, sf_dir):
    """A seeded sample of each stratum, of the size allocated to it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", "source", "lang").alias("stratum"))
    a = alloc(spark, sf_dir).select(F.col("stratum").alias("s"), "alloc")
    key = F.md5(F.encode(F.concat(F.lit("42|"), F.col("doc_id").cast("string")), "UTF-8"))
    w = Window.partitionBy("stratum").orderBy(key, "doc_id")
    return d.withColumn("k", F.row_number().over(w)).join(a, F.col("stratum") == F.col("s")).where("k <= alloc").select("doc_id", "stratum")


def sample_size(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return d.select("source", S.sample_size(F.lit(0.5), F.lit(0.05), F.col("n") * 100).alias("need"), micro(S.margin(F.lit(0.5), F.col("n"), F.col("n") * 100)).alias("margin"))


def holm(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("n_chars").alias("m"))
    d = d.withColumn("p", F.col("m") / 10000.0)
    return S.holm(d, "p", ["source"]).select("source", micro(F.col("adjusted_alpha")).alias("adjusted_alpha"), "significant")


def wilcoxon(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("g", F.col("user_id") % 3)
    w = S.signed_rank(r, ["g"], "a", "b")
    return w.select("g", "n_pairs", micro(F.col("statistic")).alias("statistic"), micro(F.col("effect_size_r")).alias("effect_size_r"), micro(F.col("median_diff").cast("double")).alias("median_diff"), F.floor(F.col("p_value") * 1e4 + 0.5).cast("long").alias("p4"))


_T = "(1 / (1 + abs(z) * 0.2316419::DOUBLE))"
_WILCOXON = f"""WITH {RUNS}, d AS (SELECT user_id % 3 AS g, a - b AS d FROM runs), e AS (SELECT g, count(*) AS n_pairs, median(d) AS md FROM d GROUP BY g),
r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM d WHERE d <> 0),
s AS (SELECT g, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS p, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS m FROM r GROUP BY g),
t AS (SELECT g, sum(k * k * k - k) AS ties FROM (SELECT g, abs(d) AS x, CAST(count(*) AS DOUBLE) AS k FROM d WHERE d <> 0 GROUP BY ALL) GROUP BY g),
z AS (SELECT *, (least(p, m) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE) AS z FROM e JOIN s USING (g) JOIN t USING (g))
SELECT g, n_pairs, {micro_sql('least(p, m)')} AS statistic, {micro_sql('(p - m) / (p + m)')} AS effect_size_r, {micro_sql('md')} AS median_diff,
CAST(floor(2 * exp(-z * z / 2) / sqrt(2 * pi()) * {_T} * (0.319381530::DOUBLE + {_T} * (-0.356563782::DOUBLE + {_T} * (1.781477937::DOUBLE + {_T} * (-1.821255978::DOUBLE + {_T} * 1.330274429::DOUBLE)))) * 1e4 + 0.5) AS BIGINT) AS p4 FROM z"""


def rank_corr(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("g", F.col("user_id") % 3)
    c = S.rank_correlation(r, ["g"], "a", "b")
    return c.select("g", "n", micro(F.col("kendall_tau")).alias("tau"), F.floor(F.col("spearman_rho") * 1e5 + 0.5).cast("long").alias("rho"))


_RANK = f"""WITH {RUNS}, r AS (SELECT user_id % 3 AS g, user_id, a, b, rank() OVER (PARTITION BY user_id % 3 ORDER BY a) + (count(*) OVER (PARTITION BY user_id % 3, a) - 1) / 2.0::DOUBLE AS ra,
rank() OVER (PARTITION BY user_id % 3 ORDER BY b) + (count(*) OVER (PARTITION BY user_id % 3, b) - 1) / 2.0::DOUBLE AS rb FROM runs),
t AS (SELECT x.g, sum(sign(x.a - y.a) * sign(x.b - y.b)) AS s, sum(abs(sign(x.a - y.a))) AS ta, sum(abs(sign(x.b - y.b))) AS tb FROM r x JOIN r y ON x.g = y.g AND x.user_id < y.user_id GROUP BY x.g),
c AS (SELECT g, count(*) AS n, corr(ra, rb) AS rho FROM r GROUP BY g)
SELECT g, n, {micro_sql('s / sqrt(CAST(ta AS DOUBLE) * tb)')} AS tau, CAST(floor(rho * 1e5 + 0.5) AS BIGINT) AS rho FROM c JOIN t USING (g)"""


def bootstrap(spark, sf_dir):
    r = runs(spark, sf_dir).select((F.col("user_id") % 3).alias("g"), "user_id", F.col("a") / 100.0, F.col("b") / 100.0).toDF("g", "user_id", "a", "b")
    return S.bootstrap(r, ["g"], "a", "b", "user_id")


def timing_rollup(spark, sf_dir):
    """Stage sums in milliseconds, the share of each stage and what the stages leave."""
    e = table(spark, sf_dir, "events").withColumn("c", F.floor(F.col("value") * 100 + 0.5).cast("long"))
    stage = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("c")).otherwise(0))
    s = e.groupBy("user_id").agg(F.sum("c").alias("total"), stage("click").alias("click"), stage("view").alias("view"))
    return s.select("user_id", "total", "click", "view", F.greatest(F.lit(0), F.col("total") - F.col("click") - F.col("view")).alias("other"), micro(F.col("click") / F.col("total")).alias("share"))


def stability(spark, sf_dir):
    """Whether all runs of a document gave the same content."""
    d = items(spark, sf_dir).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"))
    return d.groupBy("doc_id").agg((F.countDistinct("h") == 1).alias("stable"), F.countDistinct("h").alias("versions"))


def asset_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.sum("n_chars").alias("bytes"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("packs"), F.countDistinct("lang").alias("n"))


def section_number(spark, sf_dir):
    """Numbers of nested headings: a count at each level, reset by the levels above it."""
    d = items(spark, sf_dir).select("doc_id", "item_pos", (F.pmod(F.col("item_pos") * 7, F.lit(3)) + 1).alias("level"))
    w = Window.partitionBy("doc_id").orderBy("item_pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("n1", F.sum((F.col("level") == 1).cast("int")).over(w))
    w2 = Window.partitionBy("doc_id", "n1").orderBy("item_pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("n2", F.sum((F.col("level") == 2).cast("int")).over(w2))
    w3 = Window.partitionBy("doc_id", "n1", "n2").orderBy("item_pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("n3", F.sum((F.col("level") == 3).cast("int")).over(w3))
    one = lambda c: F.greatest(F.lit(1), F.col(c)).cast("string")
    number = F.when(F.col("level") == 1, one("n1")).when(F.col("level") == 2, F.concat_ws(".", one("n1"), one("n2"))).otherwise(F.concat_ws(".", one("n1"), one("n2"), one("n3")))
    return d.select("doc_id", "item_pos", number.alias("number"))


def seg_flag(spark, sf_dir):
    """Whether a line begins a paragraph (the one before ended with a stop) and whether it ends one."""
    d = items(spark, sf_dir)
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("item_pos"))
    stop = lambda c: c.rlike(r"[.!?]$")
    return d.select("doc_id", "item_pos", F.coalesce(stop(before), F.lit(True)).alias("starts"), stop(F.col("text")).alias("ends"))


def complexity_bucket(spark, sf_dir):
    d = boxes(spark, sf_dir).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("category_id") == 5).alias("tables"))
    return d.select("page", "n", "tables", F.when(F.col("n") <= 2, "simple").when(F.col("n") <= 5, "medium").otherwise("complex").alias("bucket"))


def page_slice(spark, sf_dir):
    """Pages of a range; a null or negative end means the last page."""
    d = items(spark, sf_dir).groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n"))
    pages = d.withColumn("pages", F.max("page_idx").over(Window.partitionBy("doc_id")) + 1)
    end = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit(-1)).otherwise(F.lit(1)).cast("int")
    last = F.when(end.isNull() | (end < 0), F.col("pages") - 1).otherwise(F.least(end, F.col("pages") - 1))
    return pages.where((F.col("page_idx") >= 0) & (F.col("page_idx") <= last)).select("doc_id", "page_idx", "n", (last >= F.col("pages") - 1).alias("file_end"))


def classify_text(spark, sf_dir):
    """txt or ocr by the characters of at most ten pages (in order of a seeded hash)."""
    d = items(spark, sf_dir).groupBy("doc_id", "page_idx").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("chars"))
    key = F.md5(F.encode(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("page_idx").cast("string")), "UTF-8"))
    some = d.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(key))).where("k <= 10")
    return some.groupBy("doc_id").agg(F.when(F.avg("chars") < 600, "ocr").otherwise("txt").alias("kind"))


def geomean(spark, sf_dir):
    return runs(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("g")).agg(F.floor(S.geometric_mean(F.col("a") / F.col("b")) * 1e4 + 0.5).cast("long").alias("gm"))


def merge_para(spark, sf_dir):
    """Lines of a page joined to a paragraph: words broken at a line's end are joined, others spaced."""
    d = items(spark, sf_dir)
    d = d.withColumn("line", F.when(F.col("item_pos") % 3 == 2, F.concat("text", F.lit("x-"))).otherwise(F.col("text")))
    line = F.btrim(T.escape_markdown(T.full_to_half_alnum(F.col("line"))))
    piece = F.when(line.rlike(r"[A-Za-z]+-\s*$"), F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(F.concat(line, F.lit(" ")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_pos", piece.alias("p")))), lambda s: s["p"]), "")
    return d.groupBy("doc_id", "page_idx").agg(F.md5(F.encode(whole, "UTF-8")).alias("text"))


_PARA = f"""WITH {ITEMS}, l AS (SELECT doc_id, page_idx, item_pos, trim(regexp_replace(CASE WHEN item_pos % 3 = 2 THEN text || 'x-' ELSE text END, '([*`~])', '\\\\\\1', 'g')) AS line FROM items)
SELECT doc_id, page_idx, md5(string_agg(CASE WHEN regexp_matches(line, '[A-Za-z]+-\\s*$') THEN substr(line, 1, length(line) - 1) ELSE line || ' ' END, '' ORDER BY item_pos)) AS text FROM l GROUP BY ALL"""


def content_list(spark, sf_dir):
    """Boxes as content items with per-mille boxes."""
    d = dense(spark, sf_dir)
    kind = F.when(F.col("category_id") == 1, "text").when(F.col("category_id") == 3, "image").otherwise("table")
    return d.select("page", "pos", kind.alias("type"), *((F.col(c) * 1000 / s).cast("int").alias(c) for c, s in (("x0", 720.0), ("y0", 760.0), ("x1", 720.0), ("y1", 760.0))))


def union_make(spark, sf_dir):
    """A document's Markdown: titles for the first item of a page, blocks parted by blank lines."""
    d = items(spark, sf_dir)
    md = F.when(F.col("item_pos") % 20 == 0, F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "item_pos", md.alias("m")))), lambda s: s["m"]), "\n\n")
    return d.groupBy("doc_id").agg(F.sha2(whole, 256).alias("markdown"), F.count(F.lit(1)).alias("n"))


def middle_json(spark, sf_dir):
    """Pages with their blocks as one JSON text for each document."""
    d = items(spark, sf_dir)
    block = F.struct(F.col("item_pos").alias("index"), F.length("text").alias("chars"))
    page = d.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    whole = F.array_sort(F.collect_list(F.struct("page_idx", "blocks")))
    return page.groupBy("doc_id").agg(F.to_json(whole).alias("pdf_info"))


def spans_by_cat(spark, sf_dir):
    kind = F.when(F.col("category_id") == 1, "text").when(F.col("category_id") == 3, "image").otherwise("table")
    return dense(spark, sf_dir).groupBy("page").pivot("category_id", [1, 3, 5]).agg(F.count(F.lit(1))).select("page", *(F.coalesce(F.col(str(k)), F.lit(0)).alias(n) for k, n in ((1, "texts"), (3, "images"), (5, "tables"))))


def gt_score(spark, sf_dir):
    """Scores of system B against A with A's counts below the line: what is missing scores worst."""
    a, b = items(spark, sf_dir), items_b(spark, sf_dir)
    b = b.select(F.col("doc_id").alias("d"), F.col("item_pos").alias("p"), F.col("type").alias("type_b"), F.col("text").alias("hyp"))
    j = a.join(b, (F.col("doc_id") == F.col("d")) & (F.col("item_pos") == F.col("p")), "left")
    cost = F.when(F.col("hyp").isNull() | (F.col("type_b") != F.col("type")), F.lit(1000000)).otherwise(micro(E.edit_rate(F.col("text"), F.coalesce("hyp", F.lit("")))))
    return j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_gt"), F.sum(cost).alias("cost"), F.count_if(F.col("hyp").isNull()).alias("only_gt"))


_STRATA = f"""WITH {TEXT_PAIRS}, v AS (SELECT lang, source, {micro_sql(ned_sql('ref', 'hyp'))} AS v FROM tp JOIN documents USING (doc_id))
SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most FROM v GROUP BY ROLLUP (lang, source)"""

QUERIES = {
    "merge_intervals": (merge_intervals, _islands_sql("x0", "x1") + " SELECT page, island, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY ALL"),
    "islands": (islands, _islands_sql("y0", "y1") + " SELECT page, island, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM g GROUP BY ALL"),
    "sessionize_lines": (lambda s, d: R.lines(dense(s, d)).select("page", "pos", "line"), f"WITH {_LINES} SELECT page, pos, line FROM lines"),
    "line_bbox": (line_bbox, f"WITH {_LINES} SELECT page, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(pos, ',' ORDER BY x0, pos) AS spans FROM lines GROUP BY ALL"),
    "merge_spans": (
        merge_spans,
        f"""WITH {_LINES}, f AS (SELECT *, CASE WHEN max(x1) OVER (PARTITION BY page, line ORDER BY x0, x1, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= x0 THEN 0 ELSE 1 END AS ni FROM lines),
        g AS (SELECT *, CAST(sum(ni) OVER (PARTITION BY page, line ORDER BY x0, x1, pos ROWS UNBOUNDED PRECEDING) AS INTEGER) AS island FROM f)
        SELECT page, line, island, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY page, line, island HAVING max(x1) - min(x0) > 4 * (max(y1) - min(y0))""",
    ),
    "text_groups": (
        text_groups,
        f"""WITH {TYPED}, t AS (SELECT page, pos, CASE WHEN pos % 4 = 0 THEN block ELSE 'text' END AS type FROM typed), l AS (SELECT *, lag(type) OVER (PARTITION BY page ORDER BY pos) AS before FROM t),
        g AS (SELECT *, CAST(sum(CASE WHEN before IS NULL OR type <> 'text' OR before <> 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY pos ROWS UNBOUNDED PRECEDING) AS INTEGER) AS grp FROM l)
        SELECT page, grp, min(type) AS type, count(*) AS n, min(pos) AS first_pos FROM g GROUP BY ALL""",
    ),
    "projection": (projection, f'WITH {DENSE}, e AS (SELECT page, CAST(trunc(y0) AS INTEGER) AS "at", 1 AS d FROM dense UNION ALL SELECT page, CAST(trunc(y1) AS INTEGER), -1 FROM dense), s AS (SELECT page, "at", sum(d) AS d FROM e GROUP BY ALL), r AS (SELECT page, "at", lead("at") OVER (PARTITION BY page ORDER BY "at") AS upto, CAST(sum(d) OVER (PARTITION BY page ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS INTEGER) AS n FROM s) SELECT * FROM r WHERE n > 0'),
    "virtual_lines": (virtual_lines, f"WITH {BOXES}, n AS (SELECT *, greatest(1, CAST(floor((y1 - y0) / 10) AS INTEGER)) AS n FROM boxes), k AS (SELECT *, CAST(unnest(range(0, n)) AS INTEGER) AS k FROM n) SELECT page, pos, k, {micro_sql('y0 + (y1 - y0) / n * k')} AS y0, {micro_sql('y0 + (y1 - y0) / n * (k + 1)')} AS y1 FROM k"),
    "dense_line_index": (dense_line_index, f'WITH {DENSE} SELECT page, pos, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0, pos) - 1 AS INTEGER) AS "index" FROM dense'),
    "regroup": (regroup, f'WITH {TYPED} SELECT page, pos % 7 AS g, median("index") AS "index", max(CASE WHEN category_id = 3 THEN pos END) AS body, count(*) FILTER (category_id = 1) AS captions FROM typed GROUP BY ALL'),
    "flatten_groups": (flatten_groups, f"WITH {DENSE} SELECT page, pos, CAST(row_number() OVER (PARTITION BY page ORDER BY x0 + y0, pos) AS INTEGER) AS k, x1 - x0 > 120 AND y1 - y0 > 10 AND y0 > 400 AS footnote FROM dense"),
    "res_bucket": (res_bucket, f"WITH {BOXES} SELECT category_id, CAST(ceil((y1 - y0) / 64) * 64 AS BIGINT) AS h, CAST(ceil((x1 - x0) / 64) * 64 AS BIGINT) AS w, count(*) AS n FROM boxes GROUP BY ALL"),
    "agg_stats": (agg_stats, f"WITH {RUNS}, v AS (SELECT CAST(a AS DOUBLE) / b AS v FROM runs) SELECT {micro_sql('avg(v)')} AS mean, {micro_sql('median(v)')} AS median, {micro_sql('stddev_samp(v)')} AS std, {micro_sql('min(v)')} AS min, {micro_sql('max(v)')} AS max, CAST(floor(exp(avg(ln(v))) * 1e4 + 0.5) AS BIGINT) AS geomean FROM v"),
    "geomean": (geomean, f"WITH {RUNS} SELECT user_id % 5 AS g, CAST(floor(exp(avg(ln(CAST(a AS DOUBLE) / b))) * 1e4 + 0.5) AS BIGINT) AS gm FROM runs GROUP BY ALL"),
    "js_stats": (js_stats, f"SELECT l_returnflag, {micro_sql('avg(l_quantity)')} AS mean, {micro_sql('median(l_quantity)')} AS median, CAST(floor(stddev_pop(l_quantity) * 1e4 + 0.5) AS BIGINT) AS stddev FROM lineitem GROUP BY ALL"),
    "strata_report": (strata_report, _STRATA),
    "modality_counts": (modality_counts, f"WITH {ITEMS_B}, d AS (SELECT doc_id, count(*) FILTER (type = 'text') AS texts, count(*) FILTER (type = 'equation') AS equations FROM items_b GROUP BY doc_id) SELECT count(*) AS docs, count(*) FILTER (texts > 0) AS with_text, count(*) FILTER (equations > 0) AS with_equation, CAST(sum(equations) AS BIGINT) AS equations FROM d"),
    "paired_docs": (paired_docs, f"WITH {RUNS} SELECT * FROM runs WHERE a IS NOT NULL AND b IS NOT NULL"),
    "pair_stems": (pair_stems, f"WITH {ITEMS_B} SELECT doc_id FROM items WHERE item_pos = 3 INTERSECT SELECT doc_id FROM items_b WHERE item_pos = 5"),
    "manifest_status": (manifest_status, f"WITH {ITEMS_B}, n AS (SELECT doc_id, count(*) AS n FROM items_b GROUP BY doc_id) SELECT d.doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN n < 3 THEN 'short' ELSE 'ok' END AS status FROM documents d LEFT JOIN n USING (doc_id)"),
    "alloc": (alloc, f"WITH {_ALLOC} SELECT * FROM alloc"),
    "strat_sample": (strat_sample, f"WITH {_ALLOC}, k AS (SELECT doc_id, source || '|' || lang AS stratum, row_number() OVER (PARTITION BY source, lang ORDER BY md5('42|' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, stratum FROM k JOIN alloc USING (stratum) WHERE k <= alloc"),
    "sample_size": (sample_size, f"WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, CAST(greatest(1, ceil((1.96::DOUBLE * 1.96 * 0.25 / 0.0025) / (1 + (1.96::DOUBLE * 1.96 * 0.25 / 0.0025 - 1) / (n * 100)))) AS BIGINT) AS need, {micro_sql('1.96::DOUBLE * 0.5 / sqrt(n) * sqrt((n * 100 - n) / CAST(n * 100 - 1 AS DOUBLE))')} AS margin FROM s"),
    "holm": (holm, f"""WITH p AS (SELECT source, min(n_chars) / 10000.0::DOUBLE AS p FROM documents GROUP BY source), r AS (SELECT *, 0.05::DOUBLE / (count(*) OVER () - row_number() OVER (ORDER BY p, source) + 1) AS a, row_number() OVER (ORDER BY p, source) AS k FROM p)
    SELECT source, {micro_sql('a')} AS adjusted_alpha, bool_and(p < a) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS significant FROM r"""),
    "wilcoxon": (wilcoxon, _WILCOXON),
    "rank_corr": (rank_corr, _RANK),
    "bootstrap": (bootstrap, None),
    "timing_rollup": (timing_rollup, f"WITH c AS (SELECT user_id, event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c FROM events), s AS (SELECT user_id, CAST(sum(c) AS BIGINT) AS total, CAST(sum(CASE WHEN event_type = 'click' THEN c ELSE 0 END) AS BIGINT) AS click, CAST(sum(CASE WHEN event_type = 'view' THEN c ELSE 0 END) AS BIGINT) AS view FROM c GROUP BY user_id) SELECT *, greatest(0, total - click - view) AS other, {micro_sql('click / CAST(total AS DOUBLE)')} AS share FROM s"),
    "stability": (stability, f"WITH {ITEMS} SELECT doc_id, count(DISTINCT text) = 1 AS stable, count(DISTINCT text) AS versions FROM items GROUP BY doc_id"),
    "asset_summary": (asset_summary, "SELECT source, CAST(sum(n_chars) AS BIGINT) AS bytes, string_agg(DISTINCT lang, ',' ORDER BY lang) AS packs, count(DISTINCT lang) AS n FROM documents GROUP BY source"),
    "section_number": (
        section_number,
        f"""WITH {ITEMS}, l AS (SELECT doc_id, item_pos, (item_pos * 7) % 3 + 1 AS level FROM items), a AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY item_pos ROWS UNBOUNDED PRECEDING) AS n1 FROM l),
        b AS (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n1 ORDER BY item_pos ROWS UNBOUNDED PRECEDING) AS n2 FROM a), c AS (SELECT *, sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n1, n2 ORDER BY item_pos ROWS UNBOUNDED PRECEDING) AS n3 FROM b)
        SELECT doc_id, item_pos, CASE level WHEN 1 THEN '' || greatest(1, n1) WHEN 2 THEN greatest(1, n1) || '.' || greatest(1, n2) ELSE greatest(1, n1) || '.' || greatest(1, n2) || '.' || greatest(1, n3) END AS number FROM c""",
    ),
    "seg_flag": (seg_flag, f"WITH {ITEMS}, l AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY item_pos) AS before FROM items) SELECT doc_id, item_pos, coalesce(regexp_matches(before, '[.!?]$'), true) AS starts, regexp_matches(text, '[.!?]$') AS ends FROM l"),
    "complexity_bucket": (complexity_bucket, f"WITH {BOXES}, n AS (SELECT page, count(*) AS n, count(*) FILTER (category_id = 5) AS tables FROM boxes GROUP BY page) SELECT *, CASE WHEN n <= 2 THEN 'simple' WHEN n <= 5 THEN 'medium' ELSE 'complex' END AS bucket FROM n"),
    "page_slice": (page_slice, f"WITH {ITEMS}, p AS (SELECT doc_id, page_idx, count(*) AS n FROM items GROUP BY ALL), q AS (SELECT *, max(page_idx) OVER (PARTITION BY doc_id) AS last FROM p) SELECT doc_id, page_idx, n, CASE WHEN doc_id % 3 = 2 THEN least(1, last) ELSE last END >= last AS file_end FROM q WHERE page_idx <= CASE WHEN doc_id % 3 = 2 THEN least(1, last) ELSE last END"),
    "classify_text": (classify_text, f"WITH {ITEMS}, p AS (SELECT doc_id, page_idx, sum(length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g'))) AS chars FROM items GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || '|' || page_idx)) AS k FROM p) SELECT doc_id, CASE WHEN avg(chars) < 600 THEN 'ocr' ELSE 'txt' END AS kind FROM k WHERE k <= 10 GROUP BY doc_id"),
    "merge_para": (merge_para, _PARA),
    "content_list": (content_list, f"WITH {DENSE} SELECT page, pos, CASE category_id WHEN 1 THEN 'text' WHEN 3 THEN 'image' ELSE 'table' END AS type, " + ", ".join(f"CAST(trunc({c} * 1000 / {s}::DOUBLE) AS INTEGER) AS {c}" for c, s in (("x0", 720), ("y0", 760), ("x1", 720), ("y1", 760))) + " FROM dense"),
    "union_make": (union_make, f"WITH {ITEMS} SELECT doc_id, sha256(string_agg(CASE WHEN item_pos % 20 = 0 THEN '# ' || text ELSE text END, chr(10) || chr(10) ORDER BY item_pos)) AS markdown, count(*) AS n FROM items GROUP BY doc_id"),
    "middle_json": (middle_json, f"""WITH {ITEMS}, p AS (SELECT doc_id, page_idx, string_agg('{{"index":' || item_pos || ',"chars":' || length(text) || '}}', ',' ORDER BY item_pos) AS blocks FROM items GROUP BY ALL)
    SELECT doc_id, '[' || string_agg('{{"page_idx":' || page_idx || ',"blocks":[' || blocks || ']}}', ',' ORDER BY page_idx) || ']' AS pdf_info FROM p GROUP BY doc_id"""),
    "spans_by_cat": (spans_by_cat, f"WITH {DENSE} SELECT page, count(*) FILTER (category_id = 1) AS texts, count(*) FILTER (category_id = 3) AS images, count(*) FILTER (category_id = 5) AS tables FROM dense GROUP BY page"),
    "gt_score": (gt_score, f"""WITH {ITEMS_B}, j AS (SELECT a.doc_id, a.type, b.type AS type_b, a.text AS ref, b.text AS hyp FROM items a LEFT JOIN items_b b ON a.doc_id = b.doc_id AND a.item_pos = b.item_pos)
    SELECT doc_id, count(*) AS n_gt, CAST(sum(CASE WHEN hyp IS NULL OR type_b <> type THEN 1000000 ELSE {micro_sql(ned_sql('ref', 'hyp'))} END) AS BIGINT) AS cost, count(*) FILTER (hyp IS NULL) AS only_gt FROM j GROUP BY doc_id"""),
}
