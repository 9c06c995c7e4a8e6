"""Inputs of the queries, derived from the given tables: for Spark as DataFrames, for DuckDB as
the same arithmetic in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micro(x: Column) -> Column:
    """Millionths as a whole number: what both engines agree on to the last digit."""
    return F.floor(x * 1e6 + 0.5).cast("long")


def micro_sql(x: str) -> str:
    return f"CAST(floor(({x}) * CAST(1e6 AS DOUBLE) + 0.5) AS BIGINT)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of pages: page, pos, category_id (1 text, 3 image, 5 table), score, x0, y0, x1, y1."""
    # renamed first: what comes after finds its pages dealt already
    table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page").createOrReplaceTempView("quire_lineitem")
    return spark.sql("""
        SELECT page,
               CAST(row_number() OVER (PARTITION BY page ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos,
               CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 5 END AS category_id,
               1 - l_discount AS score,
               CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y0,
               CAST(l_partkey % 500 AS DOUBLE) + 10 + l_quantity * 4 AS x1,
               CAST(l_suppkey * 7 % 700 AS DOUBLE) + 8 + l_partkey % 40 AS y1
        FROM quire_lineitem""")


BOXES = """boxes AS MATERIALIZED (
    SELECT l_orderkey AS page,
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS pos,
           CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 5 END AS category_id,
           1 - l_discount AS score,
           CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y0,
           CAST(l_partkey % 500 AS DOUBLE) + 10 + l_quantity * 4 AS x1,
           CAST(l_suppkey * 7 % 700 AS DOUBLE) + 8 + l_partkey % 40 AS y1
    FROM lineitem)"""


def pairs(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Pairs of boxes of a page: page, i, j and the boxes as a_*, b_*; i < j, or i <> j with every."""
    b = boxes(spark, sf_dir)
    fields = ("category_id", "score", "x0", "y0", "x1", "y1")
    one = b.select("page", F.col("pos").alias("i"), *(F.col(c).alias(f"a_{c}") for c in fields))
    two = b.select(F.col("page").alias("page_b"), F.col("pos").alias("j"), *(F.col(c).alias(f"b_{c}") for c in fields))
    rule = F.col("i") != F.col("j") if every else F.col("i") < F.col("j")
    return one.join(two, (F.col("page") == F.col("page_b")) & rule).drop("page_b")


_AB = ", ".join(f"{t}.{c} AS {t}_{c}" for t in "ab" for c in ("category_id", "score", "x0", "y0", "x1", "y1"))
PAIRS = f"{BOXES}, pairs AS (SELECT a.page, a.pos AS i, b.pos AS j, {_AB} FROM boxes a JOIN boxes b ON a.page = b.page AND a.pos < b.pos)"
EVERY = f"{BOXES}, pairs AS (SELECT a.page, a.pos AS i, b.pos AS j, {_AB} FROM boxes a JOIN boxes b ON a.page = b.page AND a.pos <> b.pos)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content items of documents, system A: doc_id, page_idx, item_pos, type, text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).where("text <> ''")
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("p")) - 1
    d = d.withColumn("item_pos", pos)
    return d.select("doc_id", F.floor(F.col("item_pos") / 20).cast("int").alias("page_idx"), "item_pos", F.lit("text").alias("type"), "text")


ITEMS = """items AS (
    SELECT doc_id, CAST(item_pos // 20 AS INTEGER) AS page_idx, item_pos, 'text' AS type, text
    FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS item_pos, text
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)
          WHERE text <> ''))"""


def items_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System B: every seventh item lost, letters changed in every fifth, types in every eleventh."""
    a = items(spark, sf_dir).where("item_pos % 7 <> 6")
    text = F.when(F.col("item_pos") % 5 == 0, F.translate("text", "e", "a")).otherwise(F.col("text"))
    kind = F.when(F.col("item_pos") % 11 == 10, "equation").otherwise("text")
    return a.select("doc_id", "page_idx", "item_pos", kind.alias("type"), text.alias("text"))


ITEMS_B = f"""{ITEMS}, items_b AS (
    SELECT doc_id, page_idx, item_pos, CASE WHEN item_pos % 11 = 10 THEN 'equation' ELSE 'text' END AS type,
           CASE WHEN item_pos % 5 = 0 THEN replace(text, 'e', 'a') ELSE text END AS text
    FROM items WHERE item_pos % 7 <> 6)"""


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched items of the two systems: doc_id, item_pos, ref, hyp."""
    a, b = items(spark, sf_dir), items_b(spark, sf_dir)
    b = b.select(F.col("doc_id").alias("d"), F.col("item_pos").alias("p"), F.col("text").alias("hyp"))
    both = a.join(b, (F.col("doc_id") == F.col("d")) & (F.col("item_pos") == F.col("p")))
    return both.select("doc_id", "item_pos", F.col("text").alias("ref"), "hyp")


TEXT_PAIRS = f"{ITEMS_B}, tp AS (SELECT a.doc_id, a.item_pos, a.text AS ref, b.text AS hyp FROM items a JOIN items_b b ON a.doc_id = b.doc_id AND a.item_pos = b.item_pos)"

#: DuckDB's levenshtein counts bytes: the letters beyond ASCII that the given tables hold stand as
#: control characters, one byte each, where it compares.
_WIDE = "éÉßÇçäÄóèñÑÊíêüÖÍÜÈöÓ"


def one_byte(x: str) -> str:
    return f"translate({x}, '{_WIDE}', " + " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 14 + len(_WIDE) - 8)]) + ")"


def edits_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 0 ELSE levenshtein({one_byte(a)}, {one_byte(b)}) END"


def ned_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 0 ELSE levenshtein({one_byte(a)}, {one_byte(b)}) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired runs: user_id, a, b (seconds of two systems on one document; hundredths exactly)."""
    e = table(spark, sf_dir, "events")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    side = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.sum(cents).alias(name))
    return side("click", "a").join(side("view", "b"), "user_id")


RUNS = """runs AS (
    SELECT user_id, a, b
    FROM (SELECT user_id, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS a FROM events WHERE event_type = 'click' GROUP BY user_id)
    JOIN (SELECT user_id, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS b FROM events WHERE event_type = 'view' GROUP BY user_id) USING (user_id))"""
