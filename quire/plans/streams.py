"""Queries that run as streams, stopped and started again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.plans.views import ITEMS, items
from quire.streaming import analysis as A

SIZE, STARTS = 2, 3


def windowed_resume(spark, sf_dir):
    """Pages of all documents in three arrivals, each read by a new start of the same query; every
    tenth document is cancelled with the second, and pages of even documents come again with the last."""
    i = items(spark, sf_dir).groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("text")).alias("chars"))
    pages = i.withColumn("pages", (F.max("page_idx").over(Window.partitionBy("doc_id")) + 1).cast("int"))
    arrives = F.floor((F.col("page_idx") * 5 + F.col("doc_id")) % 7 / 3).cast("int")
    columns = ["doc_id", "page_idx", "pages", "items", "chars", "cancel"]
    rows = pages.withColumn("cancel", F.lit(False)).select(*columns, arrives.alias("start"))
    stops = pages.where("page_idx = 0 AND doc_id % 10 = 3").select("doc_id", F.lit(None).cast("int").alias("page_idx"), "pages", F.lit(0).cast("long").alias("items"), F.lit(0).cast("long").alias("chars"), F.lit(True).alias("cancel"), F.lit(1).alias("start"))
    again = rows.where("doc_id % 2 = 0").withColumn("start", F.lit(STARTS - 1))
    source, out, checkpoint = (A.folder(spark, f"windowed-{k}") for k in ("source", "out", "state"))
    every = rows.unionByName(stops).unionByName(again)
    for start in range(STARTS):
        every.where(F.col("start") == start).drop("start").write.mode("append").parquet(source)
        A.analyse(spark, source, out, checkpoint, SIZE)
    return spark.read.schema(A.OUT).parquet(out)


_RESUME = f"""WITH {ITEMS}, i AS (SELECT doc_id, page_idx, count(*) AS items, CAST(sum(length(text)) AS BIGINT) AS chars FROM items GROUP BY doc_id, page_idx
), p AS (SELECT *, max(page_idx) OVER (PARTITION BY doc_id) + 1 AS pages, (page_idx * 5 + doc_id) % 7 // 3 AS start FROM i
), w AS (SELECT doc_id, CAST(page_idx // {SIZE} AS BIGINT) AS win, count(*) AS pages, CAST(sum(items) AS BIGINT) AS items, CAST(sum(chars) AS BIGINT) AS chars, max(pages) AS total, max(start) AS done FROM p GROUP BY ALL)
SELECT doc_id, win, pages, items, chars, (win + 1) * {SIZE} >= total AS file_end FROM w WHERE NOT (doc_id % 10 = 3 AND done >= 1)"""

QUERIES = {"windowed_resume": (windowed_resume, _RESUME)}
