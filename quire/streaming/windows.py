"""Pages as they come: tumbling windows of pages, micro-batches, resuming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def page_window(page_idx: Column, size: int = 64) -> Column:
    """The number of the window of `size` pages that a page falls into."""
    return F.floor(page_idx / size).cast("long")


def windows(pages: DataFrame, size: int = 64) -> DataFrame:
    """Per document and window: its pages, items and whether it is the document's last."""
    from pyspark.sql import Window

    w = pages.groupBy("doc_id", page_window(F.col("page_idx"), size).alias("win")).agg(F.countDistinct("page_idx").alias("pages"), F.count(F.lit(1)).alias("items"))
    return w.withColumn("file_end", F.col("win") == F.max("win").over(Window.partitionBy("doc_id")))


def in_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Work through a stream of pages by micro-batches. Each batch is written below its own number
    and replaces what an earlier try of it left, so a restart from the checkpoint repeats nothing."""
    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(events: DataFrame, key: str, ts: str, width: str = "1 hour") -> DataFrame:
    """The last event of each key in each tumbling window of time (ties: the largest event_id)."""
    return events.groupBy(key, F.window(ts, width).getField("start").alias("start")).agg(F.max(F.struct(ts, "event_id")).getField("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))
