"""Pages of documents as a stream with state: windows of pages leave it once they are whole, a
restart goes on where the last start ended, a document can be cancelled."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PAGES = "doc_id long, page_idx int, pages int, items long, chars long, cancel boolean"
OUT = "doc_id long, win long, pages long, items long, chars long, file_end boolean"


class _Window(StatefulProcessor):
    """One window of one document: its pages so far, until it is whole or cancelled."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle) -> None:
        self.state = handle.getValueState("window", "seen binary, items long, chars long, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen, items, chars, over = self.state.get() if self.state.exists() else (b"", 0, 0, False)
        seen, cancelled, pages = set(np.frombuffer(bytes(seen), np.int32).tolist()), False, 0
        for r in rows:
            cancelled, pages = cancelled or r.cancel, max(pages, r.pages)
            if not r.cancel and r.page_idx not in seen:
                seen.add(r.page_idx)
                items, chars = items + r.items, chars + r.chars
        doc_id, win = key
        if over or cancelled:
            if not over:
                self.state.update((b"", 0, 0, True))
            return
        whole = len(seen) == min(self.size, pages - win * self.size)
        if whole:
            yield Row(doc_id=doc_id, win=win, pages=len(seen), items=items, chars=chars, file_end=(win + 1) * self.size >= pages)
        self.state.update((b"", 0, 0, True) if whole else (np.array(sorted(seen), np.int32).tobytes(), items, chars, False))

    def close(self) -> None:
        pass


def closed_windows(stream: DataFrame, size: int = 64) -> DataFrame:
    """stream: PAGES, a row for each page: its number from 0, the document's number of pages, its
    items and characters; or a row with cancel, whose page_idx does not count.

    Gives each window of `size` pages once, in the micro-batch in which its last page arrives: doc_id,
    win, pages, items, chars, file_end (whether it is the document's last). Pages that come again
    count once. A cancelled document's windows that are not whole by the micro-batch before never
    come. A window is a key of its own, so a document of very many pages spreads over all tasks; its
    state is the numbers of its pages, and one mark once it is over.
    """
    of_page = F.floor(F.col("page_idx") / size)
    all_of = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("pages") / size) - 1).cast("int"))
    keyed = stream.withColumn("win", F.explode(F.when(F.col("cancel"), all_of).otherwise(F.array(of_page.cast("int")))))
    rows = keyed.select("doc_id", F.col("win").cast("long").alias("win"), "page_idx", "pages", "items", "chars", "cancel")
    return rows.groupBy("doc_id", "win").transformWithState(_Window(size), OUT, "append", "None")


def folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, deleted when the driver ends; a
    folder of this machine stands in where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    path = f"{(named or os.path.join(tempfile.gettempdir(), 'quire-streams')).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(made)
    return path


def analyse(spark: SparkSession, source: str, out: str, checkpoint: str, size: int = 64) -> None:
    """One start over the files that source has and the checkpoint has not seen; its windows are
    added to out. Started again, after a stop or a failure, it repeats and loses nothing."""
    own = spark.newSession()
    for key, value in (
        ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")),
        ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"),
        ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"),
        ("spark.sql.streaming.stateStore.unloadOnCommit", "true"),
    ):
        own.conf.set(key, value)
    done = closed_windows(own.readStream.schema(PAGES).parquet(source), size)
    done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
