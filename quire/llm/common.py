"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one the cluster names in
    spark.checkpoint.dir.

    A folder of this machine stands in only where that is unset and all tasks run in this one
    process, as in tests; elsewhere its lack is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "quire-shared")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own


class _Written(threading.local):
    """Tables that this thread of the driver wrote, in order: queries side by side keep apart."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Written()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for a table or for files in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def few_files(rows: int, each: int) -> int:
    """Tasks (and so files) for a table of small rows, `each` of them for one; twelve at least."""
    return max(12, -(-rows // each))


def spill(df: DataFrame, what: str, files: int | None = None) -> DataFrame:
    """df written as a compressed table in the shared folder and read from there; computed at once.

    files: as many tasks at most write it, for tables of small rows that would else be spread over
    many tiny files (a local file system starts a process for each file it creates). Row groups are
    small, so that a task's writer holds little. The table is deleted by drop_since, or when the
    driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df = df if files is None else df.coalesce(files)
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    files, made = _files(spark, path)
    files.deleteOnExit(made)
    _written.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spilled = path
    return out


def mark() -> int:
    """A place among the tables written, for drop_since."""
    return len(_written.paths)


def drop_since(spark: SparkSession, place: int, *kept: DataFrame, keep: str | None = None) -> None:
    """Delete the tables written since `place` but `kept`, which spill returned, and those that were
    written as `keep`. For callers whose later plans read nothing else."""
    held = {df._spilled for df in kept}
    for path in _written.paths[place:]:
        if path not in held and not (keep and path.rpartition("/")[2].startswith(f"{keep}-")):
            files, made = _files(spark, path)
            files.delete(made, True)
            _written.paths.remove(path)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let no batch that goes to a Python worker hold more bytes than this (or one row), whatever
    the length of texts: the session's setting, unless it is smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "2147483646")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def by_bytes(texts, most: int):
    """Ranges (lo, hi) of an Arrow string array that hold at most `most` bytes each, or one text."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


#: DuckDB: crc_table.t[k + 1] is the k-th entry of the table of CRC-32, and checksum(key) of a text
#: of ASCII characters, where crc_table is joined.
CRC_TABLE = """table0 AS MATERIALIZED (
    SELECT n, list_reduce([CAST(n AS BIGINT), 0, 1, 2, 3, 4, 5, 6, 7], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), x >> 1) ELSE x >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n)
), crc_table AS MATERIALIZED (SELECT list(v ORDER BY n) AS t FROM table0)"""


def crc_sql(key: str) -> str:
    """DuckDB: the CRC-32 of an expression's text, where crc_table is joined."""
    codes = f"list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({key}, ''), lambda x: CAST(ascii(x) AS BIGINT)))"
    return f"xor(list_reduce({codes}, lambda r, b: xor(r >> 8, t[xor(r & 255, b) + 1])), CAST(4294967295 AS BIGINT))"


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(n))


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a string column; one narrow aggregate."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0
