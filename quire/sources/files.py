"""Documents from files and content to files, through Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

#: Suffixes that are read.
IMAGES, OFFICE = ["png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff"], ["docx", "pptx", "xlsx"]


def documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of any store that Spark reads: path, name, kind (pdf, image, office or null), length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    suffix = T.magic_suffix(F.col("content"), F.col("path"))
    kind = F.when(suffix == "pdf", "pdf").when(suffix.isin(IMAGES), "image").when(suffix.isin(OFFICE), "office")
    # The zip head of office files says no more than that; the path tells which.
    by_path = F.lower(F.replace(T.suffix(F.col("path")), F.lit("."), F.lit("")))
    return files.select("path", T.stem(F.col("path")).alias("name"), F.when(by_path.isin(OFFICE), "office").otherwise(kind).alias("kind"), "length", "content")


def read_at(content: Column, offset: Column, limit: Column) -> Column:
    """Bytes of a range; a negative limit means to the end."""
    return F.when(limit < 0, F.substring(content, offset + 1, F.length(content))).otherwise(F.substring(content, offset + 1, limit))


def csv_cell(value: Column) -> Column:
    """A cell that is always quoted."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_row(*values: Column) -> Column:
    return F.array_join(F.array(*map(csv_cell, values)), ",")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_discard(df: DataFrame) -> None:
    """Work everything out and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def write_markdown(df: DataFrame, path: str) -> None:
    """One text for each document, below doc=<id>."""
    df.select(F.col("doc_id").alias("doc"), F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("doc").option("lineSep", "\n").text(path)


def fan_out(df: DataFrame, *writers) -> None:
    """The same rows to several sinks, worked out once: each writer takes the DataFrame."""
    held = df.persist()
    try:
        for write in writers:
            write(held)
    finally:
        held.unpersist()
