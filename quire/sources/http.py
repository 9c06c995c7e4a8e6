"""Addresses as a source and as a sink. Requests go out from the executors, one after the other in a
task; a row that fails says why and stops nothing."""

from __future__ import annotations

import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ask(url: str, body: bytes | None, seconds: float, most: int, start: int = 0, length: int | None = None) -> tuple[int | None, bytes | None, str | None]:
    """start, length: the part of the content that is wanted; a server that sends all of it is read
    past what comes before, a piece at a time."""
    if not str(url).lower().startswith(("http://", "https://")):
        return None, None, "no http address"
    part = start > 0 or length is not None
    if length == 0:
        return None, b"", None
    headers = {"Range": f"bytes={start}-{'' if length is None else start + length - 1}"} if part else {}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers), timeout=seconds) as answer:
            skip = start if part and answer.status != 206 else 0
            while skip and (passed := len(answer.read(min(skip, 1 << 20)))):
                skip -= passed
            content = answer.read(most + 1 if length is None else min(most + 1, length))
            return (answer.status, None, f"more than {most} bytes") if len(content) > most else (answer.status, content, None)
    except urllib.error.HTTPError as e:
        return e.code, None, str(e)
    except (OSError, ValueError) as e:
        return None, None, str(e)


def get(addresses: DataFrame, url: str = "url", seconds: float = 30.0, most: int = 256 << 20, offset: str | None = None, limit: str | None = None) -> DataFrame:
    """url, status, content, error for each row; contents of at most `most` bytes. A null address has
    an error; equal ones are asked for each.

    offset, limit: columns of the first byte (from 0; null: 0) and the number of bytes (null or
    negative: all that follow) that are wanted of each content. The server is asked for that part;
    of one that sends everything the part is cut out. Nothing is asked for where limit is 0; a
    negative offset has an error.
    """
    of = lambda c, other: F.coalesce(F.col(c).cast("long"), F.lit(other)) if c else F.lit(other)

    def run(batches):
        for pdf in batches:
            for u, start, n in zip(pdf["u"], pdf["start"], pdf["n"]):  # a row at a time: contents may be large
                status, content, error = None, None, "no address" if u is None else "negative offset"
                if u is not None and start >= 0:
                    status, content, error = _ask(u, None, seconds, most, int(start), None if n < 0 else int(n))
                yield pd.DataFrame({"url": [u], "status": pd.array([status], "Int32"), "content": [content], "error": [error]})

    rows = addresses.select(F.col(url).cast("string").alias("u"), of(offset, 0).cast("long").alias("start"), of(limit, -1).cast("long").alias("n"))
    return rows.mapInPandas(run, "url string, status int, content binary, error string")


def post(rows: DataFrame, url: str = "url", content: str = "content", seconds: float = 30.0) -> DataFrame:
    """Send each content (null: empty) to its address: url, status, error. A task that is tried again
    sends again, so receivers must take a content twice."""

    def run(batches):
        for pdf in batches:
            for u, body in zip(pdf["u"], pdf["c"]):
                status, _, error = _ask(u, bytes(body or b""), seconds, 1 << 20) if u is not None else (None, None, "no address")
                yield pd.DataFrame({"url": [u], "status": pd.array([status], "Int32"), "error": [error]})

    return rows.select(F.col(url).cast("string").alias("u"), F.col(content).cast("binary").alias("c")).mapInPandas(run, "url string, status int, error string")


def normalize(inputs: DataFrame, column: str = "input") -> DataFrame:
    """Inputs as they are given (paths or addresses): name, kind (http, path) and suffix, ready for
    `get` or for quire.sources.files.documents. Blank and null ones are left out."""
    from quire.functions import text as T

    text = F.btrim(F.col(column).cast("string"))
    bare = F.regexp_replace(text, r"[?#].*$", "")
    web = text.rlike("(?i)^https?://")
    return inputs.select(text.alias("input"), F.when(web, "http").otherwise("path").alias("kind"), T.stem(bare).alias("name"), F.lower(F.replace(T.suffix(bare), F.lit("."), F.lit(""))).alias("suffix")).where("input <> ''")
