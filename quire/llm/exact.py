"""Exact duplicates by two-pass Bloom filtering.

Each text is stripped of spaces and the controls 9 to 13 and hashed (SHA-256). The first pass adds
each hash to a filter of counting cells that stop at two: a task keeps two bit maps over its rows
(cells seen once, cells seen again), and the maps of all tasks are merged by segments. The second
pass asks the filter: a hash of which one cell was seen only once has no equal. Only rows whose
cells were all seen again are shuffled, as hash, id and length; the rest pass straight through.
False positives cost a shuffled row each and change no result.

The filter that a worker holds has a proven size, at most `cells` bits (64 MB). For more rows than
one such filter serves, hashes are dealt into slices by value, each with a filter of its own: the
table of hashes is sorted by slice within its files, so that a slice reads only its own row groups.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_since, mark, spill, table

#: What does not count when texts are compared: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
#: Cells of a filter for each row, cells that a hash is put in, most cells (bits) of a filter.
PER_ROW, PROBES, CELLS = 12, 3, 1 << 29
#: Cells in a segment: the unit in which filters are merged (two maps of 32 kB).
SEGMENT = 1 << 18
#: A group is hot if it holds more than one in so many rows (and more than LEAST): so there are at
#: most as many hot groups, and their summaries can be broadcast.
SHARE, LEAST = 10_000, 1000


def hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chars (code points of the text as it is), sha (binary, of the text without BLANKS),
    row (a number of its own for each row), h (long, for the filter). Null texts count as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    got = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("chars"), F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("sha"))
    return got.withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("sha")})


def _cells(h: np.ndarray, cells: int):
    """The cells of each hash, one array for each probe."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((h + np.uint64(k) * step) & np.uint64(cells - 1)).astype(np.int64)


def _longs(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _put(bits: np.ndarray, at: np.ndarray) -> None:
    """Set the bits at sorted places."""
    byte = at >> 3
    first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]])) if len(at) else at
    bits[byte[first]] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first) if len(at) else 0


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _count(batches, cells: int):
    """A task's maps: rows (seg, once, again) of the segments that it touches."""
    once, again = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
    for batch in batches:
        # a probe of one row that meets another of its own probes counts once for that row
        own = np.sort(np.stack(list(_cells(_longs(batch.column(0)), cells)), axis=1), axis=1)
        new = np.ones(own.shape, bool)
        new[:, 1:] = own[:, 1:] != own[:, :-1]
        at, n = np.unique(own[new], return_counts=True)
        _put(again, at[(n > 1) | _has(once, at)])
        _put(once, at)
    for seg in range(cells // SEGMENT):
        part = slice(seg * SEGMENT // 8, (seg + 1) * SEGMENT // 8)
        if once[part].any():
            maps = [zlib.compress(m[part].tobytes(), 1) for m in (once, again)]
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array(maps[:1], pa.binary()), pa.array(maps[1:], pa.binary())], ["seg", "once", "again"])


def _merge(batches):
    """Rows sorted by seg -> a row for each: the cells seen again in all; one segment at a time."""
    seg, once, again = None, None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array([zlib.compress(again.tobytes(), 1)], pa.binary())], ["seg", "again"])

    for batch in batches:
        for s, a, b in zip(*(batch.column(k) for k in range(3))):
            s, (a, b) = s.as_py(), (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (a, b))
            if s != seg:
                if seg is not None:
                    yield row()
                seg, once, again = s, a.copy(), b.copy()
            else:
                again |= b | (once & a)
                once |= a
    if seg is not None:
        yield row()


def _filter(hashed: DataFrame, cells: int) -> dict[int, bytes]:
    """The merged filter of a slice: compressed maps by segment, at most cells / 8 bytes in all."""
    own = hashed.select("h").mapInArrow(lambda it: _count(it, cells), "seg long, once binary, again binary")
    merged = own.repartition("seg").sortWithinPartitions("seg").mapInArrow(_merge, "seg long, again binary")
    return {r.seg: bytes(r.again) for r in merged.collect()}


def _ask(batches, sent, cells: int):
    """Adds `maybe`: whether all cells of a hash were seen again."""
    again = np.zeros(cells // 8, np.uint8)
    for seg, packed in sent.value.items():
        again[seg * SEGMENT // 8 : (seg + 1) * SEGMENT // 8] = np.frombuffer(zlib.decompress(packed), np.uint8)
    for batch in batches:
        h = _longs(batch.column(batch.schema.get_field_index("h")))
        maybe = np.ones(len(h), bool)
        for at in _cells(h, cells):
            maybe &= _has(again, at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], [*batch.schema.names, "maybe"])


def probe(hashed: DataFrame, per_row: int = PER_ROW, most: int = CELLS) -> DataFrame:
    """hashed (a written table with h) with `maybe`, written: true wherever another row has the same
    hash, and for few other rows. As many slices as the rows need, each with its own filter; most
    is a power of two, SEGMENT at least."""
    spark, n = hashed.sparkSession, hashed.count()
    slices = max(1, -(-n * per_row // most))
    cells = min(most, max(SEGMENT, 1 << (n * per_row // slices).bit_length()))
    if slices > 1:
        hashed = spill(hashed.withColumn("slice", F.pmod(F.shiftright("h", 40), F.lit(slices)).cast("int")).sortWithinPartitions("slice"), "exact-slices")
    out = []
    for k in range(slices):
        own = hashed if slices == 1 else hashed.where(F.col("slice") == k).drop("slice")
        sent = spark.sparkContext.broadcast(_filter(own, cells))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
        out.append(spill(own.mapInArrow(lambda it, sent=sent: _ask(it, sent, cells), f"{kinds}, maybe boolean"), "exact-probed"))
        sent.unpersist()
    return out[0] if slices == 1 else spark.read.schema(out[0].schema).parquet(*(df._spilled for df in out))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_row: int = PER_ROW, most: int = CELLS) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size (long), kept (boolean), text_sha256.

    Texts are equal when identical without BLANKS; null counts as empty, and all empty texts are
    equal. Of equal texts that with the most code points stays (as it is, blanks included), then
    that with the smallest id, null last. Rows that repeat id and length too are told apart by their
    place: exactly one row of each group has kept = true. Other columns of docs are not read, so
    their names cannot clash. An empty table gives an empty result.
    """
    spark, began = docs.sparkSession, mark()
    hashed = spill(hashes(docs, id_col, text_col), "exact-hashes")
    n = hashed.count()
    probed = probe(hashed, per_row, most)
    drop_since(spark, began, keep="exact-probed")
    alone = probed.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")

    rows = probed.where("maybe").drop("maybe", "h")
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    groups = spill(rows.groupBy("sha").agg(best, F.count(F.lit(1)).alias("group_size")).select(F.col("sha").alias("g"), F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "exact-groups")
    hot = F.col("group_size") > max(LEAST, n // SHARE)
    told = rows.join(F.broadcast(groups.where(hot)), F.col("sha") == F.col("g"), "left")
    cold = told.where("g IS NULL").select("doc_id", "row", "sha").join(groups.where(~hot), F.col("sha") == F.col("g"))
    columns = ["doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha"]
    found = told.where("g IS NOT NULL").select(*columns).unionByName(cold.select(*columns))
    return alone.unionByName(found).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_row: int = PER_ROW, most: int = CELLS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that share the kept row's id, text
    and length are the same document and stay with it."""
    found = find(docs, id_col, text_col, per_row, most)
    gone = found.where("NOT (doc_id <=> keep_id)").select(F.col("doc_id").alias("gone"), F.unhex("text_sha256").alias("sha")).distinct()
    sha = F.unhex(F.sha2(F.translate(F.coalesce(docs[text_col].cast("string"), F.lit("")), BLANKS, ""), 256))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone"]) & (sha == gone["sha"]), "left_anti")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents: a row for each, dropped ones too. Nulls, ties, repeated
    rows, empty tables and clashing names: see find."""
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
    SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS nth,
        count(*) OVER (PARTITION BY text_sha256) AS group_size, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id
    FROM d
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM g
"""
