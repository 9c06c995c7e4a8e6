"""Exact top-k by inner product with a pivot table.

Vectors become integers, floor(scale * x). For each candidate x and each of a set of pivots p the
Euclidean distance d(x, p) is computed once. By the triangle inequality |d(q, p) - d(x, p)| is at
most d(q, x), so the largest of these differences bounds d(q, x) from below, and

    <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2

from above. Within a block of candidates a query evaluates them in the order of that bound and
stops, exactly, at the first whose bound is under the k-th best score found so far.

Pivots, and the rows that give each query its first k-th best, are fitted on a bounded sample
(`pivots`, `sample` rows); both are real candidates, so every answer stays exact. All rows are
shuffled once into ranges of the pivots near them and packed into blocks, which are written with
the least and the largest distance of their rows to each pivot. The stated query set meets all
candidates block by block: first the summaries alone (a few hundred bytes a block), where a pair
whose bound lies under what k candidates of each of its queries are known to reach is dropped; then
the pairs that are left fetch the vectors. A task holds one block of either and the best k of the
queries of up to 64 blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, spill, table

EXACT = float(1 << 53)
#: What is broadcast holds at most so many bytes; beyond, joins shuffle.
BROADCAST = 32 << 20


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, a NaN or an infinity."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(True))


def _matrix(column, scale: float) -> np.ndarray:
    """Integers (as float64) of a list column; shorter vectors end in zeros."""
    flat = np.floor(np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)) * scale)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = int(sizes.max(initial=0))
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b; OverflowError beyond 63 bits."""
    width = max(a.shape[1], b.shape[1])
    a, b = _wide(a, width), _wide(b, width)
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most >= float(1 << 62) or max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) >= EXACT:
        raise OverflowError("inner products beyond 63 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], b.shape[1])
    a, b = _wide(a, width), _wide(b, width)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def choose(rows: np.ndarray, pivots: int) -> np.ndarray:
    """Indices of rows far from one another: each next one is the farthest from those so far."""
    if not len(rows):
        return np.empty(0, np.int64)
    out, near = [0], distances(rows, rows[:1])[:, 0]
    while len(out) < min(pivots, len(rows)) and near.max() > 0:
        out.append(int(near.argmax()))
        near = np.minimum(near, distances(rows, rows[out[-1:]])[:, 0])
    return np.array(out)


def known_floor(q: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among some real candidates; -inf if there are fewer."""
    out = np.full(len(q), -np.inf)
    if len(ids) > k:  # the query itself may be one of them
        known = np.where(q_ids[:, None] == ids[None, :], np.iinfo(np.int64).min, dots(q, rows))
        out = np.partition(known, known.shape[1] - k, axis=1)[:, known.shape[1] - k].astype(np.float64)
    return out


def places(far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key by which near rows sort together (the nearest of the first two pivots, then of the first
    four, and so on: the first of pivots far from one another are the coarsest cover) and the
    distance to the nearest pivot of all. Keys hold up to 512 pivots."""
    key, n, bits = np.zeros(len(far), np.int64), 2, 1
    while n < 2 * far.shape[1] and bits < 10:
        key = (key << bits) | far[:, :n].argmin(1)
        n, bits = 2 * n, bits + 1
    return key, far.min(1) if far.shape[1] else np.zeros(len(far))


def _together(df: DataFrame, scale: float, pivots: np.ndarray, parts: int | None) -> DataFrame:
    """Rows (id, v) of the whole table in ranges of their place: a range holds near rows, whatever
    their order in the table, and many rows of one place are cut by distance and id."""

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column(1), scale)
            key, near = places(distances(m, pivots) if len(pivots) else np.zeros((len(m), 0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key), pa.array(near)], ["id", "v", "place", "near"])

    placed = df.select("id", "v").mapInArrow(run, f"id long, v {df.schema['v'].dataType.simpleString()}, place long, near double")
    by = ("place", "near", "id")
    placed = placed.repartitionByRange(*by) if parts is None else placed.repartitionByRange(parts, *by)
    return placed.sortWithinPartitions(*by).select("id", "v")


_SENT = ["ids", "width", "vectors", "far"]
_HEAD = ["lo", "hi", "norm", "least"]
_PACKED = [*_SENT, "floor", *_HEAD]


def _pack(df: DataFrame, rows: int, scale: float, pivots: np.ndarray, floors: tuple | None = None) -> DataFrame:
    """Blocks of up to `rows` vectors in the order of df: ids, width, integers, distances to the
    pivots; the block's least and largest ones (lo, hi), its largest norm and, with floors (vectors,
    ids, k), what each query is known to reach and the least of that."""

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column(1), scale)
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            far = distances(m, pivots) if len(pivots) else np.zeros((len(m), 0))
            for lo in range(0, len(m), rows):
                at = slice(lo, lo + rows)
                x, f = m[at], far[at]
                floor = known_floor(x, ids[at], *floors) if floors is not None else np.full(len(x), -np.inf)
                raw = [ids[at].tobytes(), x.shape[1], x.tobytes(), f.tobytes(), floor.tobytes(), f.min(0).tolist(), f.max(0).tolist(), float((x * x).sum(1).max(initial=0)), float(floor.min())]
                kinds = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(raw, kinds)], _PACKED)

    return df.mapInArrow(run, "ids binary, width int, vectors binary, far binary, floor binary, lo array<double>, hi array<double>, norm double, least double")


def _blocks(df: DataFrame, rows: int, scale: float, pivots: np.ndarray, floors: tuple | None, parts: int | None, what: str) -> tuple[DataFrame, int]:
    """Numbered blocks of near rows, written once, and how many there are."""
    packed = _pack(_together(df, scale, pivots, parts), rows, scale, pivots, floors)
    written = spill(packed.withColumn("block", F.monotonically_increasing_id()), what)
    return written, written.count()


def near_pairs(left: DataFrame, right: DataFrame, small: bool) -> DataFrame:
    """(block, c_block) of blocks that may reach one another, by their summaries alone: no vectors
    are read. small: whether left's summaries are known to fit a broadcast."""
    heads = left.select("block", *_HEAD)
    others = right.select(F.col("block").alias("c_block"), *(F.col(c).alias(f"c_{c}") for c in _HEAD))
    return others.crossJoin(F.broadcast(heads) if small else heads).where(may_reach()).select("block", "c_block")


def may_reach() -> Column:
    """Whether any query of a block can reach its floor with any candidate of another (c_...): the
    triangle inequality between the ranges of their distances to each pivot. Rounding is allowed for."""
    gaps = F.zip_with(F.zip_with("lo", "c_hi", lambda a, b: a - b), F.zip_with("c_lo", "hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    apart = F.coalesce(F.array_max(gaps), F.lit(0.0))
    upper = (F.col("norm") + F.col("c_norm") - apart * apart) / 2
    return upper + F.abs(upper) * 1e-9 + (F.col("norm") + F.col("c_norm")) * 1e-9 + 1 >= F.col("least")


def _unpack(ids, width, vectors, far, pivots: int):
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors, np.float64).reshape(len(i), width), np.frombuffer(far, np.float64).reshape(len(i), pivots)


def _best(found_ids: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((found_ids, -found))[:k]
    return found_ids[order], found[order]


def search_block(q, q_far, q_ids, x, x_far, x_ids, best: list, floor: np.ndarray, k: int, step: int = 256) -> int:
    """Update best[i] = (ids, scores) of each query by one block; the number of evaluations.

    floor[i]: a score that k candidates of query i are known to reach.
    """
    norms, evaluated = (x * x).sum(1), 0
    for i in range(len(q)):
        ids, scores = best[i]
        least = max(floor[i], scores[-1] if len(scores) == k else -np.inf)
        lower = np.abs(x_far - q_far[i]).max(1) if x_far.shape[1] else np.zeros(len(x))
        upper = ((q[i] @ q[i]) + norms - lower * lower) / 2
        upper += 1e-9 * np.abs(upper) + 1e-6 * (1 + norms + q[i] @ q[i]) * 1e-6 + 0.5  # rounding of the bound itself
        open_ = np.flatnonzero((upper >= least) & (x_ids != q_ids[i]))
        open_ = open_[np.argsort(-upper[open_], kind="stable")]
        for lo in range(0, len(open_), step):
            some = open_[lo : lo + step]
            if upper[some[0]] < least:
                break
            evaluated += len(some)
            got = dots(q[i : i + 1], x[some])[0]
            good = got >= least
            ids, scores = _best(np.concatenate([ids, x_ids[some][good]]), np.concatenate([scores, got[good]]), k)
            if len(scores) == k:
                least = max(least, scores[-1])
        best[i] = (ids, scores)
    return evaluated


def top_k(df: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
          pivots: int = 32, sample: int = 1024, query_rows: int = 512, rows: int = 2048) -> DataFrame:
    """The k highest integer inner products of each query row with all rows of other ids.

    queries: a condition on id_col that marks the query rows. Returns query_id, rank (from 1),
    vec_id, score; ties go to the smaller vec_id; fewer rows where there are fewer candidates.
    Vectors that are null or hold a null, a NaN or an infinity take no part, nor do rows with a
    null id. Vectors of unequal length are compared as if the shorter ended in zeros. Repeated
    rows are candidates each; among query rows of one id the smallest vector is the query.
    """
    rowset = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    seen = rowset.orderBy(F.xxhash64("id"), "id", "v").limit(sample).toArrow()
    floor_ids = np.asarray(seen.column(0).to_numpy(), np.int64)
    floor_rows = _matrix(seen.column(1).combine_chunks(), scale) if len(floor_ids) else np.zeros((0, 0))
    chosen = floor_rows[choose(floor_rows, pivots)]
    n_pivots = len(chosen)
    asked = rowset.where(queries).groupBy("id").agg(F.min("v").alias("v"))
    small_batches(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, n_left = _blocks(asked, query_rows, scale, chosen, (floor_rows, floor_ids, k), None, "topk-queries")
    right, _ = _blocks(rowset, rows, scale, chosen, None, parts, "topk-rows")
    near = spill(near_pairs(left, right, n_left * 16 * (n_pivots + 4) <= BROADCAST), "topk-pairs", parts)
    few = near.count() * 16 <= BROADCAST
    held_bytes = left.agg(F.sum(sum(F.octet_length(c) for c in ("ids", "vectors", "far", "floor")))).first()[0] or 0

    def run(batches):
        held: dict[bytes, list] = {}

        def emit():
            ids = [(q, *found) for key, (q_ids, best) in held.items() for q, found in zip(q_ids, best)]
            n = [len(x[1]) for x in ids]
            out = [np.repeat(np.array([x[0] for x in ids], np.int64), n), *(np.concatenate([np.empty(0, np.int64), *(x[j] for x in ids)]).astype(np.int64) for j in (1, 2))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

        for batch in batches:
            for j in range(batch.num_rows):
                value = [batch.column(c)[j].as_py() for c in range(9)]
                q_ids, q, q_far = _unpack(*value[:4], n_pivots)
                x_ids, x, x_far = _unpack(*value[5:], n_pivots)
                floor = np.frombuffer(value[4], np.float64)
                width = max(q.shape[1], x.shape[1])
                q, x = _wide(q, width), _wide(x, width)
                if value[0] not in held:
                    if len(held) >= 64:
                        yield emit()
                    held[value[0]] = (q_ids, [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q_ids])
                search_block(q, q_far, q_ids, x, x_far, x_ids, held[value[0]][1], floor, k)
        if held:
            yield emit()

    asked_blocks = left.select("block", *(F.col(c) for c in _SENT), "floor")
    rows_blocks = right.select(F.col("block").alias("c_block"), *(F.col(c).alias(f"c_{c}") for c in _SENT))
    met = rows_blocks.join(F.broadcast(near) if few else near, "c_block")
    met = met.join(F.broadcast(asked_blocks) if held_bytes <= BROADCAST else asked_blocks, "block")
    found = met.select(*_SENT, "floor", *(f"c_{c}" for c in _SENT)).mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector; nulls and repeated rows as in top_k."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id
    WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
