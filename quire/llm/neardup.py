"""Near-duplicates by HyperMinHash.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. One pass bins them by
their top 7 bits and keeps, of the smallest hash in each bin, the number of leading zeros (6 bits)
and the 10 bits after the leading one: a register of 16 bits. Empty bins borrow from the first
full bin of an order of their own. Four registers are a band; documents that share one of the 32
bands are candidates (at the threshold 0.75, all bands differ for 5 pairs in a million).

Documents of equal sets are one class, and only its smallest id goes on. Of a band shared by few
classes all pairs are candidates. Classes that share crowded bands form a cluster: each is first
compared with the smallest class of its band, which joins most of a group of copies in linear
work; what stays apart in a cluster is then compared in blocks of like size, where a task holds two
blocks of sets, counts all intersections at once and returns the links that join anything new. Pairs never
become rows there. Candidate pairs pass an estimate of their similarity from the registers,
corrected for chance collisions, with a margin of six standard deviations, then the exact test
on the full sets of the whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, few_files, small_batches, spill, table
from .components import components

WORDS = 5
BINS, BANDS, MANTISSA = 128, 32, 10
#: Classes in a band up to which all pairs are candidates as rows.
FEW = 12
#: Bytes of text whose sets a task makes at once.
SLICE = 1 << 20
#: Documents whose rows of small tables one task writes.
EACH = 10_000
#: Sets in a block of a cluster.
BLOCK = 128
#: Ids up to which a table of ids is broadcast (8 MB).
SMALL = 1_000_000
MARGIN = 0.25
U = np.uint64
_rng = np.random.default_rng(20240607)
_ORDER = np.array([_rng.permutation(BINS) for _ in range(BINS)])


def sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending. A-Z count as a-z; a text with fewer than
    five words has its whole sequence as one shingle, one without words has none."""
    known: dict[bytes, int] = {}
    rows = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        rows.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), U, len(known))
    out = []
    for row in rows:
        h, n = hashes[row], min(WORDS, max(1, len(row)))
        if not len(row):
            out.append(h)
            continue
        s = np.full(len(h) - n + 1, U(n))
        for k in range(n):
            s = (s ^ (s >> U(31))) * U(0x9E3779B97F4A7C15) + h[k : k + len(s)]
            s = (s ^ (s >> U(29))) * U(0xBF58476D1CE4E5B9)
        out.append(np.unique(s ^ (s >> U(32))))
    return out


def registers(found: list[np.ndarray]) -> np.ndarray:
    """Register values (0 to 65535) of sets that are not empty, by set and bin."""
    sizes = np.array([len(s) for s in found])
    h = np.concatenate(found)
    place = np.repeat(np.arange(len(found)), sizes) * BINS + (h >> U(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    fraction, exponent = np.frexp(((h[first] & U((1 << 57) - 1)) >> U(4)).astype(np.float64))
    value = ((53 - exponent) << MANTISSA) | np.where(fraction > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    raw = np.full(len(found) * BINS, -1, np.int64)
    raw[place[first]] = value
    raw = raw.reshape(-1, BINS)
    out = raw.copy()
    rows = np.flatnonzero((raw < 0).any(1))
    for t in range(BINS):
        if not len(rows):
            break
        out[rows] = np.where(out[rows] < 0, raw[rows][:, _ORDER[:, t]], out[rows])
        rows = rows[(out[rows] < 0).any(1)]
    return out


def _sketches(batches, kind):
    for batch in batches:
        for lo, hi in by_bytes(batch.column(1), SLICE):
            part = batch.slice(lo, hi - lo)
            found = sets([t.as_py() for t in part.column(1)])
            full = [s for s in found if len(s)]
            packed = iter(())
            if full:
                r = registers(full).reshape(len(full), BANDS, BINS // BANDS).astype(U)
                packed = iter((r << (U(16) * np.arange(BINS // BANDS, dtype=U))).sum(2, dtype=U).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([len(s) for s in found], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
                    pa.array([next(packed) if len(s) else None for s in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "same", "bands"],
            )


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (set size), same (128-bit hash of the set; null if empty), bands (32 longs of four registers)."""
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return d.mapInArrow(lambda it: _sketches(it, kind), f"doc_id {kind}, n long, same binary, bands array<bigint>")


def estimate(a, b, n_a, n_b):
    """Similarity from two lists of bands: agreeing registers, less those expected to agree by chance."""
    lanes = BINS // BANDS
    equal = lambda z: sum((((F.shiftrightunsigned(z, 16 * k)).bitwiseAND(F.lit(65535))) == 0).cast("int") for k in range(lanes))
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: equal(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # Two unequal smallest hashes share their leading zeros with chance about 1/3 and then the mantissa.
    ratio = 4 * n_a.cast("double") * n_b / ((n_a + n_b).cast("double") * (n_a + n_b))
    chance = ratio / 3 / (1 << MANTISSA)
    return (agree / F.lit(float(BINS)) - chance) / (1 - chance)


def _texts(docs: DataFrame, ids: DataFrame, files: int) -> DataFrame:
    """(doc_id, text) of the ids (column id): a broadcast of the ids if they are few, else a join."""
    ids = spill(ids.select("id").distinct(), "nd-ids", files)
    few = ids.count() <= SMALL
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")


def verify(pairs: DataFrame, docs: DataFrame, percent: int, files: int) -> DataFrame:
    """Of pairs (a, b) those with percent * union <= 100 * intersection, on the full sets."""
    texts = _texts(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), files)
    kind = docs.schema["doc_id"].dataType.simpleString()
    left, right = (texts.select(F.col("doc_id").alias(f"i_{x}"), F.col("text").alias(f"t_{x}")) for x in "ab")
    both = pairs.join(right, F.col("b") == F.col("i_b")).join(left, F.col("a") == F.col("i_a")).select("a", "b", "t_a", "t_b")

    def run(batches):
        for batch in batches:
            keep = []
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = sets([t.as_py() for t in part.column(2)] + [t.as_py() for t in part.column(3)])
                for x, y in zip(found[: part.num_rows], found[part.num_rows :]):
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def block_links(ids: list, found: list[np.ndarray], group: list, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple]:
    """Links between the sets at `left` and those at `right` that join different groups, or
    anything not yet joined by an earlier link."""
    sizes = np.array([len(s) for s in found])
    values, place = np.unique(np.concatenate(found), return_inverse=True)
    of = np.repeat(np.arange(len(found)), sizes)
    order = np.argsort(place, kind="stable")
    place, of = place[order], of[order]
    common = np.zeros((len(found), len(found)), np.float32)
    step = max(1, (8 << 20) // (4 * max(1, len(found))))
    for lo in range(0, len(values), step):
        a, b = np.searchsorted(place, [lo, lo + step])
        has = np.zeros((len(found), min(step, len(values) - lo)), np.float32)
        has[of[a:b], place[a:b] - lo] = 1
        common += has @ has.T
    link = (common > 0) & (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common))
    root = list(range(len(found)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first: dict = {}
    for k, g in enumerate(group):
        root[top(k)] = top(first.setdefault(g, k))
    out = []
    for x in left.tolist():
        for y in right[link[x, right]].tolist():
            if (u := top(x)) != (v := top(y)):
                root[u] = v
                out.append((ids[x], ids[y]))
    return out


def _blocks(members: DataFrame, docs: DataFrame, percent: int, files: int) -> DataFrame:
    """Links within clusters (cluster, id, component, n): members in blocks of like size (within a
    power of 100 / percent) and component, and all pairs of blocks whose sizes allow a link, but
    those of one single component."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql import Window

    # Blocks: per component, members are dealt by hash; small components share blocks.
    size = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("m"))
    size = size.select(F.col("cluster").alias("c1"), F.col("component").alias("c2"), "m")
    m = members.join(size, (F.col("cluster") == F.col("c1")) & (F.col("component") == F.col("c2"))).drop("c1", "c2")
    whole = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("all"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    m = m.join(whole.select(F.col("cluster").alias("c1"), "all"), F.col("cluster") == F.col("c1")).drop("c1")
    pure = F.col("m") >= 2 * BLOCK
    slot = F.when(pure, F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK))).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("all") / BLOCK)))
    like = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int")
    m = m.withColumn("size", like).withColumn("block", F.concat_ws(":", F.col("size").cast("string"), F.when(pure, F.col("component").cast("string")).otherwise(F.lit("x")), slot.cast("string"))).withColumn("pure", F.when(pure, F.col("component")))
    m = spill(m.select("cluster", "id", "component", "block", "pure", "size"), "nd-members", files)
    blocks = m.groupBy("cluster", "block").agg(F.first("pure").alias("pure"), F.first("size").alias("size"))
    x, y = (blocks.select(F.col("cluster").alias(f"{k}c"), F.col("block").alias(f"{k}b"), F.col("pure").alias(f"{k}p"), F.col("size").alias(f"{k}s")) for k in "xy")
    tasks = x.join(y, (F.col("xc") == F.col("yc")) & (F.col("xb") <= F.col("yb")) & (F.abs(F.col("xs") - F.col("ys")) <= 1) & ~F.coalesce(F.col("xp") == F.col("yp"), F.lit(False)))
    tasks = tasks.select(F.col("xc").alias("tc"), F.concat_ws("/", "xb", "yb").alias("task"), F.explode(F.array_distinct(F.array("xb", "yb"))).alias("tb"), (F.col("xb")).alias("lb"))
    texts = _texts(docs, m.select("id"), files).select(F.col("doc_id").alias("i"), "text")
    rows = m.join(texts, F.col("id") == F.col("i")).drop("i")
    rows = rows.join(tasks, (F.col("cluster") == F.col("tc")) & (F.col("block") == F.col("tb")))
    rows = rows.select("cluster", "task", "id", "component", "block", "lb", "text")

    def run(t: pa.Table) -> pa.Table:
        ids, group = t.column("id").to_pylist(), t.column("component").to_pylist()
        inside = np.array([b == l for b, l in zip(t.column("block").to_pylist(), t.column("lb").to_pylist())])
        left, right = np.flatnonzero(inside), np.flatnonzero(~inside)
        links = block_links(ids, sets(t.column("text").to_pylist()), group, left, right if len(right) else left, percent)
        kind_ = t.schema.field("id").type
        return pa.Table.from_arrays([pa.array([p[k] for p in links], kind_) for k in (0, 1)], ["a", "b"])

    return rows.groupBy("cluster", "task").applyInArrow(run, f"a {kind}, b {kind}")


def link(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Linked are documents with 100 * intersection >= percent * union of their sets, percent at
    least 75 (what the bands are made for); component_id is the smallest id reachable. Texts
    without words (nulls too) are linked with nothing. Rows of one id are one document, linked
    with what any of them is linked with. A null id is linked with nothing: component_id is null
    and the row is kept. Nothing comes from an empty table. A pair at exactly 0.75 shares no band
    with a chance of 5 in a million, and ever less above.
    """
    if percent < 75:
        raise ValueError("the bands find pairs from 0.75 on")
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    sketch = spill(sketches(d), "nd-sketches")
    files = few_files(sketch.count(), EACH)
    whole = sketch.where("doc_id IS NOT NULL AND same IS NOT NULL")
    # min of the structs: the smallest id, whose bands are those of any row of its class.
    classes = whole.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("bands").alias("bands"))
    classes = spill(classes, "nd-classes", files)
    reps = classes.select("rep", "n", "bands")
    rows = reps.select("rep", F.posexplode("bands").alias("band", "value"))
    keys = rows.groupBy("band", "value").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("m")).where("first <> last")
    keys = keys.select(F.col("band").alias("kb"), F.col("value").alias("kv"), "first", "m")
    shared = spill(rows.join(keys, (F.col("band") == F.col("kb")) & (F.col("value") == F.col("kv"))).select("band", "value", "rep", "first", "m"), "nd-shared", files)
    few = shared.where(F.col("m") <= FEW)
    other = few.select(F.col("band").alias("ob"), F.col("value").alias("ov"), F.col("rep").alias("b"))
    near = few.join(other, (F.col("band") == F.col("ob")) & (F.col("value") == F.col("ov")) & (F.col("rep") < F.col("b"))).select(F.col("rep").alias("a"), "b")
    star = spill(shared.where((F.col("m") > FEW) & (F.col("first") != F.col("rep"))).select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "nd-stars", files)
    pairs = near.unionByName(star).distinct()
    side = lambda x: reps.select(F.col("rep").alias(f"r_{x}"), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"s_{x}"))
    pairs = pairs.join(side("a"), F.col("a") == F.col("r_a")).join(side("b"), F.col("b") == F.col("r_b"))
    likely = (estimate(F.col("s_a"), F.col("s_b"), F.col("n_a"), F.col("n_b")) >= percent / 100 - MARGIN) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    pairs = spill(pairs.where(likely).select("a", "b").distinct(), "nd-pairs", files)
    links = spill(verify(pairs, d, percent, files), "nd-links")
    found = components(links)
    if not star.isEmpty():
        # A class joins the smallest of its bands' first classes, and that joins the others: as
        # many edges as classes, not one for each band, and the same clusters.
        firsts = star.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("all"))  # at most one for each band
        among = firsts.select("a", F.explode("all").alias("b")).where("a <> b").distinct()
        clusters = components(firsts.select("a", "b").unionByName(among)).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
        members = clusters.join(found, F.col("id") == F.col("node"), "left").select("cluster", "id", F.coalesce("component", "id").alias("component"))
        members = members.join(reps.select(F.col("rep").alias("r"), "n"), F.col("id") == F.col("r")).drop("r")
        more = spill(_blocks(spill(members, "nd-clusters", files), d, percent, files), "nd-more", files)
        if not more.isEmpty():
            found = components(links.unionByName(more))
    same = classes.where("copies > 1").select(F.col("same").alias("s"), F.col("rep"))
    out = sketch.select("doc_id", "n", "same").join(same, F.col("same") == F.col("s"), "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    # An id with several texts: its classes and its links meet at the id.
    by_id = out.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component"))
    by_id = by_id.withColumn("component", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id")))
    return by_id.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among all documents; nulls and repeated rows as in link."""
    return link(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y
), m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
