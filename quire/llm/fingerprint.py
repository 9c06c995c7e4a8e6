"""Document fingerprints: one-permutation MinHash, natively in Spark expressions.

Each 5-word shingle is hashed once; its top bits name one of BINS bins, and each bin keeps its
smallest hash. An empty bin borrows from a bin of a pseudo-random order that depends on the empty
bin alone, the first one in it that is not empty (optimal densification): two sets then agree in
any bin with the chance of their Jaccard similarity. The lowest BITS bits of each bin are packed
to a hex string; as unequal bins agree in them with chance 2**-BITS, estimates are corrected by
that.

All of a document's work happens in its row, by array expressions; nothing is exploded or grouped.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import table, total_bytes

BINS, BITS, WORDS = 256, 8, 5
LOW = (1 << 56) - 1
PROBES = 12
_SPACE = " \t\n\x0b\x0c\r"
#: Probe t of bin i looks at bin (a*i + b) mod 257 mod 256.
_rng = random.Random(20240601)
_PROBE = [(_rng.randrange(1, 257), _rng.randrange(257)) for _ in range(PROBES)]
#: Text for each task of the pass that brings neighbours together.
BUCKET_BYTES = 4 << 20
#: Quantiles of the ids between which ranges are dealt.
CELLS = 256
#: Ranges whose order one window holds.
GROUP = 4096


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: the densified bins of a text, as one integer 256 * bin + low bits for each;
    empty for a text without words (null counts as empty).

    Texts of fewer than five words have their whole sequence as one shingle. Case counts. A row's
    bins depend on its text alone: repeated rows, null ids and other columns stay as they are, but
    columns named __w, __s, __e, __p or __k are taken.
    """
    # Each step is a column of its own: what a lambda reads again must not be worked out again.
    words = F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE)), r"[\x20\x09-\x0D]+")
    df = df.withColumn("__w", words)
    w = F.col("__w")
    n = F.size(w) - (WORDS - 1)
    # Rows of five neighbours are laid out by native steps; one call hashes each of them.
    many = F.transform(F.arrays_zip(*(F.slice(w, k + 1, n).alias(f"w{k}") for k in range(WORDS))), lambda x: F.xxhash64(x))
    # Splitting an empty text gives one empty word.
    shingles = F.when(n > 0, many).when((F.size(w) == 1) & (w[0] == ""), F.expr("CAST(array() AS array<bigint>)")).otherwise(F.array(F.xxhash64(w)))
    # One mark for each bin, above all its hashes: the first of a bin is its smallest hash, or the mark.
    marks = F.array(*(F.lit((b << 56) | LOW) for b in range(-BINS // 2, BINS // 2)))
    df = df.withColumn("__s", F.sort_array(F.concat(shingles, marks)))
    s = F.col("__s")
    top = lambda x: F.shiftright(x, 56)
    firsts = F.filter(s, lambda x, i: (i == 0) | (top(x) != top(s[i - 1])))
    df = df.withColumn("__e", F.transform(firsts, lambda x: F.nullif(x.bitwiseAND(F.lit(LOW)), F.lit(LOW))))
    e = F.col("__e")
    probe = lambda i, a, b: e[((i * a + b) % 257 % BINS)]
    df = df.withColumn("__p", F.transform(e, lambda x, i: F.coalesce(x, *(probe(i, a, b) for a, b in _PROBE))))
    # What is still empty (texts with few shingles) takes the full bin that its own order puts first.
    open_ = F.exists("__p", lambda x: x.isNull())
    kept = F.filter(F.transform(e, lambda x, i: F.struct(i.alias("b"), x.alias("x"))), lambda y: y["x"].isNotNull())
    df = df.withColumn("__k", F.when(open_, kept))
    least = lambda i: F.array_min(F.transform(F.col("__k"), lambda y: F.struct(F.xxhash64(i, y["b"]).alias("o"), y["x"].alias("x"))))["x"]
    value = lambda x, i: i * 256 + x.bitwiseAND(F.lit(255)).cast("int")
    full = F.when(F.col("__k").isNull(), F.transform("__p", lambda x, i: value(x, i))).when(F.size("__k") > 0, F.transform("__p", lambda x, i: value(F.coalesce(x, least(i)), i)))
    return df.withColumn(out, F.coalesce(full, F.expr("CAST(array() AS array<int>)"))).drop("__w", "__s", "__e", "__p", "__k")


_DIGITS = [f"{k:02x}" for k in range(256)]


def packed(bins: Column) -> Column:
    """The low bits of all bins as BINS * BITS / 4 hex digits; an empty text without bins."""
    digits = F.array(*map(F.lit, _DIGITS))
    return F.array_join(F.transform(bins, lambda v: digits[v.bitwiseAND(F.lit(255))]), "")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: BINS * BITS / 4 hex digits; empty for a text that is null or without words."""
    return with_bins(df, text, "__bins").withColumn(out, packed(F.col("__bins"))).drop("__bins")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts by their bins, 0 to 1. Of two empty ones it is 1,
    of an empty and another 0."""
    same = F.size(F.array_intersect(a, b))  # a value names its bin, so no bin counts for another
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(estimate)


def _ranges(df: DataFrame, id_col: str, size: int, salt: Column) -> Column | None:
    """The range of a row, rising with (id, salt), nulls in the lowest ones: about BUCKET_BYTES
    each. None if there are no rows.

    Ranges lie between quantiles of the ids, divided evenly by value; an id that takes whole
    quantiles (null too) is divided by the salt, a 64-bit hash, instead.
    """
    wanted = max(1, ceil(size / BUCKET_BYTES))
    cells = min(CELLS, wanted)
    each = ceil(wanted / cells)
    found = df.agg(F.percentile_approx(id_col, [k / cells for k in range(cells + 1)], F.lit(10_000)).alias("q"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.count(F.lit(1)).alias("n"), F.count(id_col).alias("n_ids")).first()
    if not found.n:
        return None
    # A salt is dealt evenly to k parts in its own order.
    dealt = lambda k: F.least(F.floor((salt.cast("double") / 2.0**64 + 0.5) * k), F.lit(k - 1)).cast("long")
    nulls = max(1, ceil(wanted * (found.n - found.n_ids) / found.n))
    if found.q is None:
        return dealt(nulls)
    cuts = [found.lo, *found.q[1:-1], found.hi]
    times = {v: cuts.count(v) for v in cuts}
    edges, parts, heavy, start = [], [], [], [nulls]
    for v in sorted(times):  # a value that is cut twice or more holds a cell of its own
        for at, own in [(v, True), (v + 1, False)][: 1 + (v < found.hi)] if times[v] > 1 else [(v, False)]:
            if edges and edges[-1] == at:
                parts[-1], heavy[-1] = (times[v] * each, True) if own else (each, False)
            else:
                edges.append(at)
                parts.append(times[v] * each if own else each)
                heavy.append(own)
    for p in parts:
        start.append(start[-1] + p)
    x = F.col(id_col).cast("decimal(20,0)")
    wide = lambda values: F.array(*(F.lit(str(v)).cast("decimal(20,0)") for v in values))
    cell = F.greatest(F.size(F.filter(F.array(*(F.lit(v).cast("long") for v in edges)), lambda v: v <= F.col(id_col))), F.lit(1))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), cell)
    low, high = F.element_at(wide(edges), cell), F.element_at(wide([*edges[1:], found.hi + 1]), cell)
    even = F.floor((x - low).cast("double") / F.greatest((high - low).cast("double"), F.lit(1.0)) * of(parts))
    by_salt = F.floor((salt.cast("double") / 2.0**64 + 0.5) * of(parts))
    part = F.least(F.when(of(heavy), by_salt).otherwise(even), of(parts) - 1).cast("long")
    return F.when(x.isNull(), dealt(nulls)).otherwise(of(start[:-1]) + part).cast("long")


def with_next(df: DataFrame, id_col: str, text_col: str, columns: list[str], size: int, derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds what derive adds to each row, and next_<column> for each of columns: that of the next
    row by id, then a hash of the text, then the text; after the last row comes the first. Null
    ids come first. Of one row, it is the row itself; an empty table stays empty. Ids are whole
    numbers, else TypeError.

    Rows are dealt to ranges of (id, hash) of about BUCKET_BYTES each; the first rows of each range
    also stand, marked, at the end of the range before. So no task sees more than its range, and
    rows move once. Rows equal in id and text are of one range, which a window sorts and spills.
    Columns named __salt, __bucket and __mark are taken.
    """
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is {df.schema[id_col].dataType.simpleString()}; ids are whole numbers")
    salt = F.xxhash64(text_col)
    bucket = _ranges(df, id_col, size, salt)
    if bucket is None:
        return derive(df).select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    keyed = df.withColumn("__salt", salt).withColumn("__bucket", bucket)
    heads = df.select(bucket.alias("b"), F.struct(F.col(id_col).alias("id"), salt.alias("salt")).alias("first"))
    # The least struct has the least id, null before all.
    heads = heads.groupBy("b").agg(F.min("first").alias("first")).withColumn("g", F.floor(F.col("b") / GROUP))
    # The range before: within a group of ranges by one window, at its edge by the last of the
    # groups before; the one window over all holds a row for each group.
    groups = heads.groupBy("g").agg(F.max("b").alias("last"))
    every = Window.orderBy("g")
    groups = groups.select(F.col("g").alias("g2"), F.coalesce(F.lag("last").over(every), F.max("last").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("ahead"))
    heads = heads.join(groups, F.col("g") == F.col("g2")).withColumn("before", F.coalesce(F.lag("b").over(Window.partitionBy("g").orderBy("b")), F.col("ahead")))
    heads = heads.select(F.col("b").alias("__b"), F.col("first.id").alias("__id"), F.col("first.salt").alias("__first"), F.col("before").alias("__before"))
    heads = F.broadcast(heads) if size <= 100_000 * BUCKET_BYTES else heads
    same = (F.col("__bucket") == F.col("__b")) & F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__salt") == F.col("__first"))
    # Of rows equal to the first one, any serves.
    ahead = keyed.join(heads, same).withColumn("__bucket", F.col("__before")).withColumn("__mark", F.lit(1)).drop("__b", "__id", "__first", "__before")
    ahead = ahead.select(*(F.col(c) for c in [*keyed.columns, "__mark"]))
    by = Window.partitionBy("__bucket").orderBy("__mark", F.col(id_col).asc_nulls_first(), "__salt", text_col)
    # Derived above the join that finds the few rows that go ahead, so once for each row.
    out = derive(keyed.withColumn("__mark", F.lit(0)).unionByName(ahead))
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(by))
    return out.where("__mark = 0").drop("__salt", "__bucket", "__mark")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likeness. A null text
    counts as empty; null ids come before all others; rows of one id follow one another by a hash
    of their texts; the text after the last is the first. No rows of an empty table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = with_next(docs, "doc_id", "text", ["text", "bins"], total_bytes(docs), lambda d: with_bins(d, "text", "bins"))
    df = df.select("doc_id", F.length("text").cast("long").alias("n_chars"), "bins", "next_bins", edited(F.col("text"), F.col("next_text")).alias("edited"))
    df = with_bins(df, "edited", "edited_bins")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
