"""Mixing sources to target weights: hierarchical budgets over a tree domain - language - source.

A budget of tokens enters at the root. Each node deals its budget to its children by their
weights; a child that cannot use its share (its leaves hold too few tokens, over all the epochs
allowed) leaves the rest to its siblings, again by weight. Only what a whole family cannot use
shows one level up, as a smaller capacity there. So shortages go to siblings before ancestors.
A node of weight 0 gets nothing, and what hangs below it is no capacity of the nodes above.
Shares are whole tokens: what rounding down leaves goes to the largest fractions of the family.

A leaf's budget is taken from its seeded epochs: whole epochs first, then a prefix of the next
epoch's order (by a hash of seed, epoch, id and text), the last document cut to the tokens left.

All is DataFrame and window operations. The order within a leaf is never sorted in one task: a
document's hash also names one of many equal ranges of it; sums of whole ranges decide all but one
range of a leaf, and only within ranges are documents put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, spill, table

LEVELS = ("domain", "lang", "source")
#: Hex digits of the hash that name a range of a leaf's order.
RANGE_DIGITS = 3


def tokens(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source: Column, domains: int = 3) -> Column:
    """The domain of a source named by a number at its end: that number modulo domains."""
    number = F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), r"(\d{1,9})$", 1)
    return F.concat(F.lit("domain"), F.when(number == "", F.lit("?")).otherwise((number.cast("long") % domains).cast("string")))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    """The weight of a node by its name; 1 unless given."""
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == F.lit(name), F.lit(float(w))).otherwise(out)
    return out


def deal(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Deal each family's budget to its children (columns parent..., name, weight, capacity, budget).

    By rising capacity for their weight children are full as long as their capacity is no more
    than their share of what the fuller ones left; the others share the rest by weight. Families
    are as wide as a node has children; a child of weight 0 or less gets nothing (no row). Adds
    `share` (long): the shares of a family make its budget, or its capacity if that is less.
    """
    last = [c for c in nodes.columns if c not in (*parent, "weight", "capacity", "budget")]
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("capacity") / F.col("weight"), *last)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    passed = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    some = nodes.where(F.col("weight") > 0)
    some = some.withColumn("left", F.col("budget") - used).withColumn("wide", F.sum("weight").over(by) - passed)
    full = some.withColumn("full", F.col("capacity") * F.col("wide") <= F.col("left") * F.col("weight"))
    taken = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(F.lit(0))).over(by)
    heavy = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("weight"))).over(by)
    exact = F.when(F.col("full"), F.col("capacity").cast("double")).otherwise((F.col("budget") - taken) * F.col("weight") / heavy)
    cut = full.withColumn("exact", exact).withColumn("base", F.floor("exact").cast("long"))
    over = F.least(F.col("budget"), F.sum("capacity").over(by)) - F.sum("base").over(by)
    turn = F.row_number().over(by.orderBy(F.desc(F.col("exact") - F.col("base")), *last))
    cut = cut.withColumn("over", over).withColumn("turn", turn)
    return cut.withColumn("share", F.col("base") + (F.col("turn") <= F.col("over")).cast("long")).drop("left", "wide", "full", "exact", "base", "over", "turn")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, float]], epochs: int) -> DataFrame:
    """Tokens for each leaf (domain, lang, source, supply) that has a weight, as whole numbers.

    total: of the sum of all supplies, the root's budget. The tree is small: as many rows as there
    are sources by language.
    """
    # Names may be null: families are told apart by them as by any other value.
    root = leaves.agg(F.sum("supply").alias("sum_supply"))
    root = root.select(total.cast("long").alias("budget"))
    tree = leaves.withColumn("capacity", F.col("supply") * F.lit(epochs))
    for level in LEVELS:  # what nobody may use is no capacity
        tree = tree.where(_weight(level, weights) > 0)
    given, path = None, []
    for level in LEVELS:
        here = tree.groupBy(*path, level).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        if given is None:
            here = here.crossJoin(root)  # one row
        else:
            g = given.select(*(F.col(c).alias(f"g_{c}") for c in path), F.col("share").alias("budget"))
            same = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in path]
            on = same[0]
            for s in same[1:]:
                on = on & s
            here = here.join(g, on).drop(*(f"g_{c}" for c in path))
        given = deal(here, list(path))
        path = [*path, level]
    return given.select(*LEVELS, F.col("share").alias("budget"))


def order_key(seed: int, epoch: Column, doc_id: Column, text_hash: Column) -> Column:
    """Where a row stands in an epoch. The text's hash sets rows of one id (or of none) apart."""
    return F.md5(F.encode(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), text_hash), "UTF-8"))


def mix(docs: DataFrame, weights: dict[str, dict[str, float]], share: float = 0.8, epochs: int = 4, seed: int = 17, domain: Column | None = None) -> DataFrame:
    """Select from docs (doc_id, text, lang, source) a mixture of share times its tokens.

    Returns doc_id, domain, lang, source, epoch (from 0), tokens (words of the text), taken (of
    these, from its start). Rows appear once for each epoch in which they are taken. Texts that
    are null or without words hold no tokens and are never taken. Null languages and sources form
    leaves of their own. Repeated rows count each and stand side by side; rows of one id (or of
    none) with different texts stand apart. Nothing comes from empty tables.
    """
    narrow = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), (domain_of(F.col("source")) if domain is None else domain).alias("domain"), tokens(F.col("text")).alias("tokens"), F.md5(F.encode(F.col("text").cast("string"), "UTF-8")).alias("salt"))
    narrow = spill(narrow.where(F.col("tokens") > 0), "mix-tokens")  # words are counted once
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"))
    plan = budgets(leaves, F.floor(F.col("sum_supply") * F.lit(share)), weights, epochs)
    g = leaves.select(*(F.col(c).alias(f"p_{c}") for c in LEVELS), "supply").alias("s")
    b = plan.select(*(F.col(c).alias(f"b_{c}") for c in LEVELS), "budget")
    same = lambda x, y: F.col(f"{x}domain").eqNullSafe(F.col(f"{y}domain")) & F.col(f"{x}lang").eqNullSafe(F.col(f"{y}lang")) & F.col(f"{x}source").eqNullSafe(F.col(f"{y}source"))
    leaf = g.join(b, same("p_", "b_")).select(*(F.col(f"p_{c}").alias(f"l_{c}") for c in LEVELS), F.floor(F.col("budget") / F.col("supply")).cast("int").alias("whole"), (F.col("budget") % F.col("supply")).alias("rest"))
    placed = narrow.join(leaf, same("", "l_")).drop(*(f"l_{c}" for c in LEVELS))
    placed = placed.withColumn("key", order_key(seed, F.col("whole"), F.col("doc_id"), F.col("salt"))).withColumn("range", F.substring("key", 1, RANGE_DIGITS)).drop("salt")
    ranges = placed.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("held"))
    ahead = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0))).drop("held")
    r = ranges.select(*(F.col(c).alias(f"r_{c}") for c in LEVELS), F.col("range").alias("r_range"), "ahead")
    joined = placed.join(r, same("", "r_") & (F.col("range") == F.col("r_range"))).drop(*(f"r_{c}" for c in LEVELS), "r_range")
    # Whole ranges are in or out; those where the rest ends are put in order.
    within = Window.partitionBy(*LEVELS, "range").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    joined = joined.withColumn("taken_last", F.least(F.col("tokens"), F.greatest(F.col("rest") - start, F.lit(0))).cast("long"))
    each = F.sequence(F.lit(0), F.col("whole"))
    out = joined.select("doc_id", *LEVELS, "tokens", "whole", "taken_last", F.explode(each).alias("epoch"))
    out = out.withColumn("taken", F.when(F.col("epoch") < F.col("whole"), F.col("tokens")).otherwise(F.col("taken_last")))
    return out.where(F.col("taken") > 0).select("doc_id", *LEVELS, "epoch", "tokens", "taken")


#: Production weights; what is not named has weight 1.
WEIGHTS = {"domain": {"domain0": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0}, "source": {"src0": 0.5, "src1": 3.0}}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens of documents, mixed by WEIGHTS; nulls and repeats as in mix."""
    return mix(table(spark, sf_dir, "documents"), WEIGHTS)


def _sql() -> str:
    weight = lambda level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN CAST({v} AS DOUBLE)" for k, v in WEIGHTS[level].items()) + " ELSE CAST(1 AS DOUBLE) END"

    def family(name: str, level: str, path: list[str], source: str) -> str:
        keys, part = ", ".join([*path, level]), f"PARTITION BY {', '.join(path)}" if path else ""
        budget = f"(SELECT budget FROM root)" if not path else "g.budget"
        join = "" if not path else f"JOIN (SELECT {', '.join(path)}, share AS budget FROM {source}) g USING ({', '.join(path)})"
        return f"""
{name}_n AS (SELECT {keys}, capacity, weight, {budget} AS budget
    FROM (SELECT {keys}, CAST(sum(capacity) AS BIGINT) AS capacity, {weight(level)} AS weight FROM tree GROUP BY {keys}) x {join} WHERE weight > 0),
{name}_o AS (SELECT *, budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
        sum(weight) OVER ({part}) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wide
    FROM {name}_n WINDOW w AS ({part} ORDER BY capacity / weight, {level})),
{name}_f AS (SELECT *, capacity * wide <= lft * weight AS is_full FROM {name}_o),
{name}_x AS (SELECT *, CASE WHEN is_full THEN CAST(capacity AS DOUBLE)
        ELSE (budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({part})) * weight
             / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}) END AS exact FROM {name}_f),
{name}_b AS (SELECT *, CAST(floor(exact) AS BIGINT) AS base FROM {name}_x),
{name} AS (SELECT {keys}, base + CAST(row_number() OVER ({part} ORDER BY exact - base DESC, {level})
        <= least(budget, sum(capacity) OVER ({part})) - sum(base) OVER ({part}) AS BIGINT) AS share FROM {name}_b)"""

    return f"""
WITH d AS (SELECT doc_id, lang, source,
        'domain' || CASE WHEN regexp_extract(source, '(\\d+)$', 1) = '' THEN '?' ELSE CAST(CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) % 3 AS VARCHAR) END AS domain,
        len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens, md5(text) AS salt
    FROM documents WHERE text IS NOT NULL),
n AS (SELECT * FROM d WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply FROM n GROUP BY ALL),
tree AS (SELECT *, supply * 4 AS capacity FROM leaves WHERE {" AND ".join(f"({weight(level)}) > 0" for level in LEVELS)}),
root AS (SELECT CAST(floor(sum(supply) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS budget FROM leaves),
{family("l1", "domain", [], "")},{family("l2", "lang", ["domain"], "l1")},{family("l3", "source", ["domain", "lang"], "l2")},
plan AS (SELECT domain, lang, source, share // supply AS whole, share % supply AS rest FROM l3 JOIN leaves USING (domain, lang, source)),
p AS (SELECT n.*, whole, rest, md5('17|' || whole || '|' || doc_id || '|' || salt) AS key FROM n JOIN plan USING (domain, lang, source)),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
e AS (SELECT doc_id, domain, lang, source, CAST(unnest(range(0, whole + 1)) AS INTEGER) AS epoch, tokens, whole, least(tokens, greatest(rest - start, 0)) AS last FROM o)
SELECT doc_id, domain, lang, source, epoch, CAST(tokens AS BIGINT) AS tokens, CAST(CASE WHEN epoch < whole THEN tokens ELSE last END AS BIGINT) AS taken
FROM e WHERE CASE WHEN epoch < whole THEN tokens ELSE last END > 0
"""


SQL = _sql()
