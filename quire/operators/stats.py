"""Statistics of evaluations: summaries, tests, allocation and sampling."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def geometric_mean(x: Column) -> Column:
    """Over what is above 0; 0 if nothing is."""
    return F.coalesce(F.exp(F.avg(F.when(x > 0, F.ln(x)))), F.lit(0.0))


def summary(x: Column) -> dict[str, Column]:
    """mean, median, std (of a sample; 0 for one value), min, max and geometric mean; 0 for none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {"mean": zero(F.avg(x)), "median": zero(F.median(x)), "std": zero(F.stddev_samp(x)), "min": zero(F.min(x)), "max": zero(F.max(x)), "geomean": geometric_mean(x)}


def holm(df: DataFrame, p: str, order: list[str], alpha: float = 0.05) -> DataFrame:
    """Step-down correction over a family of tests (few rows): adds adjusted_alpha, significant."""
    some = df.where(F.col(p).isNotNull())
    w = Window.orderBy(p, *order)
    m = F.count(F.lit(1)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = some.withColumn("adjusted_alpha", F.lit(alpha) / (m - F.row_number().over(w) + 1))
    passed = F.min((F.col(p) < F.col("adjusted_alpha")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("significant", passed == 1)


def average_ranks(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """Adds the rank of x within `by`, ties sharing their mean rank."""
    low = F.rank().over(Window.partitionBy(*by).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return df.withColumn(name, low + (ties - 1) / 2.0)


def signed_rank(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Wilcoxon's signed-rank test of paired columns within `by`: n_pairs, statistic (the smaller
    rank sum), p_value (normal approximation with correction for ties), effect_size_r and
    median_diff."""
    d = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("d", F.col(a) - F.col(b))
    every = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.median("d").alias("median_diff"))
    moved = average_ranks(d.where("d <> 0").withColumn("size", F.abs("d")), by, "size", "rank")
    sums = moved.groupBy(*by).agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("minus"), F.count(F.lit(1)).alias("n"))
    ties = moved.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    out = every.join(sums, by, "left").join(ties, by, "left")
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    stat = F.least("plus", "minus")
    z = (stat - n * (n + 1) / 4.0) / F.when(spread > 0, spread)
    return out.select(*by, "n_pairs", stat.alias("statistic"), F.coalesce(2 * normal_tail(F.abs(z)), F.lit(1.0)).alias("p_value"), F.coalesce((F.col("plus") - F.col("minus")) / (F.col("plus") + F.col("minus")), F.lit(0.0)).alias("effect_size_r"), "median_diff")


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0, to about 1e-7 (a rational approximation of the
    error function)."""
    t = 1 / (1 + z * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def rank_correlation(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Kendall's tau (b) and Spearman's rho of paired columns within `by`; null for fewer than two
    pairs or for a column without spread. Rows with a null in either column take no part.

    Discordant pairs are counted without forming pairs: rows in order of a, and for each binary digit
    of b's rank those that agree in all higher digits; a row whose digit is 0 is passed by the rows
    before it whose digit is 1. That is n log n rows for n, in place of n^2.
    """
    pairs = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    ranked = average_ranks(average_ranks(pairs, by, a, "ra"), by, b, "rb").withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    rho = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("spearman_rho"))
    digits = F.sequence(F.lit(0), F.length(F.bin(2 * F.col("rows"))) - 1)
    d = ranked.select(*by, "ra", (2 * F.col("rb")).cast("long").alias("v"), F.explode(digits).alias("k"))
    d = d.select(*by, "ra", "v", "k", F.expr("shiftright(v, k + 1)").alias("high"), F.expr("shiftright(v, k) & 1").alias("digit"))
    before = Window.partitionBy(*by, "k", "high").orderBy("ra", "v").rowsBetween(Window.unboundedPreceding, -1)
    passed = d.withColumn("ones", F.coalesce(F.sum("digit").over(before), F.lit(0))).groupBy(*by).agg(F.sum(F.when(F.col("digit") == 0, F.col("ones")).otherwise(0)).alias("apart"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = ranked.groupBy(*by, "ra", "rb").agg(F.count(F.lit(1)).alias("c"))
    ties = both.groupBy(*by).agg(two("c").alias("tied"))
    for rank, name in (("ra", "tied_a"), ("rb", "tied_b")):
        ties = ties.join(both.groupBy(*by, rank).agg(F.sum("c").alias("c")).groupBy(*by).agg(two("c").alias(name)), by)
    out = rho.join(passed, by, "left").join(ties, by, "left")
    pairs_of = F.col("n") * (F.col("n") - 1) / 2
    spread = F.sqrt((pairs_of - F.col("tied_a")) * (pairs_of - F.col("tied_b")))
    s = pairs_of - F.col("tied_a") - F.col("tied_b") + F.col("tied") - 2 * F.col("apart")
    return out.select(*by, "n", F.when(spread > 0, s / F.when(spread > 0, spread)).alias("kendall_tau"), "spearman_rho")


def allocate(sizes: DataFrame, stratum: str, size: str, target: int, least: int) -> DataFrame:
    """Samples for each stratum (few rows): `least` from each (no more than it has), the rest in
    proportion to what is left, by largest remainder (ties to the stratum name). If the minimums
    alone exceed the target, they are cut one by one in turn, the largest first."""
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goal = F.least(F.lit(target), F.sum(size).over(every))
    a = sizes.withColumn("base", F.least(F.lit(least), F.col(size))).withColumn("goal", goal)
    a = a.withColumn("used", F.sum("base").over(every)).withColumn("room", F.col(size) - F.col("base"))
    spare = F.greatest(F.col("goal") - F.col("used"), F.lit(0))
    a = a.withColumn("ideal", F.coalesce(spare * F.col("room") / F.nullif(F.sum("room").over(every), F.lit(0)), F.lit(0.0)))
    a = a.withColumn("whole", F.least(F.floor("ideal"), F.col("room"))).withColumn("left", spare - F.sum(F.least(F.floor("ideal"), F.col("room"))).over(every))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.when(F.col("whole") < F.col("room"), F.col("ideal") - F.floor("ideal")).otherwise(-1.0)), stratum))
    a = a.withColumn("more", ((turn <= F.col("left")) & (F.col("whole") < F.col("room"))).cast("int"))
    over = F.col("used") - F.col("goal")
    n = F.count(F.lit(1)).over(every)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("base"), stratum))
    cut = F.floor(over / n) + (place <= over % n).cast("int")
    return a.select(stratum, size, F.when(over > 0, F.greatest(F.col("base") - cut, F.lit(0))).otherwise(F.col("base") + F.col("whole") + F.col("more")).cast("long").alias("alloc"))


def sample_size(sigma: Column, margin: Column, population: Column, z: float = 1.96) -> Column:
    """Rows needed for a margin of error, with correction for a finite population."""
    n0 = z * z * sigma * sigma / (margin * margin)
    return F.when((margin <= 0) | (sigma <= 0), F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.when(population > 0, n0 / (1 + (n0 - 1) / population)).otherwise(n0)))).cast("long")


def margin(sigma: Column, n: Column, population: Column, z: float = 1.96) -> Column:
    base = z * sigma / F.sqrt(n)
    return F.when((n <= 0) | (sigma <= 0), F.lit(float("inf"))).when(population > n, base * F.sqrt((population - n) / (population - 1))).otherwise(base)


def bootstrap(pairs: DataFrame, by: list[str], a: str, b: str, order: str, draws: int = 5000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Percentile bootstrap of the mean paired difference and of the geometric mean ratio within
    `by`: n, mean_diff, diff_low, diff_high, excludes_zero, gm, gm_low, gm_high.

    The draws are those of Python's Mersenne Twister with this seed over rows in `order`, so they
    repeat bit by bit; a group's differences are one array in one task.
    """
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)

    def resampled(values: list[float]) -> tuple[float, float]:
        rng, n = random.Random(seed), len(values)
        if n == 1:
            return values[0], values[0]
        found = sorted(math.fsum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(draws))
        tail = (1 - confidence) / 2
        return found[max(0, math.floor(tail * draws))], found[min(draws - 1, math.ceil((1 - tail) * draws) - 1)]

    def run(pdf):
        pdf = pdf[[*by, a, b, order]].dropna().sort_values(order)
        if not len(pdf):
            return pdf.reindex(columns=[*by, *names])
        diffs = (pdf[a] - pdf[b]).astype(float).tolist()
        logs = [math.log(x / y) for x, y in zip(pdf[a], pdf[b]) if x > 0 and y > 0]
        lo, hi = resampled(diffs)
        out = {c: [pdf[c].iloc[0]] for c in by} | {"n": [len(diffs)], "mean_diff": [math.fsum(diffs) / len(diffs)], "diff_low": [lo], "diff_high": [hi], "excludes_zero": [len(diffs) > 1 and (lo > 0 or hi < 0)]}
        g = resampled(logs) if logs else (None, None)
        out |= {"gm": [math.exp(math.fsum(logs) / len(logs)) if logs else None], "gm_low": [math.exp(g[0]) if logs else None], "gm_high": [math.exp(g[1]) if logs else None]}
        import pandas as pd

        return pd.DataFrame(out)

    names = ["n", "mean_diff", "diff_low", "diff_high", "excludes_zero", "gm", "gm_low", "gm_high"]
    return pairs.groupBy(*by).applyInPandas(run, f"{kinds}, n long, mean_diff double, diff_low double, diff_high double, excludes_zero boolean, gm double, gm_low double, gm_high double")
