"""Discrimination, calibration and group comparisons of scored rows."""

from __future__ import annotations

from math import erfc, exp, lgamma, sqrt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from chronopanel.functions.stats import upper_normal_tail
from chronopanel.operators import ranges
from chronopanel.shipping import ship


def binary_metrics(scored: DataFrame, group: str = "group", y: str = "y", p: str = "p") -> DataFrame:
    """group, n, events, auc, average_precision, brier.

    Scores are counted, and their squared errors added up, at each distinct value first; running sums over ranges of those values give both areas, so ties are exact and no task
    holds a group's scores. Null where a group has one class.
    """
    error = (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))
    counts = scored.groupBy(group, p).agg(F.count("*").alias("n"), F.sum(y).alias("pos"), F.sum(error).alias("error"), F.count(error).alias("known"))
    at = ranges.with_before(counts, [group], [p], ["n", "pos"])
    steps = at.select(group, "n", "pos", "error", "known", (F.col("all_pos") - F.col("before_pos")).alias("tp"), (F.col("all_n") - F.col("before_n")).alias("taken"))
    pairs = F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2))
    areas = steps.groupBy(group).agg(F.sum("n").alias("n"), F.sum("pos").alias("events"), pairs.alias("pairs"), F.sum(F.col("pos") * F.col("tp") / F.col("taken")).alias("precision"), F.try_divide(F.sum("error"), F.sum("known")).alias("brier"))
    both = (F.col("events") > 0) & (F.col("events") < F.col("n"))
    return areas.select(group, "n", "events", F.when(both, F.col("pairs") / (F.col("events") * (F.col("n") - F.col("events")))).alias("auc"), F.when(F.col("events") > 0, F.col("precision") / F.col("events")).alias("average_precision"), "brier")


def quantile_bins(scored: DataFrame, bins: int, group: str = "group", p: str = "p") -> DataFrame:
    """``scored`` with ``bin`` from 0: bounds at quantiles, equal bounds dropped, values on a bound in the lower bin, the lowest bin closed below."""
    edges = ranges.quantiles(scored, [group], p, [k / bins for k in range(bins + 1)], "edges").withColumn("edges", F.array_distinct("edges"))
    below = F.size(F.filter("edges", lambda e: e < F.col(p)))
    return scored.join(edges, group).withColumn("bin", F.greatest(below - 1, F.lit(0)).cast("bigint")).drop("edges")


def calibration(scored: DataFrame, bins: int = 10, group: str = "group", y: str = "y", p: str = "p") -> DataFrame:
    binned = quantile_bins(scored, bins, group, p)
    return binned.groupBy(group, "bin").agg(F.count("*").alias("n"), F.sum(y).alias("events"), F.min(p).alias("least_p"), F.avg(p).alias("mean_p"), F.max(p).alias("most_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def rank_tests(long: DataFrame, item: str = "item", value: str = "value", y: str = "y") -> DataFrame:
    """For each item: Mann-Whitney's U of y=1 against y=0, its two-sided p by the normal approximation with ties and continuity, Cliff's delta."""
    known = long.where(F.col(value).isNotNull())
    at = ranges.with_before(ranges.counted(known, [item], value, F.sum(y).alias("pos")), [item], [value], ["n"])
    ranks = at.withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)
    sums = ranks.groupBy(item).agg(F.sum("n").alias("n"), F.sum("pos").cast("double").alias("n1"), F.sum(F.col("pos") * F.col("rank")).alias("r1"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    n0 = F.col("n") - F.col("n1")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    product = F.col("n1") * n0
    sigma = F.sqrt(product / 12 * (F.col("n") + 1 - F.try_divide(F.col("ties"), F.col("n") * (F.col("n") - 1))))
    z = F.try_divide(F.greatest(F.abs(u - product / 2) - 0.5, F.lit(0.0)), sigma)
    return sums.select(item, "n", F.col("n1").cast("bigint").alias("n1"), u.alias("u"), F.coalesce(upper_normal_tail(z), F.lit(1.0)).alias("p_value"), F.try_divide(2 * u, product).alias("raw_delta")).withColumn("cliffs_delta", F.col("raw_delta") - 1).drop("raw_delta")


def adjusted(tests: DataFrame, p: str = "p_value", tie: str = "item") -> DataFrame:
    """Benjamini-Hochberg: the running minimum of p * m / rank from the largest p down, at most 1. One row for each test, so one window."""
    every = Window.partitionBy(F.lit(0))
    ranked = tests.withColumn("_rank", F.row_number().over(every.orderBy(p, tie))).withColumn("_m", F.count("*").over(every))
    down = every.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q_value", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))).drop("_rank", "_m")


def two_by_two(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """For each group the table of two flags: counts, odds ratio, risk difference, chi-squared without continuity correction."""
    f = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y))
    t = rows.groupBy(group).agg(f(1, 1).alias("n11"), f(1, 0).alias("n10"), f(0, 1).alias("n01"), f(0, 0).alias("n00"))
    n11, n10, n01, n00 = (F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00"))
    n = n11 + n10 + n01 + n00
    margins = (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)
    return t.select("*", F.try_divide(n11 * n00, n10 * n01).alias("odds_ratio"), (F.try_divide(n11, n11 + n10) - F.try_divide(n01, n01 + n00)).alias("risk_difference"), F.try_divide(n * F.pow(n11 * n00 - n10 * n01, F.lit(2)), margins).alias("chi_squared"))


def fisher_exact(n11: int, n10: int, n01: int, n00: int) -> float:
    """Two-sided p of a 2x2 table: the sum of the hypergeometric probabilities that don't exceed the table's own."""
    row, column, n = n11 + n10, n11 + n01, n11 + n10 + n01 + n00
    choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    log_p = [choose(row, k) + choose(n - row, column - k) - choose(n, column) for k in range(max(0, row + column - n), min(row, column) + 1)]
    own = log_p[n11 - max(0, row + column - n)]
    return min(1.0, sum(exp(x) for x in log_p if x <= own + 1e-7))


#: Smallest expected count from which the chi-squared p is taken for the exact one.
EXACT_BELOW = 1_000


def fisher_p(two: DataFrame, exact_below: float = EXACT_BELOW) -> DataFrame:
    """The rows of ``two_by_two`` with ``fisher_p`` and ``chi_squared_p``. One row for each tested group, so in Arrow batches of counts.

    The exact p sums over a margin; where all expected counts reach ``exact_below`` it would be long and equal to the chi-squared p for any use, which stands in."""
    ship(two.sparkSession)

    @pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, tail: pd.Series) -> pd.Series:
        def one(n11: int, n10: int, n01: int, n00: int, p: float) -> float:
            least = min(n11 + n10, n01 + n00) * min(n11 + n01, n10 + n00) / max(1, n11 + n10 + n01 + n00)
            return fisher_exact(n11, n10, n01, n00) if least < exact_below else p

        return pd.Series([one(*map(int, t[:4]), t[4]) for t in zip(a, b, c, d, tail, strict=True)])

    @pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else chi_squared_p(v) for v in x], dtype="float64")

    known = two.withColumn("chi_squared_p", tail("chi_squared"))
    return known.select(*two.columns, exact("n11", "n10", "n01", "n00", "chi_squared_p").alias("fisher_p"), "chi_squared_p")


def chi_squared_p(x: float) -> float:
    """The upper tail of chi-squared with one degree of freedom."""
    return erfc(sqrt(max(x, 0) / 2))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, sd, least, q1, median, q3, most of known values."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*").where("x IS NOT NULL")
    sums = long.groupBy("column").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"))
    q = ranges.quantiles(long, ["column"], "x", [0.25, 0.5, 0.75])
    return sums.join(q, "column").select("column", "n", "mean", "sd", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "most")


def constant_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, reason ("all_missing" or "constant") of columns that can't inform a model; one pass."""
    one = rows.agg(*[F.struct(F.count(c).alias("n"), (F.min(c) == F.max(c)).alias("same")).alias(c) for c in columns])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.n").alias("n"), F.col(f"`{c}`.same").alias("same")) for c in columns])).alias("s")).select("s.*")
    return long.where((F.col("n") == 0) | F.col("same")).select("column", F.when(F.col("n") == 0, "all_missing").otherwise("constant").alias("reason"))


