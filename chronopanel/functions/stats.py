"""Scalar and aggregate columns used by the estimators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """0 or 1; a null condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def expit(x: Column) -> Column:
    """The logistic function with its argument kept within 35 of zero."""
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(35.0)), F.lit(-35.0))))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))
    return F.ln(q / (1 - q))


def any_event(p: Column) -> Column:
    """Aggregate: one minus the product of (1 - p), p kept within [0, 1]; nulls are skipped, null if there is nothing else."""
    return 1 - F.product(1 - F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def effective_size(w: Column) -> Column:
    """Aggregate: the effective sample size of weights, 0 where they are all zero or there are none."""
    return F.coalesce(F.try_divide(F.pow(F.sum(w), F.lit(2)), F.sum(w * w)), F.lit(0.0))


def positive_effective_size(w: Column) -> Column:
    """Aggregate: the effective sample size of the weights that are positive and finite; null where there are none."""
    good = F.when((w > 0) & (w < float("inf")), w)
    return F.pow(F.sum(good), F.lit(2)) / F.sum(good * good)


def smoothed(events: Column, n: Column) -> Column:
    """A rate with one event and one non-event added."""
    return (events + 1) / (n + 2)


def upper_normal_tail(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal: Abramowitz and Stegun 26.2.17, absolute error under 1.5e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-x * x / 2) / 2.5066282746310002 * poly)


def uniform(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) from integers alone, by two rounds of a linear congruential generator; the same in any engine and partitioning."""
    x = F.lit(seed).cast("bigint")
    for k in ids:
        x = F.pmod(F.pmod(F.pmod(k.cast("bigint"), F.lit(2147483648)) + x * 31 + 17, F.lit(2147483648)) * 1103515245 + 12345, F.lit(2147483648))
    return F.pmod(x * 1103515245 + 12345, F.lit(2147483648)) / 2147483648.0


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All double columns rounded."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
