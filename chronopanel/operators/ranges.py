"""Ranks, running sums and exact quantiles of groups of any size, without a window or a value map that holds a group.

Distinct values are counted first. The counts are range-partitioned by group and value, so a group with most of the rows is many tasks; running sums
are taken inside each range, and what the earlier ranges of the group hold is added from a table with a row for each range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.checkpoints import cut


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` range-partitioned by ``order`` with ``_part``, the range's number; cut, as ranges are drawn from a sample."""
    return cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def with_before(rows: DataFrame, groups: list[str], value: list[str], sums: list[str]) -> DataFrame:
    """``rows`` (one for each group and value) with ``before_<c>``: the sum of c over the group's smaller values, and ``all_<c>``: over all of them."""
    parts = ranged(rows, [*groups, *value])
    inside = Window.partitionBy(*groups, "_part").orderBy(*value).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*groups, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    of = Window.partitionBy(*groups)
    zero = F.lit(0)
    offsets = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_{c}").over(earlier), zero).alias(f"_before_{c}") for c in sums], *[F.sum(f"_{c}").over(of).alias(f"all_{c}") for c in sums])
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    seen = parts.select("*", *[F.coalesce(F.sum(c).over(inside), zero).alias(f"_inside_{c}") for c in sums])
    return seen.join(offsets, on).select(*rows.columns, *[(F.col(f"_inside_{c}") + F.col(f"_before_{c}")).alias(f"before_{c}") for c in sums], *[f"all_{c}" for c in sums])


def counted(rows: DataFrame, groups: list[str], value: str, *more: Column) -> DataFrame:
    """groups, value, n: a row for each known value of each group."""
    return rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"), *more)


def quantiles(rows: DataFrame, groups: list[str], value: str, shares: list[float], out: str = "q") -> DataFrame:
    """groups, ``out``: the exact quantiles, interpolated between the neighbouring ranks (an array in the order of ``shares``). Nulls are left out."""
    at = with_before(counted(rows, groups, value), groups, [value], ["n"])
    covers = lambda rank: (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
    picked = []
    for i, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("all_n") - 1)
        low = F.floor(place)
        picked += [F.max(F.when(covers(low), F.col(value).cast("double"))).alias(f"_l{i}"), F.max(F.when(covers(F.least(low + 1, F.col("all_n") - 1)), F.col(value).cast("double"))).alias(f"_h{i}"), F.max(place - low).alias(f"_f{i}")]
    found = at.groupBy(*groups).agg(*picked)
    return found.select(*groups, F.array(*[F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}") for i in range(len(shares))]).alias(out))


def dense_numbers(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """keys, ``out``: a number from 0 for each distinct key of several columns, in their order (nulls first)."""
    return row_numbers(rows.select(*keys).distinct(), keys, out)


def row_numbers(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """``rows`` with their number from 0 in the given order. Rows equal in ``order`` are told apart by all their columns, so only equal rows are interchangeable."""
    ties = [c for c in rows.columns if c not in order]
    parts = ranged(rows, [*order, *ties])
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order, *ties)) - 1
    return parts.withColumn("_inside", inside).join(before, F.col("_part") == F.col("_p")).select(*rows.columns, (F.col("_inside") + F.col("_before")).cast("bigint").alias(out))


def average_ranks(rows: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the rank of ``value`` in its group from 1, ties sharing their mean rank; null for nulls."""
    at = with_before(counted(rows, groups, value), groups, [value], ["n"])
    ranks = at.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate([*groups, value])], (F.col("before_n") + (F.col("n") + 1) / 2).alias(out))
    on = F.lit(True)
    for i, c in enumerate([*groups, value]):
        on = on & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    return rows.join(ranks, on, "left").select(*rows.columns, out)
