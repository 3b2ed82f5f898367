"""Merging intervals, resolving endpoints, and expanding spans onto a fixed grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.time import DAY, floor_div


def _merged(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("fresh", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0))).withColumn("island", island)
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(n).alias("n_merged")).drop("island")


def merge_intervals(df: DataFrame, keys: list[str], slice_micros: int = 30 * DAY) -> DataFrame:
    """Unions of overlapping or touching [start, end] intervals of each key: keys, start, end, n_merged.

    Intervals are first merged inside slices of time, so a key with very many of them is spread over tasks;
    only the islands of its slices meet in the last step. Null bounds are dropped, as are intervals of no length.
    """
    valid = df.where("start IS NOT NULL AND end IS NOT NULL AND end > start").withColumn("slice", floor_div(F.col("start"), slice_micros)).withColumn("n_merged", F.lit(1).cast("bigint"))
    return _merged(_merged(valid, [*keys, "slice"], "n_merged").drop("slice"), keys, "n_merged")


def with_next(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lead(value).over(Window.partitionBy(*keys).orderBy(order)))


def first_endpoint(candidates: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(time, reason) of the first of the named times, null ones skipped; at equal times the earlier name in the list wins."""
    at = F.least(*[F.col(c) for c, _ in candidates])
    reason = F.coalesce(*[F.when(F.col(c) == at, F.lit(name)) for c, name in candidates])
    return at, reason


def to_grid(df: DataFrame, start: str, end: str, period: int = DAY) -> DataFrame:
    """One row for each period from ``start`` on, the last one cut at ``end``: episode_index from 0, period_start, period_end. Empty spans give none."""
    spans = df.where(F.col(end) > F.col(start)).withColumn("n_periods", F.ceil((F.col(end) - F.col(start)) / F.lit(period)).cast("bigint"))
    rows = spans.withColumn("episode_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_periods") - 1))).drop("n_periods")
    begin = F.col(start) + F.col("episode_index") * F.lit(period)
    return rows.withColumn("period_start", begin).withColumn("period_end", F.least(begin + F.lit(period), F.col(end)))


def first_in_window(spans: DataFrame, events: DataFrame, key: str, low: str, high: str, name: str) -> DataFrame:
    """``spans`` with the first event time in [low, high] of the same key as ``name``. ``events``: key, t.

    Spans are told apart by key and ``low``. The match is an equi-join with the range as its condition; the minimum is
    taken before anything is joined back.
    """
    wanted = spans.select(F.col(key).alias("_k"), F.col(low).alias("_low"), F.col(high).alias("_high"))
    times = events.select(F.col(key).alias("_e"), F.col("t").alias("_t"))
    first = wanted.join(times, (F.col("_k") == F.col("_e")) & F.col("_t").between(F.col("_low"), F.col("_high"))).groupBy("_k", "_low").agg(F.min("_t").alias(name))
    return spans.join(first, (F.col(key) == F.col("_k")) & (F.col(low) == F.col("_low")), "left").drop("_k", "_low")
