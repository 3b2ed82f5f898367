"""Joins that must match one to one, with their checks as counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left")


def attach_problems(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: left and right keys that occur more than once, left rows without a match. All zero where ``attach`` is one to one."""
    repeated = lambda df, name: df.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias(name))
    lost = left.join(right.select(*keys), keys, "left_anti").agg(F.count("*").alias("unmatched"))
    return repeated(left, "repeated_left").crossJoin(F.broadcast(repeated(right, "repeated_right"))).crossJoin(F.broadcast(lost))  # single rows


def filled(rows: DataFrame, saved: DataFrame, keys: list[str], column: str, computed: str) -> DataFrame:
    """``column`` from ``saved`` where it has a value, else the ``computed`` column; ``was_saved`` says which."""
    joined = rows.join(saved.select(*keys, F.col(column).alias("_saved")), keys, "left")
    return joined.withColumn(column, F.coalesce("_saved", computed)).withColumn("was_saved", F.col("_saved").isNotNull()).drop("_saved")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides, which must be none for training and held-out entities."""
    return a.select(key).intersect(b.select(key))
