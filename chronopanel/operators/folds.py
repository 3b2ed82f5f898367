"""Folds of whole entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(rows: DataFrame, group: str):
    """Integers by themselves, ids of other types by their hash."""
    whole = rows.schema[group].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    return F.col(group).cast("bigint") if whole else F.xxhash64(group)


def grouped_folds(rows: DataFrame, k: int = 5, group: str = "entity", buckets: int = 64) -> DataFrame:
    """group, n_rows, fold in 0..k-1: every group in one fold, folds of about equal numbers of rows.

    Groups are dealt in turn, forwards and backwards, in descending size. Above a few thousand groups the order is taken inside
    ``buckets`` by hash, each of which deals from another fold on, so no task sorts them all.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n_rows"))
    dealt = sizes.withColumn("bucket", F.pmod(bucket_of(rows, group), F.lit(buckets)))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("n_rows"), group)) - 1
    turn = F.pmod(place, F.lit(2 * k))
    snake = F.when(turn < k, turn).otherwise(2 * k - 1 - turn)
    return dealt.select(group, "n_rows", F.pmod(snake + F.col("bucket"), F.lit(k)).cast("bigint").alias("fold"))


def fold_violations(rows: DataFrame, group: str = "entity", fold: str = "fold") -> DataFrame:
    """Counts that must be zero: groups in several folds; and the number of folds."""
    each = rows.groupBy(group).agg(F.count_distinct(fold).alias("n"))
    return each.agg(F.count_if(F.col("n") != 1).alias("groups_in_several_folds")).crossJoin(F.broadcast(rows.agg(F.count_distinct(fold).alias("n_folds"))))


def audit(rows: DataFrame, label: str, group: str = "entity", fold: str = "fold", n_folds: int = 5) -> DataFrame:
    """fold: entities, rows and events of the training and held-out part of its fit, and how many entities are in several folds."""
    each = rows.groupBy(group, fold).agg(F.count("*").alias("n"), F.sum(label).alias("events"))
    marked = each.withColumn("several", (F.count("*").over(Window.partitionBy(group)) > 1).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_folds - 1).cast("bigint"))))
    held = F.col(fold) == F.col("k")
    pick = lambda held_, x: F.coalesce(F.sum(F.when(held_, x)), F.lit(0))
    found = marked.groupBy("k").agg(F.count_distinct(F.when(~held, F.col(group))).alias("train_entities"), F.count_distinct(F.when(held, F.col(group))).alias("held_entities"), pick(~held, F.col("n")).alias("train_rows"), pick(held, F.col("n")).alias("held_rows"), pick(~held, F.col("events")).alias("train_events"), F.count_distinct(F.when(F.col("several") == 1, F.col(group))).alias("shared_entities"))
    return found.withColumnRenamed("k", "fold")
