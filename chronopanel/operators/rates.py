"""Cross-fitted rate models: a cell's rate for each fold from the rows of the other folds, from one aggregate.

Cells are a model's features. Sums are additive, so what the other folds say is the total less the fold's own: no fold is read twice,
nothing is collected, and the same holds for any weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sums_by_fold(rows: DataFrame, cell: list[str], y: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return rows.groupBy("fold", *cell).agg(F.sum(w).alias("n"), F.sum(w * F.col(y)).alias("e"))


def crossfit_rates(rows: DataFrame, cell: list[str], y: str, n_folds: int = 5, weight: str | None = None) -> DataFrame:
    """fold, cell, p: (events + 1) / (n + 2) of the rows (with ``fold``) of the other folds; for every cell that has rows in any fold."""
    own = sums_by_fold(rows, cell, y, weight)
    total = own.groupBy(*cell).agg(F.sum("n").alias("n_all"), F.sum("e").alias("e_all")).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_folds - 1).cast("bigint"))))
    met = total.join(own, ["fold", *cell], "left")
    zero = F.lit(0.0)
    return met.select("fold", *cell, ((F.col("e_all") - F.coalesce("e", zero) + 1) / (F.col("n_all") - F.coalesce("n", zero) + 2)).alias("p"))


def by_action(fitted: DataFrame, keys: list[str], action: str, out: str = "q") -> DataFrame:
    """keys, q_keep, q_remove: the rates under both actions side by side; a half where an action was never seen in the cell."""
    pick = lambda a: F.coalesce(F.max(F.when(F.col(action) == a, F.col("p"))), F.lit(0.5))
    return fitted.groupBy(*keys).agg(pick(0).alias(f"{out}_keep"), pick(1).alias(f"{out}_remove"))


def stacked_weight(rows: DataFrame, groups: list[str], a: Column, b: Column, y: Column) -> DataFrame:
    """groups, weight: the share of prediction ``a`` (of ``b``: the rest) with the least squared error, between 0 and 1; a half where they are equal."""
    d = a - b
    found = rows.groupBy(*groups).agg(F.sum(d * (y - b)).alias("_c"), F.sum(d * d).alias("_v"))
    return found.select(*groups, F.when(F.col("_v") > 1e-15, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_c") / F.col("_v")))).otherwise(0.5).alias("weight"))
