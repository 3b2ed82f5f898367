"""Resampling of entities, and intervals from replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.stats import uniform
from chronopanel.operators import ranges


def entity_numbers(entities: DataFrame) -> DataFrame:
    """entity, number from 0 in order of the id."""
    return ranges.dense_numbers(entities, ["entity"], "number")


def draws(n: int, replicates: int, seed: int, spark) -> DataFrame:
    """replicate, number, times: ``n`` entities drawn with replacement for each replicate, by integers that any engine reproduces. The grid is a range, so no row or task holds a replicate."""
    grid = spark.range(n * replicates).select(F.floor(F.col("id") / n).cast("bigint").alias("replicate"), (F.col("id") % n).alias("draw"))
    pick = F.floor(uniform(seed, F.col("replicate"), F.col("draw")) * n).cast("bigint")
    return grid.select("replicate", pick.alias("number")).groupBy("replicate", "number").agg(F.count("*").alias("times"))


def draw_arrays(drawn: DataFrame, replicates: int) -> DataFrame:
    """entity, times: how often each replicate drew the entity, as an array by replicate. A row for each entity drawn at all."""
    by = F.map_from_entries(F.collect_list(F.struct("replicate", "times")))
    found = drawn.groupBy("entity").agg(by.alias("by"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))
    return found.select("entity", F.transform(numbers, lambda r: F.coalesce(F.try_element_at("by", r), F.lit(0)).cast("int")).alias("times"))


def copies(rows: DataFrame, drawn: DataFrame, key: str = "entity") -> DataFrame:
    """``rows`` of the drawn entities, as often as drawn: ``copy`` from 0 tells the trajectories of one entity apart."""
    return rows.join(drawn, key).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)))


def entity_sums(risks: DataFrame, values: list[str]) -> DataFrame:
    """policy, entity, measure, total, n: sums and counts of known values, all that a fixed-model replicate needs."""
    long = risks.select("policy", "entity", F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("x")) for v in values])).alias("m")).select("policy", "entity", "m.measure", "m.x").where("x IS NOT NULL")
    return long.groupBy("policy", "entity", "measure").agg(F.sum("x").alias("total"), F.count("*").alias("n"))


def replicate_means(sums: DataFrame, numbers: DataFrame, drawn: DataFrame) -> DataFrame:
    """replicate, policy, measure, estimate: means weighted by how often each entity was drawn; null without any."""
    weighted = sums.join(numbers, "entity").join(drawn, "number")
    return weighted.groupBy("replicate", "policy", "measure").agg(F.try_divide(F.sum(F.col("times") * F.col("total")), F.sum(F.col("times") * F.col("n"))).alias("estimate"))


def paired(estimates: DataFrame, baseline: str) -> DataFrame:
    """Each policy's estimate less the baseline's of the same replicate and measure."""
    base = estimates.where(F.col("policy") == baseline).select("replicate", "measure", F.col("estimate").alias("base"))
    return estimates.where(F.col("policy") != baseline).join(base, ["replicate", "measure"]).select("replicate", "policy", "measure", (F.col("estimate") - F.col("base")).alias("estimate"))


def percentile_intervals(estimates: DataFrame, level: float = 0.95) -> DataFrame:
    """policy, measure, low, high, n, n_valid, n_undefined. The replicates of a policy and measure are few, so percentiles are exact."""
    valid = F.col("estimate").isNotNull() & ~F.isnan("estimate")
    x = F.when(valid, F.col("estimate"))
    edge = (1 - level) / 2
    return estimates.groupBy("policy", "measure").agg(F.percentile(x, edge).alias("low"), F.percentile(x, 1 - edge).alias("high"), F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_undefined"))
