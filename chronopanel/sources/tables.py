"""Typed reads of the warehouse tables, and the event tables seen as stays, exposures and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.functions.time import micros

EXPOSURE, OUTCOME, ITEMS, DEATH = "signup", "purchase", ("view", "click"), ("error", 200.0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table as it is, so filters and column choices reach the files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def known(x: str) -> Column:
    """A floating column with NaN as null, so missing values are one thing."""
    return F.nanvl(x, F.lit(None))


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV table with a header under an explicit schema; column names are trimmed, nothing is inferred."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def policy_collection(spark: SparkSession, path: str, schema: T.StructType | str | None = None, days: list[int] | None = None) -> DataFrame:
    """All policy panels under ``path``, one folder for each: policy_day comes from ``policy_day=<d>``. With ``days``, other folders or missing ones fail."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    found = reader.option("basePath", path).parquet(path).withColumn("policy_day", F.col("policy_day").cast("bigint"))
    if days is not None:
        seen = {r[0] for r in found.select("policy_day").distinct().collect()}  # a row for each folder
        if seen != set(days):
            raise ValueError(f"policy days {sorted(map(str, seen))} instead of {sorted(days)}")
    return found


def first_labels(labels: DataFrame, item: str = "item", label: str = "label", order: str | None = None) -> DataFrame:
    """One label for each item: that of the first row by ``order`` (of equal rows the smallest label), whether it is missing or not; the smallest label without an order."""
    first = F.min_by(label, F.struct(order, label)) if order else F.min(label)
    return labels.where(F.col(item).isNotNull()).groupBy(item).agg(first.alias(label))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """entity, item, t, value, event_id."""
    return table(spark, folder, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("item"), micros("ts").alias("t"), known("value").alias("value"), "event_id")


def stays(ev: DataFrame) -> DataFrame:
    dead = F.when((F.col("item") == DEATH[0]) & (F.col("value") > DEATH[1]), F.col("t"))
    return ev.groupBy("entity").agg(F.min("t").alias("unit_in"), F.max("t").alias("unit_out"), F.min(dead).alias("death"))


def exposures(ev: DataFrame) -> DataFrame:
    length = F.round(F.col("value") * 3600).cast("bigint") * 1_000_000
    return ev.where(F.col("item") == EXPOSURE).select("entity", F.col("t").alias("start"), (F.col("t") + length).alias("end"))


def outcomes(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("item") == OUTCOME).select("entity", "t")


def measurements(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("item").isin(*ITEMS)).select("entity", "item", "t", "value")
