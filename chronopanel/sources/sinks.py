"""Writers: datasets as Parquet or CSV by Spark's commit protocol, one folder for each policy, rounded reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Refuses to overwrite unless told to; readers see the files only once all are committed."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def policy_panels(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy("policy_day").parquet(path)


def report(df: DataFrame, places: int = 3, scientific: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded half to even, or as text in scientific notation."""
    return df.select(*[F.format_string("%.3e", c).alias(c) if c in scientific else F.bround(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def transposed(df: DataFrame, key: str, columns: list[str], most: int = 1000) -> DataFrame:
    """A small report on its side: a row for each column, a column for each key. More than ``most`` keys fail: that is no report."""
    keys = [r[0] for r in df.select(key).distinct().orderBy(key).limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"more than {most} values of {key}")
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("x")) for c in columns])).alias("s")).select(key, "s.*")
    return long.groupBy("measure").pivot(key, keys).agg(F.first("x"))


def settings(df_or_spark, values: dict, path: str) -> None:
    """Run settings as one JSON document."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
