"""Shared helpers: table reads, lineage cuts, Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.shipping import ship


BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Sends the package out, and where the session has Spark's default of 10,000 rows for an Arrow batch sets 512: texts are long."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="chronopanel-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder, so later actions neither recompute it nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_go(spark: SparkSession):
    """Inside, Spark removes a query's shuffle files as soon as it ends; the caller's setting is put back. For many short queries whose results are all cut or written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``cut``, but as compressed Parquet: for tables that hold texts."""
    return kept(df, name)[0]


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written`` and its path, for ``remove`` once nothing reads it any more."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


MOST_BROADCAST = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """``ids`` (a few numbers a row) marked for broadcast if its checked size is at most MOST_BROADCAST rows, 8 MB a column; beyond it Spark shuffles."""
    return F.broadcast(ids) if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else ids


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder under the shared folder by Hadoop's file system interface."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def texts(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Only the named columns; a null text is empty. Extra columns go here, so none can clash later."""
    return docs.select(*[F.col(k) for k in keys], F.coalesce(F.col(text), F.lit("")).alias(text))


def rows_of(batch: pa.RecordBatch, *names: str, size: int = 64):
    """Tuples of the named columns; texts become Python objects a few rows at a time."""
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield from zip(*[part.column(part.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.strip().split(" ", 1) for field in ddl.split(","))])


def batches(rows, ddl: str, size: int = 2000):
    """Record batches of at most ``size`` rows from an iterator of tuples; columns as in ``ddl``."""
    schema, held = schema_of(ddl), []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def type_of(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]
