"""Sources and sinks: files, generated ranges and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table ``name`` in ``folder``. Columns and filters that a query needs reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """A file source; text formats need a schema, which spares a pass to infer one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    if schema is None and kind in ("json", "csv"):
        raise ValueError(f"{kind} needs a schema")
    source = spark.read.format(kind).options(**options)
    return (source.schema(schema) if schema is not None else source).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    df.write.mode(mode).format(kind).partitionBy(*partition_by).save(path)


def arange(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """(pos, x): start, start + step, ... below stop."""
    if step == 0:
        raise ValueError("step is zero")
    n = max(0, -(-(stop - start) // step))
    return spark.range(n).select(F.col("id").alias("pos"), (F.lit(start) + F.col("id") * step).alias("x"))


def linspace(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    """(pos, x): n evenly spaced values, both ends included."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    last = F.lit(float(stop))
    return spark.range(n).select(F.col("id").alias("pos"), F.when((F.col("id") == n - 1) & F.lit(n > 1), last).otherwise(F.lit(float(start)) + F.col("id") * step).alias("x"))


def full(spark: SparkSession, n: int, value: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(value).alias("x"))


def eye(spark: SparkSession, n: int) -> DataFrame:
    """The identity matrix as coordinates (i, j, v)."""
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
