"""Store panels, features and forecasts as Parquet partitioned by a period bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .sales import as_schema


def write_panel(df: DataFrame, path: str, partition_by: str = "bucket", fmt: str = "parquet") -> None:
    """Write ``df``; a rerun replaces only the partitions it has rows for.

    A missing ``bucket`` column is made as the year of ``period``. Every task writes its own rows of a
    bucket, so a large bucket is never pulled into one task.
    """
    if partition_by == "bucket" and "bucket" not in df.columns:
        df = df.withColumn("bucket", F.year("period"))
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_by)
        .format(fmt)
        .save(path)
    )


def read_panel(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """Read a stored panel with its declared schema (partition column included)."""
    return spark.read.schema(as_schema(schema)).format(fmt).load(path)
