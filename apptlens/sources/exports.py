"""CSV exports of worklists and threshold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def export_csv(df: DataFrame, path: str) -> None:
    """Write rows with a header, one file per task, no index column."""
    df.write.option("header", True).csv(path)


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an export back with its schema."""
    return spark.read.option("header", True).schema(schema).csv(path)
