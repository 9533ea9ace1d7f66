"""Raw history in CSV parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apptlens.operators.prefix import ROWS_PER_RANGE, row_numbers
from apptlens.schemas import RAW_SCHEMA

# Names of the parts.
PART_NAMES = ("Data_part_a.csv", "Data_part_b.csv", "Data_part_c.csv", "Data_part_d.csv")

_OPTIONS = {
    "header": True,
    "enforceSchema": False,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_part(spark: SparkSession, path: str) -> DataFrame:
    """One part with the declared schema; the header must match it."""
    return spark.read.options(**_OPTIONS).schema(RAW_SCHEMA).csv(path)


def scan_raw_parts(spark: SparkSession, folder: str, names: Sequence[str] = PART_NAMES, skip_missing: bool = False) -> DataFrame:
    """All parts stacked. A missing part is an error unless ``skip_missing``."""
    parts = []
    for name in names:
        try:
            parts.append(read_part(spark, f"{folder}/{name}"))
        except AnalysisException as problem:
            if not (skip_missing and problem.getCondition() == "PATH_NOT_FOUND"):
                raise
    if not parts:
        raise FileNotFoundError(f"none of the parts exist under {folder}")
    return union_all_parts(parts)


def union_all_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name."""
    return reduce(DataFrame.unionByName, parts)


def scan_head_per_part(
    parts: Sequence[DataFrame], n: int, order: Sequence[Column | str], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """The first n / parts rows of every part in the given order.

    Ranked rather than sorted and limited: a limit would pass the heads of
    all tasks through one.
    """
    columns = parts[0].columns
    stacked = union_all_parts([part.withColumn("__part", F.lit(i)) for i, part in enumerate(parts)])
    ranked = row_numbers(stacked, ["__part"], order, "__place", rows_per_range)
    return ranked.filter(F.col("__place") <= n // len(parts)).select(*columns)


def write_part(df: DataFrame, path: str) -> None:
    """Write rows in the layout ``read_part`` expects."""
    write_options = {k: v for k, v in _OPTIONS.items() if k != "enforceSchema"}
    df.select(*RAW_SCHEMA.fieldNames()).write.options(**write_options).csv(path)
