"""The appointments table in one folder per month: updates write only the months they change.

Months come from the appointment's time; rows without one share a folder of
their own. A rewrite reads the months it touches, writes them beside the old
files, and swaps those folders when its job commits (dynamic partition
overwrite). Until then readers see the old rows; lost executors cost a retry
of their tasks; a job that fails before its commit leaves the table as it was.
One writer at a time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptlens.schemas import APPOINTMENTS_SCHEMA
from apptlens.sources.appointments_table import overdue_condition, resolve_overdue_status

MONTHLY_SCHEMA = T.StructType([*APPOINTMENTS_SCHEMA, T.StructField("month", T.StringType())])


def write_months(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write appointments, a few files per month and more where a month is large.

    ``mode="overwrite"`` replaces the months that occur in ``rows`` and leaves all others.
    """
    rows = rows.select(*APPOINTMENTS_SCHEMA.fieldNames(), F.date_format("appointment_date", "yyyy-MM").alias("month"))
    writer = rows.hint("rebalance", "month").write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("month").parquet(path)


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """The whole table, with its month."""
    return spark.read.schema(MONTHLY_SCHEMA).parquet(path)


def create_monthly_table(spark: SparkSession, name: str, path: str) -> None:
    """Create the table over a path if absent, and list the months it holds."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MONTHLY_SCHEMA)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (month) LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")


def overdue_months(table: DataFrame, as_of: datetime) -> DataFrame:
    """``month`` and ``n``: overdue rows per month. Later months are not read."""
    due = table.filter(F.col("month") <= as_of.strftime("%Y-%m")).filter(overdue_condition(as_of))
    return due.groupBy("month").agg(F.count("*").alias("n"))


def resolve_months(
    spark: SparkSession, path: str, as_of: datetime, outcomes: DataFrame | None = None, missed: Column | None = None
) -> DataFrame:
    """Resolve overdue rows in place; returns the rewritten months with the number of rows changed (``resolved``).

    Outcomes as in ``resolve_overdue_status``. Without overdue rows nothing is
    written. Run again, it finds nothing left to do.
    """
    table = read_months(spark, path)
    changed = [(r["month"], r["n"]) for r in overdue_months(table, as_of).collect()]
    if changed:
        touched = table.filter(F.col("month").isin([m for m, _ in changed])).drop("month")
        write_months(resolve_overdue_status(touched, as_of, outcomes, missed), path, "overwrite")
        spark.catalog.refreshByPath(path)
    return spark.createDataFrame(changed, "month string, resolved long")


def month_files(spark: SparkSession, path: str) -> DataFrame:
    """``month`` and ``file`` of the table's data files that hold rows."""
    return read_months(spark, path).select("month", F.col("_metadata.file_name").alias("file")).distinct()
