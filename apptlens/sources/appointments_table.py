"""The operational appointments table: create, read, append, resolve."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apptlens.functions.cleaning import coerce_numeric
from apptlens.operators.filters import overdue_scheduled
from apptlens.operators.prefix import ROWS_PER_RANGE, row_numbers
from apptlens.schemas import APPOINTMENTS_SCHEMA, BOOKING_COLUMNS
from apptlens.session import WIDE, settings


def create_table(spark: SparkSession, name: str, path: str, recreate: bool = False) -> None:
    """Create the table over Parquet files, keeping existing rows unless ``recreate``."""
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.createDataFrame([], APPOINTMENTS_SCHEMA).write.mode("overwrite").parquet(path)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in APPOINTMENTS_SCHEMA)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{path}'")


def coerce_scores(df: DataFrame) -> DataFrame:
    """Score as a number; unreadable scores become null."""
    return df.withColumn("predicted_risk_prob", coerce_numeric(F.col("predicted_risk_prob")))


def scan_appointments(spark: SparkSession, path: str) -> DataFrame:
    """The whole table with a numeric score."""
    return coerce_scores(spark.read.schema(APPOINTMENTS_SCHEMA).parquet(path))


def complete_bookings(batch: DataFrame, last_id: Column, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Bookings as table rows: next ids in a fixed order, default status, time stamp.

    ``last_id`` is the highest id in use, as a literal or a scalar subquery.
    """
    if "status" not in batch.columns:
        batch = batch.withColumn("status", F.lit(None).cast("string"))
    rows = batch.select(*BOOKING_COLUMNS).withColumn("status", F.coalesce("status", F.lit("Scheduled")))
    # Bookings have no key of their own; equal bookings may swap ids, which
    # changes nothing.
    order = ["booking_date", "appointment_date", "patient_id", "attending_physician", F.xxhash64(*BOOKING_COLUMNS)]
    rows = row_numbers(rows, [], order, "__n", rows_per_range)
    rows = rows.withColumns({"id": last_id + F.col("__n"), "created_at": F.current_timestamp().cast("timestamp_ntz")})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in APPOINTMENTS_SCHEMA])


def append_scored_bookings(spark: SparkSession, path: str, batch: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> None:
    """Add scored bookings to the table. One writer at a time.

    The batch is read several times: store it first if it is dear to make.
    """
    table = spark.read.schema(APPOINTMENTS_SCHEMA).parquet(path)
    last_id = table.select(F.coalesce(F.max("id"), F.lit(0)).alias("last")).scalar()
    with settings(spark, WIDE):
        complete_bookings(batch, last_id, rows_per_range).write.mode("append").parquet(path)


def resolve_overdue_status(
    df: DataFrame,
    as_of: datetime,
    outcomes: DataFrame | None = None,
    missed: Column | None = None,
) -> DataFrame:
    """Give past scheduled rows an outcome and mark them in ``resolved``.

    Known outcomes come from ``outcomes`` (id, outcome). Without one, a row is
    a No-Show where ``missed`` holds (default: one id in ten, by hash).
    """
    overdue = overdue_condition(as_of)
    missed = F.pmod(F.xxhash64("id"), F.lit(100)) < 10 if missed is None else missed
    assumed = F.when(missed, "No-Show").otherwise("Completed")
    rows = df
    if outcomes is not None:
        rows = rows.join(outcomes.select("id", F.col("outcome").alias("__outcome")), "id", "left")
        assumed = F.coalesce("__outcome", assumed)
    rows = rows.withColumn("resolved", F.coalesce(overdue, F.lit(False)).cast("int"))
    status = F.when(F.col("resolved") == 1, assumed).otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*df.columns, "resolved")


def overdue_condition(as_of: datetime) -> Column:
    """True for scheduled rows whose time has passed."""
    moment = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    return (F.col("status") == "Scheduled") & (F.col("appointment_date") < moment)


def rewrite_resolved(spark: SparkSession, path: str, new_path: str, as_of: datetime, outcomes: DataFrame | None = None) -> int:
    """Write the resolved table to a new path (the caller swaps it in); rows changed."""
    table = scan_appointments(spark, path)
    changed = overdue_scheduled(table, as_of).count()
    resolve_overdue_status(table, as_of, outcomes).drop("resolved").write.parquet(new_path)
    return changed

