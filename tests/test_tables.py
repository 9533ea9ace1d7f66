"""Sources, sinks and table maintenance."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from apptlens import session
from apptlens.plans import scoring  # noqa: F401  (import check)
from apptlens.schemas import APPOINTMENTS_SCHEMA, BOOKING_COLUMNS, RAW_SCHEMA
from apptlens.sources import appointments_table, exports, history_files, star


def test_raw_parts_round_trip(spark, sf_dir):
    folder = session.shared_dir(spark, "parts")
    raw = star.raw_history(spark, sf_dir).select(*RAW_SCHEMA.fieldNames())
    for i, name in enumerate(history_files.PART_NAMES[:3]):
        history_files.write_part(raw.filter(F.pmod("ENCNTR", F.lit(3)) == i), f"{folder}/{name}")
    with pytest.raises(AnalysisException):
        history_files.scan_raw_parts(spark, folder)
    back = history_files.scan_raw_parts(spark, folder, skip_missing=True)
    assert back.schema == RAW_SCHEMA
    assert back.exceptAll(raw).count() == 0 and back.count() == raw.count()
    with pytest.raises(FileNotFoundError):
        history_files.scan_raw_parts(spark, folder + "-none", skip_missing=True)


def test_head_per_part(spark):
    parts = [spark.range(i, 100, 2).toDF("id") for i in (0, 1)]
    assert sorted(r.id for r in history_files.scan_head_per_part(parts, 6, ["id"]).collect()) == [0, 1, 2, 3, 4, 5]


def test_append_continues_ids(spark, sf_dir):
    path = session.shared_dir(spark, "appts")
    a = star.appointments(spark, sf_dir)
    a.limit(50).withColumn("id", F.monotonically_increasing_id()).select(*APPOINTMENTS_SCHEMA.fieldNames()).write.parquet(path)
    before = spark.read.parquet(path).agg(F.max("id")).first()[0]
    batch = a.limit(30).select(*[c for c in BOOKING_COLUMNS if c != "status"])
    appointments_table.append_scored_bookings(spark, path, batch, rows_per_range=7)
    added = appointments_table.scan_appointments(spark, path).filter(F.col("id") > before)
    assert sorted(r.id for r in added.collect()) == list(range(before + 1, before + 31))
    assert {r.status for r in added.collect()} == {"Scheduled"}
    assert added.filter("created_at is null").count() == 0


def test_create_keeps_rows_and_recreate_drops_them(spark):
    path = session.shared_dir(spark, "ddl")
    appointments_table.create_table(spark, "ddl_check", path)
    empty = spark.table("ddl_check")
    assert empty.count() == 0 and [f.name for f in empty.schema] == APPOINTMENTS_SCHEMA.fieldNames()
    row = spark.range(1).select(*[(F.lit(7) if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in APPOINTMENTS_SCHEMA])
    row.write.insertInto("ddl_check")
    appointments_table.create_table(spark, "ddl_check", path)
    assert spark.table("ddl_check").count() == 1
    appointments_table.create_table(spark, "ddl_check", path, recreate=True)
    assert spark.table("ddl_check").count() == 0


def test_resolve_overdue(spark):
    rows = [(1, "Scheduled", datetime(2024, 1, 1)), (2, "Scheduled", datetime(2024, 1, 1)), (3, "Scheduled", datetime(2024, 3, 1)), (4, "Completed", datetime(2024, 1, 1)), (5, "Scheduled", None)]
    df = spark.createDataFrame(rows, "id long, status string, appointment_date timestamp").withColumn(
        "appointment_date", F.col("appointment_date").cast("timestamp_ntz")
    )
    known = spark.createDataFrame([(1, "No-Show")], "id long, outcome string")
    got = appointments_table.resolve_overdue_status(df, datetime(2024, 2, 1), known, missed=F.lit(False)).orderBy("id").collect()
    assert [(r.status, r.resolved) for r in got] == [("No-Show", 1), ("Completed", 1), ("Scheduled", 0), ("Completed", 0), ("Scheduled", 0)]


def test_rewrite_resolved(spark, sf_dir):
    path, new_path = session.shared_dir(spark, "old"), session.shared_dir(spark, "new")
    star.appointments(spark, sf_dir).select(*APPOINTMENTS_SCHEMA.fieldNames()).write.parquet(path)
    as_of = datetime(1999, 6, 1, 12)
    changed = appointments_table.rewrite_resolved(spark, path, new_path, as_of)
    old, new = appointments_table.scan_appointments(spark, path), appointments_table.scan_appointments(spark, new_path)
    assert changed > 0 and new.count() == old.count()
    assert old.filter("status = 'Scheduled'").count() - new.filter("status = 'Scheduled'").count() == changed


def test_export_round_trip(spark):
    df = spark.createDataFrame([(1, 'a,"b"', 0.5), (2, None, None)], "id int, t string, p double")
    path = session.shared_dir(spark, "csv")
    exports.export_csv(df, path)
    assert exports.read_export(spark, path, df.schema).exceptAll(df).count() == 0


def test_shared_dir_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark, "x").startswith(root)
