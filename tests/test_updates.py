"""Updates in place by month, and appends that may be repeated."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from apptlens.plans import registry
from apptlens.plans.catalog import storage
from apptlens.schemas import APPOINTMENTS_SCHEMA, BOOKING_COLUMNS
from apptlens.session import materialize, shared_dir
from apptlens.sources import appointments_table, batches, monthly_table, star

AS_OF = datetime(1996, 3, 15, 12)


@pytest.fixture(scope="module")
def appointments(spark, sf_dir):
    a = star.appointments(spark, sf_dir).select(*APPOINTMENTS_SCHEMA.fieldNames())
    # Some rows without a time, overdue or not is unknown.
    lost = F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.col("appointment_date")).cast("timestamp_ntz")
    a = a.withColumn("appointment_date", lost)
    path = shared_dir(spark, "plain")
    a.write.parquet(path)
    return spark.read.schema(APPOINTMENTS_SCHEMA).parquet(path)


def monthly(spark, rows):
    path = shared_dir(spark, "months")
    monthly_table.write_months(rows, path)
    return path


def files(spark, path):
    return {(r.month, r.file) for r in monthly_table.month_files(spark, path).collect()}


def test_only_months_with_overdue_rows_are_written(spark, appointments):
    path = monthly(spark, appointments)
    before = files(spark, path)
    changed = {r.month: r.resolved for r in monthly_table.resolve_months(spark, path, AS_OF).collect()}
    after = files(spark, path)
    assert changed and max(changed) == "1996-03"
    assert {f for f in before if f[0] not in changed} == {f for f in after if f[0] not in changed}
    assert not {f for f in before if f[0] in changed} & after
    got = monthly_table.read_months(spark, path).drop("month")
    want = appointments_table.resolve_overdue_status(appointments, AS_OF).drop("resolved")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    due = appointments.filter(appointments_table.overdue_condition(AS_OF)).count()
    assert sum(changed.values()) == due
    # Nothing is left to do, and nothing is written.
    assert monthly_table.resolve_months(spark, path, AS_OF).isEmpty()
    assert files(spark, path) == after


def test_months_after_the_day_are_not_read(spark, appointments):
    path = monthly(spark, appointments)
    due = monthly_table.overdue_months(monthly_table.read_months(spark, path), AS_OF)
    plan = due._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "month" in filters[: filters.index("PushedFilters")]
    assert "EqualTo(status,Scheduled)" in filters


def test_known_outcomes(spark, appointments):
    path = monthly(spark, appointments)
    due = appointments.filter(appointments_table.overdue_condition(AS_OF))
    known = due.filter("id % 2 = 0").select("id", F.lit("No-Show").alias("outcome"))
    monthly_table.resolve_months(spark, path, AS_OF, known, missed=F.lit(False))
    status = monthly_table.read_months(spark, path).join(due.select("id"), "id").groupBy(F.col("id") % 2 == 0, "status").count()
    assert {tuple(r)[:2] for r in status.collect()} == {(True, "No-Show"), (False, "Completed")}


def test_failed_rewrite_leaves_the_table(spark, appointments):
    path = monthly(spark, appointments)
    before = files(spark, path)
    with pytest.raises(Exception, match="stop here"):
        monthly_table.resolve_months(spark, path, AS_OF, missed=F.raise_error(F.lit("stop here")))
    assert files(spark, path) == before
    rows = monthly_table.read_months(spark, path).drop("month")
    assert rows.exceptAll(appointments).isEmpty() and rows.count() == appointments.count()


def test_monthly_table_in_sql(spark, appointments):
    path = monthly(spark, appointments)
    monthly_table.create_monthly_table(spark, "monthly_check", path)
    assert spark.table("monthly_check").count() == appointments.count()
    assert spark.sql("SHOW PARTITIONS monthly_check").count() == appointments.select(F.date_format("appointment_date", "yyyy-MM")).distinct().count()
    monthly_table.create_monthly_table(spark, "monthly_check", path)
    assert spark.table("monthly_check").count() == appointments.count()


def bookings(rows):
    return rows.select(*[c for c in BOOKING_COLUMNS if c != "status"])


@pytest.fixture()
def stored(spark, appointments):
    path = shared_dir(spark, "batches")
    batches.create_batches(spark, path, appointments.limit(200))
    return path


def per_batch(spark, path):
    return {r["batch"]: (r["n"], r["ids"]) for r in batches.read_batches(spark, path).groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).collect()}


def test_the_same_batch_is_stored_once(spark, appointments, stored):
    batch = bookings(appointments.limit(60))
    assert batches.append_batch(spark, stored, batch, "a", rows_per_range=7)
    assert not batches.append_batch(spark, stored, batch, "a")
    assert batches.append_batch(spark, stored, batch, "b")
    assert batches.append_batch(spark, stored, batch.limit(0), "none")
    assert not batches.append_batch(spark, stored, batch, "none")
    assert not batches.append_batch(spark, stored, batch, batches.INITIAL)
    assert per_batch(spark, stored) == {"initial": (200, 200), "a": (60, 60), "b": (60, 60)}
    rows = batches.read_batches(spark, stored)
    assert rows.select("id").distinct().count() == rows.count() == 320
    new = rows.filter("batch <> 'initial'")
    assert {r.status for r in new.select("status").distinct().collect()} == {"Scheduled"}
    assert new.filter("created_at is null").isEmpty()
    assert [c for c in rows.columns if c != "batch"] == APPOINTMENTS_SCHEMA.fieldNames()


def test_new_ranges_lie_above_old_ids(spark, appointments, stored):
    batches.append_batch(spark, stored, bookings(appointments.limit(5)), "a")
    rows = batches.read_batches(spark, stored)
    top = rows.filter("batch = 'initial'").agg(F.max("id")).first()[0]
    assert rows.filter("batch = 'a'").agg(F.min("id")).first()[0] > top


def test_rows_without_a_ledger_entry_are_not_read(spark, appointments, stored):
    batch = bookings(appointments.limit(30))
    lost = batches.claim_range(spark, stored, 1)
    appointments_table.complete_bookings(batch, F.lit(lost * batches.IDS_PER_RANGE)).write.parquet(f"{stored}/rows/range={lost}")
    assert per_batch(spark, stored) == {"initial": (200, 200)}
    assert batches.append_batch(spark, stored, batch, "a")
    assert per_batch(spark, stored) == {"initial": (200, 200), "a": (30, 30)}


def test_two_writers_of_one_batch(spark, appointments, stored):
    """Both looked before either was done: readers see one of the two."""
    batch = bookings(appointments.limit(30))
    batches.append_batch(spark, stored, batch, "a")
    number = batches.claim_range(spark, stored, 1)
    appointments_table.complete_bookings(batch, F.lit(number * batches.IDS_PER_RANGE)).write.parquet(f"{stored}/rows/range={number}")
    batches._commit(spark, stored, "a", number)
    assert per_batch(spark, stored) == {"initial": (200, 200), "a": (30, 30)}
    assert batches.read_ledger(spark, stored).filter("batch = 'a'").first()["range"] < number


def test_writers_at_once_get_different_ranges(spark, stored):
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: batches.claim_range(spark, stored, 3), range(24)))
    assert len(set(got)) == 24 and min(got) >= 3


def test_batches_written_at_once(spark, appointments, stored):
    batch = bookings(appointments.limit(20))
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(lambda k: batches.append_batch(spark, stored, batch, f"b{k}"), range(4)))
    rows = batches.read_batches(spark, stored)
    assert rows.count() == rows.select("id").distinct().count() == 280


def test_empty_start(spark, appointments):
    path = shared_dir(spark, "batches")
    batches.create_batches(spark, path)
    assert batches.read_batches(spark, path).isEmpty()
    batches.append_batch(spark, path, bookings(appointments.limit(3)), "first")
    assert per_batch(spark, path) == {"first": (3, 3)}


@pytest.mark.parametrize("name", ["append_scored_bookings", "append_booking_batches"])
def test_registered_appends_join_their_bookings_once(spark, sf_dir, monkeypatch, name):
    stored, scans = [], []
    monkeypatch.setattr(storage, "materialize", lambda df, purpose, *run: stored.append(purpose) or materialize(df, purpose, *run))
    number = appointments_table.row_numbers
    monkeypatch.setattr(appointments_table, "row_numbers", lambda rows, *a: scans.append(rows._jdf.queryExecution().executedPlan().toString()) or number(rows, *a))
    assert registry.QUERIES[name](spark, sf_dir).count() == 3
    assert stored == ["due"] and scans
    assert all("Join" not in plan for plan in scans)
