"""Scans, sinks and table maintenance. Files go to the shared folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from apptlens.operators import evaluate, filters, profile
from apptlens.plans.catalog.modeling import fitted
from apptlens.plans.registry import moment, query, r10
from apptlens.schemas import APPOINTMENTS_SCHEMA, BOOKING_COLUMNS
from apptlens.session import WIDE, materialize, settings, shared_dir
from apptlens.sources import appointments_table, artifacts, batches, exports, history_files, monthly_table, star

AS_OF = datetime(1999, 6, 1, 12, 0, 0)


def _write_parts(spark, d) -> str:
    """The whole history as four CSV parts."""
    folder = shared_dir(spark, "history")
    raw = star.raw_history(spark, d)
    for i, name in enumerate(history_files.PART_NAMES):
        history_files.write_part(raw.filter(F.pmod("ENCNTR", F.lit(4)) == i), f"{folder}/{name}")
    return folder


@query(
    "scan_raw_parts",
    """SELECT UNIQUE_ID, ENCNTR, APPT, APPT_STATUS, QUALIFYING_FLAG, ENCNTR_TYPE, SCH_CANCEL_LEAD_HOURS, CANCEL_TO_APPT_LEAD_HOURS, LEAD_TIME_DAYS, AGE,
       APPT_DOW, APPT_HOUR, DURATION, LANGUAGE, REFERRING_PHYSICIAN, strftime(EVENT_TIME, '%Y-%m-%d %H:%M:%S') AS event_at FROM raw""",
)
def _(spark, d):
    rows = history_files.scan_raw_parts(spark, _write_parts(spark, d), [*history_files.PART_NAMES, "Data_part_e.csv"], skip_missing=True)
    return rows.select(
        "UNIQUE_ID", "ENCNTR", "APPT", "APPT_STATUS", "QUALIFYING_FLAG", "ENCNTR_TYPE", "SCH_CANCEL_LEAD_HOURS", "CANCEL_TO_APPT_LEAD_HOURS",
        "LEAD_TIME_DAYS", "AGE", "APPT_DOW", "APPT_HOUR", "DURATION", "LANGUAGE", "REFERRING_PHYSICIAN", moment("EVENT_TIME").alias("event_at"),
    )


@query(
    "scan_head_per_part",
    """WITH r AS (SELECT APPT AS id, ENCNTR % 4 AS part, row_number() OVER (PARTITION BY ENCNTR % 4 ORDER BY EVENT_TIME, APPT) AS k FROM raw)
       SELECT id, part FROM r WHERE k <= 5000""",
)
def _(spark, d):
    raw = star.raw_history(spark, d, "APPT", "ENCNTR", "EVENT_TIME")
    raw = raw.withColumn("part", F.pmod("ENCNTR", F.lit(4)))
    heads = history_files.scan_head_per_part([raw.filter(F.col("part") == i) for i in range(4)], 20_000, ["EVENT_TIME", "APPT"])
    return heads.select(F.col("APPT").alias("id"), "part")


@query(
    "scan_appointments",
    """SELECT id, CASE WHEN id % 1000 = 7 THEN NULL ELSE predicted_risk_prob END AS predicted_risk_prob, status FROM appts""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "predicted_risk_prob", "status")
    text = F.when(F.pmod("id", F.lit(1000)) == 7, "n/a").otherwise(F.col("predicted_risk_prob").cast("string"))
    return appointments_table.coerce_scores(a.withColumn("predicted_risk_prob", text))


@query(
    "append_scored_bookings",
    """SELECT status, count(*) AS n, count(*) AS ids, count(*) AS stamped FROM appts GROUP BY status""",
)
def _(spark, d):
    """Resolved rows are the table; the scheduled ones are appended to it."""
    path = shared_dir(spark, "appointments")
    a = star.appointments(spark, d)
    with settings(spark, WIDE):
        a.filter("status <> 'Scheduled'").write.parquet(path)
    # Numbering reads the batch several times; stored, its joins are made once.
    batch = materialize(a.filter("status = 'Scheduled'").select(*BOOKING_COLUMNS).drop("status"), "due", WIDE)
    appointments_table.append_scored_bookings(spark, path, batch, rows_per_range=5_000)
    table = appointments_table.scan_appointments(spark, path)
    per_id = table.groupBy("id").agg(F.count("*").alias("n"), F.max("status").alias("status"), F.count("created_at").alias("stamped"))
    return per_id.groupBy("status").agg(F.sum("n").alias("n"), F.count("*").alias("ids"), F.sum("stamped").alias("stamped"))


@query(
    "append_booking_batches",
    """SELECT CASE WHEN status <> 'Scheduled' THEN 'initial' WHEN id % 3 = 0 THEN 'third' ELSE 'rest' END AS batch,
       count(*) AS n, count(*) AS ids, count(*) AS in_range FROM appts GROUP BY ALL""",
)
def _(spark, d):
    """Two batches on top of the resolved rows. One is sent twice; the other first by a writer that never commits."""
    path = shared_dir(spark, "batches")
    a = star.appointments(spark, d)
    batches.create_batches(spark, path, a.filter("status <> 'Scheduled'"))
    # Numbering reads every batch several times; stored, their joins are made once.
    due = materialize(a.filter("status = 'Scheduled'").select("id", *BOOKING_COLUMNS), "due", WIDE)
    third, rest = (due.filter(c).select(*BOOKING_COLUMNS) for c in ("id % 3 = 0", "id % 3 <> 0"))
    batches.append_batch(spark, path, third, "third", rows_per_range=5_000)
    lost = batches.claim_range(spark, path, 1)
    with settings(spark, WIDE):
        appointments_table.complete_bookings(rest, F.lit(lost * batches.IDS_PER_RANGE)).write.parquet(f"{path}/rows/range={lost}")
    for rows, name in ((rest, "rest"), (third, "third"), (rest, "rest")):
        batches.append_batch(spark, path, rows, name, rows_per_range=5_000)
    stored = batches.read_batches(spark, path)
    ledger = batches.read_ledger(spark, path).select(F.col("batch").alias("b"), F.col("range") * batches.IDS_PER_RANGE, "last_id").toDF("b", "first", "last_id")
    inside = (F.col("id") > F.col("first")) & (F.col("id") <= F.col("last_id"))
    per_id = stored.join(ledger, F.col("batch") == F.col("b")).groupBy("batch", "id").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"))
    return per_id.groupBy("batch").agg(F.sum("n").alias("n"), F.count("*").alias("ids"), F.sum("inside").alias("in_range"))


@query("ddl_appointments", "SELECT status, count(*) AS n, 20 AS columns FROM appts GROUP BY status")
def _(spark, d):
    """Create, load, and create again: the second statement keeps the rows."""
    path = shared_dir(spark, "table")
    name = "appointments_" + path[-12:]
    appointments_table.create_table(spark, name, path)
    star.appointments(spark, d).select(*APPOINTMENTS_SCHEMA.fieldNames()).write.mode("append").insertInto(name)
    appointments_table.create_table(spark, name, path)
    table = spark.table(name)
    return table.groupBy("status").agg(F.count("*").alias("n")).withColumn("columns", F.lit(len(table.columns)))


_WORKLIST = "risk_level IN ('High', 'Very High') AND status = 'Scheduled'"


@query(
    "export_worklist_csv",
    f"SELECT id, patient_id, strftime(appointment_date, '%Y-%m-%d %H:%M:%S') AS at, risk_level, predicted_risk_prob FROM appts WHERE {_WORKLIST}",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "patient_id", "appointment_date", "risk_level", "predicted_risk_prob", "status")
    worklist = filters.filter_tier_in(a).filter("status = 'Scheduled'").drop("status")
    path = shared_dir(spark, "worklist")
    exports.export_csv(worklist, path)
    back = exports.read_export(spark, path, worklist.schema)
    return back.select("id", "patient_id", moment("appointment_date").alias("at"), "risk_level", "predicted_risk_prob")


@query(
    "export_threshold_csv",
    """WITH t AS (SELECT k / 20.0e0 AS threshold, count(*) FILTER (WHERE y = 1 AND p >= k / 20.0e0) * 1.0e0 AS tp, count(*) FILTER (WHERE p >= k / 20.0e0) AS flagged,
         (SELECT sum(y) FROM scored) AS np, count(*) AS total FROM scored, range(21) r(k) GROUP BY r.k),
       m AS (SELECT threshold, (tp + (total - np) - (flagged - tp)) / total AS accuracy, CASE WHEN flagged > 0 THEN tp / flagged ELSE 0.0e0 END AS precision, tp / np AS recall FROM t)
       SELECT threshold, round(accuracy, 10) AS accuracy, round(precision, 10) AS precision, round(recall, 10) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0e0 END, 10) AS f1_score FROM m""",
)
def _(spark, d):
    sweep = evaluate.threshold_sweep_grid(star.scored(spark, d))
    path = shared_dir(spark, "thresholds")
    exports.export_csv(sweep, path)
    back = exports.read_export(spark, path, sweep.schema)
    return back.withColumns({c: r10(c) for c in ("accuracy", "precision", "recall", "f1_score")})


@query("persist_model_artifacts")
def _(spark, d):
    """Scores of the test part by the saved and reloaded model, next to the original ones."""
    trained = fitted(spark, d)
    path = shared_dir(spark, "artifacts")
    background = trained.table.filter("part = 'train'").orderBy(F.xxhash64("id"), "id").limit(100)
    artifacts.save_artifacts(
        spark, path, trained.model, trained.encoders, {"metrics": trained.metrics(), "background": background}
    )
    model, _ = artifacts.load_artifacts(spark, path)
    again = model.score(trained.table.filter("part = 'test'")).select("id", F.col("p").alias("p_reloaded"))
    both = trained.test_scores.join(again, "id")
    return both.agg(F.count("*").alias("rows"), F.max(F.abs(F.col("p") - F.col("p_reloaded"))).alias("largest_difference"))


@query(
    "resolve_overdue_status",
    """SELECT id, CASE WHEN o THEN CASE WHEN id % 100 < 10 THEN 'No-Show' ELSE 'Completed' END ELSE status END AS status, CAST(o AS INTEGER) AS resolved
       FROM (SELECT id, status, status = 'Scheduled' AND appointment_date < TIMESTAMP '1999-06-01 12:00:00' AS o FROM appts)""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "status", "appointment_date")
    missed = F.pmod("id", F.lit(100)) < 10
    return appointments_table.resolve_overdue_status(a, AS_OF, missed=missed).select("id", "status", "resolved")


MID_TABLE = datetime(1997, 1, 1, 12, 0, 0)


@query(
    "resolve_overdue_months",
    """WITH r AS (SELECT *, strftime(appointment_date, '%Y-%m') AS month, status = 'Scheduled' AND appointment_date < TIMESTAMP '1997-01-01 12:00:00' AS o FROM appts),
       s AS (SELECT *, CASE WHEN o THEN CASE WHEN id % 100 < 10 THEN 'No-Show' ELSE 'Completed' END ELSE status END AS now FROM r)
       SELECT month, count(*) AS n, count(*) FILTER (WHERE now = 'Scheduled') AS scheduled, count(*) FILTER (WHERE now = 'No-Show') AS no_shows,
       count(*) FILTER (WHERE o) AS resolved, count(*) FILTER (WHERE o) > 0 AS rewritten FROM s GROUP BY month""",
)
def _(spark, d):
    """The monthly table before and after; a month counts as rewritten if none of its old files is left."""
    path = shared_dir(spark, "months")
    monthly_table.write_months(star.appointments(spark, d), path)
    before = materialize(monthly_table.month_files(spark, path), "files")
    changed = monthly_table.resolve_months(spark, path, MID_TABLE, missed=F.pmod("id", F.lit(100)) < 10)
    now = monthly_table.month_files(spark, path).withColumn("kept", F.lit(1))
    kept = before.join(now, ["month", "file"], "left").groupBy("month").agg(F.max("kept").isNull().alias("rewritten"))
    counts = monthly_table.read_months(spark, path).groupBy("month").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(c) for s, c in (("Scheduled", "scheduled"), ("No-Show", "no_shows"))]
    )
    out = counts.join(changed, "month", "left").join(kept, "month")
    return out.select("month", "n", "scheduled", "no_shows", F.coalesce("resolved", F.lit(0)).cast("long").alias("resolved"), "rewritten")


@query(
    "schema_listing",
    """SELECT CAST(k AS INTEGER) AS position, c AS "column", t AS data_type, (SELECT count(*) FROM appts) AS rows FROM (SELECT
       unnest(range(6)) AS k, unnest(['id', 'patient_id', 'age', 'predicted_risk_prob', 'status', 'appointment_date']) AS c,
       unnest(['bigint', 'string', 'int', 'double', 'string', 'timestamp_ntz']) AS t)""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "patient_id", "age", "predicted_risk_prob", "status", "appointment_date")
    return profile.schema_listing(a)
