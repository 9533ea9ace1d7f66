"""Filters, joins, set operations, sorts and limits."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from apptlens.functions import temporal, tiers
from apptlens.operators import encode, evaluate, filters, history, kpi, splits, trend
from apptlens.plans.registry import day, moment, query, r10
from apptlens.schemas import NULLABLE_RAW
from apptlens.session import materialize, shared_dir
from apptlens.sources import history_files, star
from apptlens.sources.history_state import HistoryState

AS_OF = datetime(1999, 6, 1, 12, 0, 0)


def _spread(column: str):
    """An arithmetic shuffling order that both engines compute alike."""
    return F.pmod(F.col(column), F.lit(2147483647)) * 48271 % 2147483647


# --- filters -----------------------------------------------------------------


@query("filter_nonneg_lead", "SELECT APPT AS id, LEAD_TIME_DAYS AS lead FROM raw WHERE LEAD_TIME_DAYS >= 0")
def _(spark, d):
    r = filters.filter_nonneg_lead(star.raw_history(spark, d, "APPT", "LEAD_TIME_DAYS"))
    return r.select(F.col("APPT").alias("id"), F.col("LEAD_TIME_DAYS").alias("lead"))


@query(
    "drop_missing",
    """SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST(count(*) FILTER (WHERE APPT_STATUS IS NOT NULL AND REFERRING_PHYSICIAN IS NOT NULL) AS BIGINT) AS rows_after,
       CAST(count(*) FILTER (WHERE APPT_STATUS IS NULL OR REFERRING_PHYSICIAN IS NULL) AS BIGINT) AS rows_dropped,
       (SELECT count(*) FROM raw WHERE APPT_STATUS IS NOT NULL AND REFERRING_PHYSICIAN IS NOT NULL) AS kept_rows FROM raw""",
)
def _(spark, d):
    r = star.raw_history(spark, d)
    kept = filters.drop_missing(r, NULLABLE_RAW).agg(F.count("*").alias("kept_rows"))
    return filters.missing_report(r, NULLABLE_RAW).withColumn("kept_rows", kept.scalar())


@query("filter_tier_in", "SELECT id, risk_level FROM appts WHERE risk_level IN ('High', 'Very High')")
def _(spark, d):
    return filters.filter_tier_in(star.appointments(spark, d, "id", "risk_level"))


@query(
    "filter_date_range",
    """SELECT id, strftime(appointment_date, '%Y-%m-%d %H:%M:%S') AS at FROM appts
       WHERE CAST(appointment_date AS DATE) BETWEEN DATE '1998-03-15' AND DATE '1999-06-01'""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date")
    return filters.filter_date_range(a, date(1998, 3, 15), date(1999, 6, 1)).select("id", moment("appointment_date").alias("at"))


@query(
    "filter_multi_select",
    """SELECT id, risk_level, status FROM appts WHERE risk_level IN ('Low', 'High') AND status IN ('Scheduled', 'No-Show')
       AND primary_plan_type IN ('BUILDING', 'FURNITURE')""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "risk_level", "status", "primary_plan_type")
    chosen = {"risk_level": ["Low", "High"], "primary_plan_type": ["BUILDING", "FURNITURE"]}
    return filters.filter_multi_select(a, chosen, {"status": ["Scheduled", "No-Show"]}).drop("primary_plan_type")


@query("search_patient", "SELECT id, patient_id FROM appts WHERE regexp_matches(patient_id, 'p0+1.2', 'i')")
def _(spark, d):
    return filters.search_patient(star.appointments(spark, d, "id", "patient_id"), " p0+1.2 ")


@query(
    "upcoming_high_risk",
    """SELECT id, patient_id, strftime(appointment_date, '%Y-%m-%d %H:%M:%S') AS at, risk_level, predicted_risk_prob FROM appts
       WHERE risk_level IN ('High', 'Very High') AND status = 'Scheduled' AND CAST(appointment_date AS DATE) >= DATE '1999-06-01'
       ORDER BY appointment_date, id LIMIT 6""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "patient_id", "appointment_date", "risk_level", "predicted_risk_prob", "status")
    return filters.upcoming_high_risk(a, AS_OF).select(
        "id", "patient_id", moment("appointment_date").alias("at"), "risk_level", "predicted_risk_prob"
    )


@query(
    "urgent_48h",
    """SELECT id, strftime(appointment_date, '%Y-%m-%d %H:%M:%S') AS at FROM appts
       WHERE risk_level IN ('High', 'Very High') AND status = 'Scheduled' AND CAST(appointment_date AS DATE) <= DATE '1999-06-03'""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date", "risk_level", "status")
    return filters.urgent_48h(a, AS_OF).select("id", moment("appointment_date").alias("at"))


@query(
    "provider_drilldown",
    "SELECT id, patient_id, risk_level, predicted_risk_prob, status FROM appts WHERE attending_physician = 'D0000000007'",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "patient_id", "risk_level", "predicted_risk_prob", "status", "attending_physician")
    return filters.provider_drilldown(a, "D0000000007").drop("attending_physician")


@query("point_lookup", "SELECT id, patient_id, status FROM appts WHERE patient_id = 'P0000000042'")
def _(spark, d):
    return filters.point_lookup(star.appointments(spark, d, "id", "patient_id", "status"), "patient_id", "P0000000042")


@query("filter_outcome_capped", "SELECT APPT AS id, LEAD_TIME_DAYS AS lead FROM labeled WHERE target = 1 AND LEAD_TIME_DAYS <= 180")
def _(spark, d):
    from apptlens.functions.cleaning import binary_target

    r = star.raw_history(spark, d, "APPT", "APPT_STATUS", "LEAD_TIME_DAYS")
    r = r.select(F.col("APPT").alias("id"), binary_target(F.col("APPT_STATUS")).alias("target"), F.col("LEAD_TIME_DAYS").alias("lead"))
    return filters.filter_outcome_capped(r, "target", 1, "lead").drop("target")


@query("filter_predicted_positive", "SELECT id, p FROM scored WHERE p >= 0.5e0")
def _(spark, d):
    return filters.filter_predicted_positive(star.scored(spark, d)).select("id", "p")


@query(
    "overdue_scheduled",
    "SELECT id FROM appts WHERE status = 'Scheduled' AND appointment_date < TIMESTAMP '1999-06-01 12:00:00'",
)
def _(spark, d):
    return filters.overdue_scheduled(star.appointments(spark, d, "id", "status", "appointment_date"), AS_OF).select("id")


# --- joins -------------------------------------------------------------------


@query(
    "enrich_history",
    """WITH pt AS (SELECT patient_id, count(*) AS n, count(*) FILTER (WHERE status = 'No-Show') AS k FROM appts WHERE status <> 'Completed' GROUP BY ALL),
       pr AS (SELECT attending_physician, count(*) AS n, count(*) FILTER (WHERE status = 'No-Show') AS k FROM appts WHERE status <> 'Completed' GROUP BY ALL)
       SELECT id, coalesce(pt.n, 0) AS patient_visits, round(coalesce(pt.k * 1.0e0 / pt.n, 0.0e0), 10) AS patient_rate,
       round(coalesce(pr.k * 1.0e0 / pr.n, 0.211e0), 10) AS provider_rate
       FROM appts LEFT JOIN pt USING (patient_id) LEFT JOIN pr USING (attending_physician)""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "patient_id", "attending_physician", "status")
    known = a.filter(F.col("status") != "Completed")
    out = history.enrich_history(a, known, hot_rows=650)
    return out.select("id", "patient_visits", r10("patient_rate").alias("patient_rate"), r10("provider_rate").alias("provider_rate"))


@query(
    "enrich_history_asof",
    """WITH h AS (SELECT patient_id, attending_physician, appointment_date AS at, CASE WHEN status = 'No-Show' THEN 1 ELSE 0 END AS k FROM appts WHERE status <> 'Scheduled'),
       pt AS (SELECT a.id, count(*) AS n, sum(k) AS k FROM appts a JOIN h ON h.patient_id = a.patient_id AND h.at < a.booking_date GROUP BY a.id),
       pr AS (SELECT a.id, count(*) AS n, sum(k) AS k FROM appts a JOIN h ON h.attending_physician = a.attending_physician AND h.at < a.booking_date GROUP BY a.id)
       SELECT id, coalesce(pt.n, 0) AS patient_visits, round(coalesce(pt.k * 1.0e0 / pt.n, 0.0e0), 10) AS patient_rate,
       round(coalesce(pr.k * 1.0e0 / pr.n, 0.211e0), 10) AS provider_rate FROM appts LEFT JOIN pt USING (id) LEFT JOIN pr USING (id)""",
)
def _(spark, d):
    """Resolved rows before the booking was made; providers are cut into ranges of time."""
    a = star.appointments(spark, d, "id", "patient_id", "attending_physician", "status", "appointment_date", "booking_date")
    # Bookings and history are read several times; stored, they are joined once.
    a = materialize(a, "appointments")
    asked = a.select("id", "patient_id", "attending_physician", "booking_date")
    out = history.enrich_history(asked, a, resolved_only=True, before="booking_date", rows_per_range=5_000)
    return out.select("id", "patient_visits", r10("patient_rate").alias("patient_rate"), r10("provider_rate").alias("provider_rate"))


@query(
    "enrich_history_state",
    """WITH pt AS (SELECT patient_id, count(*) AS n, count(*) FILTER (WHERE status = 'No-Show') AS k FROM appts GROUP BY ALL),
       pr AS (SELECT attending_physician, count(*) AS n, count(*) FILTER (WHERE status = 'No-Show') AS k FROM appts GROUP BY ALL)
       SELECT id, coalesce(pt.n, 0) AS patient_visits, round(coalesce(pt.k * 1.0e0 / pt.n, 0.0e0), 10) AS patient_rate,
       round(coalesce(pr.k * 1.0e0 / pr.n, 0.211e0), 10) AS provider_rate FROM appts LEFT JOIN pt USING (patient_id) LEFT JOIN pr USING (attending_physician)""",
)
def _(spark, d):
    """Counts kept up to a week before the end, then three refreshes and a merge; the lookup reads only them."""
    a = star.appointments(spark, d, "id", "patient_id", "attending_physician", "status", "appointment_date")
    last = a.agg(F.to_date(F.max("appointment_date"))).first()[0]
    state = HistoryState(spark, shared_dir(spark, "history-state"))
    state.rebuild(a, last - timedelta(days=7))
    for back in (4, 1, 0):
        # What the table holds on that day.
        state.refresh(a.filter(F.to_date("appointment_date") <= F.lit(last - timedelta(days=back))))
    state.compact(last - timedelta(days=5))
    out = state.enrich(a, hot_rows=650)
    return out.select("id", "patient_visits", r10("patient_rate").alias("patient_rate"), r10("provider_rate").alias("provider_rate"))


@query("group_transform", "SELECT id, count(*) OVER (PARTITION BY attending_physician) AS provider_rows FROM appts")
def _(spark, d):
    a = star.appointments(spark, d, "id", "attending_physician")
    return history.total_visit_count(a, "attending_physician", "id", "provider_rows", hot_rows=620).drop("attending_physician")


_SPLIT_SQL = """patients AS (SELECT DISTINCT patient_id, CAST(substr(patient_id, 2) AS BIGINT) AS k FROM appts),
  ranked AS (SELECT patient_id, row_number() OVER (ORDER BY k % 2147483647 * 48271 % 2147483647, patient_id) AS r, count(*) OVER () AS n FROM patients),
  sides AS (SELECT patient_id, CASE WHEN r <= ceil(n * 0.25e0) THEN 'test' ELSE 'train' END AS side FROM ranked)"""


def _sides(spark, d):
    a = star.appointments(spark, d, "patient_id")
    number = F.substring("patient_id", 2, 20).cast("long")
    order = F.pmod(number, F.lit(2147483647)) * 48271 % 2147483647
    return splits.split_by_group(a, "patient_id", order)


@query("semi_join_patients", f"WITH {_SPLIT_SQL} SELECT id, patient_id FROM appts WHERE patient_id IN (SELECT patient_id FROM sides WHERE side = 'test')")
def _(spark, d):
    test = _sides(spark, d).filter(F.col("side") == "test")
    return splits.semi_join_groups(star.appointments(spark, d, "id", "patient_id"), test, "patient_id").select("id", "patient_id")


@query(
    "assert_disjoint",
    f"""WITH {_SPLIT_SQL} SELECT count(*) AS overlap FROM (SELECT patient_id FROM sides WHERE side = 'test' INTERSECT
        SELECT patient_id FROM sides WHERE side = 'train')""",
)
def _(spark, d):
    sides = _sides(spark, d)
    return splits.overlap_count(sides.filter("side = 'test'"), sides.filter("side = 'train'"), "patient_id")


@query(
    "reindex_to_skeleton",
    """SELECT t.risk_level, CAST(t.tier_order AS INTEGER) AS tier_order, n FROM (VALUES ('Very Low', 1), ('Low', 2), ('Moderate', 3), ('High', 4), ('Very High', 5)) t(risk_level, tier_order)
       LEFT JOIN (SELECT risk_level, count(*) AS n FROM appts WHERE predicted_risk_prob >= 0.15 GROUP BY ALL) USING (risk_level)""",
)
def _(spark, d):
    a = star.appointments(spark, d, "risk_level", "predicted_risk_prob").filter(F.col("predicted_risk_prob") >= 0.15)
    return kpi.reindex_to_tiers(a.groupBy("risk_level").agg(F.count("*").alias("n")), keep_empty=True)


_CAL_SQL = """cal AS (SELECT CAST(appointment_date AS DATE) AS date_only, year(date_only) AS yr, week(date_only) AS wk, isodow(date_only) - 1 AS dow,
    CAST(yr AS VARCHAR) || '-W' || lpad(CAST(wk AS VARCHAR), 2, '0') AS year_week,
    strftime(date_trunc('week', date_only), '%b %d') || ' – ' || strftime(date_trunc('week', date_only) + INTERVAL 6 DAY, '%b %d') AS week_label,
    avg(predicted_risk_prob) AS value FROM appts GROUP BY CAST(appointment_date AS DATE))"""


def _calendar(spark, d):
    a = star.appointments(spark, d, "appointment_date", "predicted_risk_prob")
    return trend.with_week_keys(trend.calendar_values(a, "avg_risk"))


@query(
    "lookup_last_wins",
    f"""WITH {_CAL_SQL}, firsts AS (SELECT year_week, week_label, min(dow * 100000 + (date_only - DATE '1990-01-01')) AS seen FROM cal GROUP BY ALL)
        SELECT year_week, arg_max(week_label, seen) AS week_label FROM firsts GROUP BY year_week""",
)
def _(spark, d):
    return trend.week_labels(_calendar(spark, d))


@query(
    "cell_lookup",
    f"""WITH {_CAL_SQL} SELECT CAST(dow AS INTEGER) AS day_of_week, year_week, round(avg(value), 10) AS value,
        strftime(min(date_only), '%Y-%m-%d') AS first_date FROM cal GROUP BY ALL""",
)
def _(spark, d):
    cells = trend.cell_values(_calendar(spark, d))
    return cells.select("day_of_week", "year_week", r10("value").alias("value"), day("first_date").alias("first_date"))


@query(
    "threshold_cross_join",
    """SELECT t.k / 20.0e0 AS threshold, count(*) FILTER (WHERE y = 1 AND p >= t.k / 20.0e0) AS tp, count(*) FILTER (WHERE y = 0 AND p >= t.k / 20.0e0) AS fp,
       count(*) FILTER (WHERE y = 1 AND p < t.k / 20.0e0) AS fn, count(*) FILTER (WHERE y = 0 AND p < t.k / 20.0e0) AS tn
       FROM scored, range(21) t(k) GROUP BY t.k""",
)
def _(spark, d):
    return evaluate.threshold_counts(star.scored(spark, d), [k / 20 for k in range(21)])


@query(
    "band_range_join",
    """SELECT id, t.risk_level, t.lo, t.hi FROM scored JOIN (VALUES ('Very Low', 0.0e0, 0.10e0), ('Low', 0.10e0, 0.20e0), ('Moderate', 0.20e0, 0.35e0),
       ('High', 0.35e0, 0.55e0), ('Very High', 0.55e0, 1.001e0)) t(risk_level, lo, hi) ON p >= lo AND p < hi""",
)
def _(spark, d):
    rows = star.scored(spark, d).select("id", tiers.risk_tier(F.col("p"), tiers.STUDY_EDGES).alias("risk_level"))
    bands = tiers.tier_dimension(spark, tiers.STUDY_EDGES).select("risk_level", "lo", "hi")
    return rows.join(F.broadcast(bands), "risk_level").select("id", "risk_level", "lo", "hi")


@query(
    "zip_names_values",
    """SELECT id, feature, value FROM (SELECT id, 'age' AS feature, CAST(age AS DOUBLE) AS value FROM appts UNION ALL
       SELECT id, 'score', predicted_risk_prob FROM appts)""",
)
def _(spark, d):
    from apptlens.operators.explain import zip_names_values

    a = star.appointments(spark, d, "id", "age", "predicted_risk_prob")
    a = a.select("id", F.array(F.col("age").cast("double"), "predicted_risk_prob").alias("values"))
    return zip_names_values(a, ["age", "score"], "values", keep=["id"])


# --- sorts and limits --------------------------------------------------------


@query("sort_by_date", "SELECT id, strftime(appointment_date, '%Y-%m-%d %H:%M:%S') AS at FROM appts")
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date")
    return filters.sort_by_date(a).select("id", moment("appointment_date").alias("at"))


@query(
    "topk_upcoming",
    """SELECT id, strftime(appointment_date, '%Y-%m-%d %H:%M:%S') AS at FROM appts WHERE status = 'Scheduled' ORDER BY appointment_date, id LIMIT 6""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date", "status").filter("status = 'Scheduled'")
    return filters.sort_by_date(a).limit(6).select("id", moment("appointment_date").alias("at"))


@query(
    "topk_recent",
    """SELECT id, patient_id, strftime(booking_date, '%Y-%m-%d %H:%M:%S') AS booked, strftime(appointment_date, '%Y-%m-%d %H:%M:%S') AS at, risk_level,
       predicted_risk_prob, status FROM appts ORDER BY appointment_date DESC, id LIMIT 10""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "patient_id", "booking_date", "appointment_date", "risk_level", "predicted_risk_prob", "status")
    return filters.topk_recent(a).select(
        "id", "patient_id", moment("booking_date").alias("booked"), moment("appointment_date").alias("at"), "risk_level", "predicted_risk_prob", "status"
    )


# --- set operations ----------------------------------------------------------


@query("union_all_parts", "SELECT id, status FROM appts")
def _(spark, d):
    a = star.appointments(spark, d, "id", "status")
    return history_files.union_all_parts([a.filter(F.col("status") == s) for s in ("Scheduled", "Completed", "No-Show")])


@query("distinct_pairs", f"WITH {_CAL_SQL} SELECT DISTINCT year_week, week_label FROM cal")
def _(spark, d):
    return trend.distinct_pairs(_calendar(spark, d))


@query(
    "dedupe_ordered",
    """SELECT patient_id, min(id) AS first_seen FROM appts GROUP BY patient_id ORDER BY first_seen LIMIT 200""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "patient_id")
    return a.groupBy("patient_id").agg(F.min("id").alias("first_seen")).orderBy("first_seen").limit(200)


@query(
    "intersect_keys",
    """SELECT patient_id FROM appts WHERE status = 'No-Show' AND risk_level = 'High' INTERSECT
       SELECT patient_id FROM appts WHERE status = 'Completed' AND risk_level = 'High'""",
)
def _(spark, d):
    a = star.appointments(spark, d, "patient_id", "status", "risk_level").filter("risk_level = 'High'")
    return a.filter("status = 'No-Show'").select("patient_id").intersect(a.filter("status = 'Completed'").select("patient_id"))


@query(
    "except_columns",
    """SELECT LEAD_TIME_DAYS, AGE, APPT_DOW, APPT_HOUR, SEX, LANGUAGE, ZIPCODE3, APPT_TYPE_CODE, MEDICAL_SERVICE_CODE, FACILITY_CODE,
       NURSE_UNIT_CODE, SERVICE_LINE_USED, ATTENDING_PHYSICIAN, REFERRING_PHYSICIAN, PRIMARY_PLAN_TYPE, SEASON_BUCKET FROM raw""",
)
def _(spark, d):
    from apptlens.schemas import NON_FEATURES

    r = star.raw_history(spark, d)
    return r.select(*encode.except_columns(r.columns, NON_FEATURES))
