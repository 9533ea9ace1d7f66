"""KPIs, calendar aggregates, provider ranking and profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from apptlens.functions.cleaning import binary_target, target_class
from apptlens.operators import filters, history, kpi, profile, providers, trend
from apptlens.operators.prefix import percentiles
from apptlens.plans.registry import day, query, r6, r10
from apptlens.session import materialize
from apptlens.sources import star

_KPI = """count(*) AS total, count(*) FILTER (WHERE risk_level IN ('High', 'Very High')) AS high_risk, round(avg(predicted_risk_prob), 10) AS avg_risk,
  count(*) FILTER (WHERE status = 'No-Show') AS no_show, count(*) FILTER (WHERE status = 'Completed') AS completed"""


@query(
    "kpi_overview",
    f"""WITH k AS (SELECT {_KPI} FROM appts) SELECT *, round(high_risk * 1.0e0 / total, 10) AS high_risk_share,
        round(no_show * 1.0e0 / (no_show + completed), 10) AS no_show_rate FROM k""",
)
def _(spark, d):
    k = kpi.kpi_overview(star.appointments(spark, d, "risk_level", "predicted_risk_prob", "status"))
    return k.withColumns({c: r10(c) for c in ("avg_risk", "high_risk_share", "no_show_rate")})


@query(
    "kpi_range",
    f"SELECT {_KPI} FROM appts WHERE CAST(appointment_date AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'",
)
def _(spark, d):
    a = star.appointments(spark, d, "appointment_date", "risk_level", "predicted_risk_prob", "status")
    chosen = filters.filter_date_range(a, date(1997, 1, 1), date(1999, 12, 31))
    return kpi.kpi_range(chosen).withColumn("avg_risk", r10("avg_risk"))


@query(
    "tier_distribution",
    """SELECT risk_level, CAST(CASE risk_level WHEN 'Very Low' THEN 1 WHEN 'Low' THEN 2 WHEN 'Moderate' THEN 3 WHEN 'High' THEN 4 ELSE 5 END AS INTEGER) AS tier_order,
       count(*) AS n, round(count(*) * 1.0e0 / sum(count(*)) OVER (), 10) AS share FROM appts GROUP BY risk_level""",
)
def _(spark, d):
    return kpi.tier_distribution(star.appointments(spark, d, "risk_level")).withColumn("share", r10("share"))


@query("status_by_tier", "SELECT status, risk_level, count(*) AS n FROM appts GROUP BY ALL")
def _(spark, d):
    return kpi.status_by_tier(star.appointments(spark, d, "status", "risk_level"))


@query("status_breakdown", "SELECT status, count(*) AS n FROM appts GROUP BY ALL")
def _(spark, d):
    return kpi.status_breakdown(star.appointments(spark, d, "status"))


@query(
    "daily_trend",
    """SELECT strftime(appointment_date, '%Y-%m-%d') AS date_only, count(predicted_risk_prob) AS appts, round(avg(predicted_risk_prob), 10) AS avg_risk
       FROM appts GROUP BY ALL""",
)
def _(spark, d):
    t = trend.daily_trend(star.appointments(spark, d, "appointment_date", "predicted_risk_prob"))
    return t.select(day("date_only").alias("date_only"), "appts", r10("avg_risk").alias("avg_risk"))


_CAL = """SELECT CAST(year(appointment_date) AS INTEGER) AS year, CAST(week(appointment_date) AS INTEGER) AS week_year,
  CAST(isodow(appointment_date) - 1 AS INTEGER) AS day_of_week, strftime(appointment_date, '%Y-%m-%d') AS date_only,"""


def _calendar(spark, d, metric, *columns):
    cal = trend.calendar_values(star.appointments(spark, d, "appointment_date", *columns), metric)
    return cal.withColumn("date_only", day("date_only"))


@query("calendar_volume", f"{_CAL} count(*) AS value FROM appts GROUP BY ALL")
def _(spark, d):
    return _calendar(spark, d, "volume")


@query("calendar_avg_risk", f"{_CAL} round(avg(predicted_risk_prob), 10) AS value FROM appts GROUP BY ALL")
def _(spark, d):
    return _calendar(spark, d, "avg_risk", "predicted_risk_prob").withColumn("value", r10("value"))


@query("calendar_avg_lead", f"{_CAL} round(avg(lead_days), 10) AS value FROM appts GROUP BY ALL")
def _(spark, d):
    return _calendar(spark, d, "avg_lead", "booking_date").withColumn("value", r10("value"))


@query("calendar_active_providers", f"{_CAL} count(DISTINCT attending_physician) AS value FROM appts GROUP BY ALL")
def _(spark, d):
    return _calendar(spark, d, "providers", "attending_physician")


# Week columns are named by rule, so that the SQL text can name them too.
_WEEKS = [f"{year}-W{week:02d}" for year in range(1995, 2002) for week in range(1, 54)]
_PIVOT_COLUMNS = ", ".join(f"round(avg(value) FILTER (WHERE yw = '{w}'), 10) AS \"{w}\"" for w in _WEEKS)


@query(
    "calendar_pivot",
    f"""WITH cal AS (SELECT CAST(appointment_date AS DATE) AS dt, CAST(year(dt) AS VARCHAR) || '-W' || lpad(CAST(week(dt) AS VARCHAR), 2, '0') AS yw,
        CAST(isodow(dt) - 1 AS INTEGER) AS day_of_week, avg(predicted_risk_prob) AS value FROM appts GROUP BY CAST(appointment_date AS DATE))
        SELECT day_of_week, {_PIVOT_COLUMNS} FROM cal GROUP BY day_of_week""",
)
def _(spark, d):
    a = star.appointments(spark, d, "appointment_date", "predicted_risk_prob")
    wide = trend.calendar_pivot(trend.with_week_keys(trend.calendar_values(a, "avg_risk")), _WEEKS)
    return wide.select("day_of_week", *[r10(f"`{w}`").alias(w) for w in _WEEKS])


_STATS = """stats AS (SELECT attending_physician, count(id) AS total_patients, round(avg(predicted_risk_prob), 10) AS avg_risk_score,
  count(*) FILTER (WHERE risk_level IN ('High', 'Very High')) AS high_risk_count,
  round_even(count(*) FILTER (WHERE risk_level IN ('High', 'Very High')) * 1.0e0 / count(id) * 100, 1) AS high_risk_rate
  FROM appts GROUP BY attending_physician)"""


def _provider_stats(spark, d):
    return providers.provider_stats(star.appointments(spark, d, "id", "attending_physician", "predicted_risk_prob", "risk_level"))


@query("provider_stats", f"WITH {_STATS} SELECT * FROM stats")
def _(spark, d):
    return providers.rank_providers(_provider_stats(spark, d)).withColumn("avg_risk_score", r10("avg_risk_score"))


@query("median_of_groups", f"WITH {_STATS} SELECT quantile_cont(CAST(total_patients AS DOUBLE), 0.5) AS median_volume, round(quantile_cont(high_risk_rate, 0.5), 10) AS median_rate FROM stats")
def _(spark, d):
    m = providers.provider_medians(_provider_stats(spark, d))
    return m.select("median_volume", r10("median_rate").alias("median_rate"))


@query(
    "quadrant_flags",
    f"""WITH {_STATS}, med AS (SELECT quantile_cont(CAST(total_patients AS DOUBLE), 0.5) AS v, quantile_cont(high_risk_rate, 0.5) AS r FROM stats)
        SELECT attending_physician, total_patients, high_risk_rate, CAST(total_patients >= v AND high_risk_rate >= r AS INTEGER) AS flagged,
        CASE WHEN total_patients >= v THEN 'High Volume' ELSE 'Low Volume' END || ', ' || CASE WHEN high_risk_rate >= r THEN 'High Risk' ELSE 'Low Risk' END AS quadrant
        FROM stats, med""",
)
def _(spark, d):
    q = providers.quadrant_flags(_provider_stats(spark, d))
    return q.select("attending_physician", "total_patients", "high_risk_rate", "flagged", "quadrant")


def _labeled(spark, d, *columns):
    r = star.raw_history(spark, d, "APPT_STATUS", *columns)
    return r.withColumn("target", binary_target(F.col("APPT_STATUS"))).filter(F.col("target").isNotNull())


@query(
    "rate_by_category",
    "SELECT LANGUAGE, count(*) AS n, round(avg(target), 10) AS rate FROM labeled GROUP BY LANGUAGE ORDER BY avg(target) DESC, LANGUAGE LIMIT 15",
)
def _(spark, d):
    return profile.rate_by_category(_labeled(spark, d, "LANGUAGE"), "LANGUAGE", "target").withColumn("rate", r10("rate"))


@query(
    "rate_by_quantile_bin",
    """WITH v AS (SELECT 'lead' AS feature, LEAD_TIME_DAYS AS x, target FROM labeled UNION ALL SELECT 'hour', CAST(APPT_HOUR AS DOUBLE), target FROM labeled),
       edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM v GROUP BY feature),
       b AS (SELECT v.feature, q, x, target, greatest(1, len(list_filter(q, lambda z: z < x))) AS bin FROM v JOIN edges USING (feature))
       SELECT feature, CAST(bin AS INTEGER) AS bin, round(max(q[bin]), 10) AS lo, round(max(q[bin + 1]), 10) AS hi, count(*) AS n, round(avg(target), 10) AS rate
       FROM b GROUP BY feature, bin""",
)
def _(spark, d):
    rows = materialize(_labeled(spark, d, "LEAD_TIME_DAYS", "APPT_HOUR").select("LEAD_TIME_DAYS", "APPT_HOUR", "target"), "labeled")
    parts = [
        profile.rate_by_quantile_bin(rows, column, "target").withColumn("feature", F.lit(name))
        for name, column in (("lead", "LEAD_TIME_DAYS"), ("hour", "APPT_HOUR"))
    ]
    both = parts[0].unionByName(parts[1])
    return both.select("feature", "bin", r10("lo").alias("lo"), r10("hi").alias("hi"), "n", r10("rate").alias("rate"))


@query(
    "encounter_type_rates",
    """SELECT ENCNTR_TYPE, count(QUALIFYING_FLAG) AS total_appointments, CAST(sum(QUALIFYING_FLAG) AS BIGINT) AS success_count,
       CAST(count(QUALIFYING_FLAG) - sum(QUALIFYING_FLAG) AS BIGINT) AS not_success_count,
       round_even((count(QUALIFYING_FLAG) - sum(QUALIFYING_FLAG)) * 1.0e0 / count(QUALIFYING_FLAG) * 100, 2) AS not_success_rate FROM raw GROUP BY ENCNTR_TYPE""",
)
def _(spark, d):
    return profile.encounter_type_rates(star.raw_history(spark, d, "ENCNTR_TYPE", "QUALIFYING_FLAG"))


@query(
    "crosstab_margins",
    """WITH c AS (SELECT CASE target WHEN 1 THEN 'NOT_SUCCESS' ELSE 'SUCCESS' END AS TARGET_CLASS, QUALIFYING_FLAG AS f FROM labeled)
       SELECT coalesce(TARGET_CLASS, 'All') AS TARGET_CLASS, count(*) FILTER (WHERE f = 0) AS "0", count(*) FILTER (WHERE f = 1) AS "1", count(*) AS "All"
       FROM c GROUP BY ROLLUP (TARGET_CLASS)""",
)
def _(spark, d):
    rows = _labeled(spark, d, "QUALIFYING_FLAG").withColumn("TARGET_CLASS", target_class(F.col("APPT_STATUS")))
    return profile.crosstab_margins(rows, "TARGET_CLASS", "QUALIFYING_FLAG", [0, 1])


@query("value_counts", "SELECT APPT_STATUS, count(*) AS n FROM raw WHERE APPT_STATUS IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return profile.value_counts(star.raw_history(spark, d, "APPT_STATUS"), "APPT_STATUS")


_TEXT_COLUMNS = ["UNIQUE_ID", "APPT_STATUS", "AGE", "LANGUAGE", "REFERRING_PHYSICIAN", "SEASON_BUCKET"]
_NUMBER_COLUMNS = ["LEAD_TIME_DAYS", "APPT_HOUR", "DURATION", "SCH_CANCEL_LEAD_HOURS"]


def _union(columns, cast):
    return " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS {cast}) AS v FROM raw" for c in columns)


@query(
    "profile_categorical",
    f"""WITH l AS ({_union(_TEXT_COLUMNS, "VARCHAR")}), c AS (SELECT col, v, count(*) AS n FROM l GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS k FROM c WHERE v IS NOT NULL)
        SELECT col AS "column", 'string' AS data_type, (SELECT count(v) FROM c c2 WHERE c2.col = s.col) AS unique_count, nulls AS null_count,
        round_even(nulls * 1.0e0 / total * 100, 2) AS null_pct, (SELECT v FROM r WHERE r.col = s.col AND k = 1) AS mode,
        (SELECT n FROM r WHERE r.col = s.col AND k = 1) AS mode_frequency,
        (SELECT string_agg(v, ', ' ORDER BY k) FROM r WHERE r.col = s.col AND k <= 5) AS top_values
        FROM (SELECT col, count(*) AS total, count(*) - count(v) AS nulls FROM l GROUP BY col) s""",
)
def _(spark, d):
    return profile.profile_categorical(star.raw_history(spark, d, *_TEXT_COLUMNS), _TEXT_COLUMNS)


@query(
    "profile_numeric",
    f"""WITH l AS ({_union(_NUMBER_COLUMNS, "DOUBLE")})
        SELECT col AS "column", count(v) AS count, count(*) - count(v) AS null_count, round_even((count(*) - count(v)) * 1.0e0 / count(*) * 100, 2) AS null_pct,
        round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max, max(v) - min(v) AS range,
        round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
        quantile_cont(v, 0.75) AS q3, count(DISTINCT v) AS unique_count FROM l GROUP BY col""",
)
def _(spark, d):
    p = profile.profile_numeric(star.raw_history(spark, d, *_NUMBER_COLUMNS), _NUMBER_COLUMNS)
    return p.withColumns({c: r6(c) for c in ("mean", "std", "skewness", "kurtosis")})


@query(
    "null_counts",
    """SELECT * FROM (SELECT unnest(['APPT_STATUS', 'REFERRING_PHYSICIAN', 'SCH_CANCEL_LEAD_HOURS', 'CANCEL_TO_APPT_LEAD_HOURS', '(total)']) AS "column",
       unnest([a, b, c, e, a + b + c + e]) AS nulls FROM (SELECT count(*) - count(APPT_STATUS) AS a, count(*) - count(REFERRING_PHYSICIAN) AS b,
       count(*) - count(SCH_CANCEL_LEAD_HOURS) AS c, count(*) - count(CANCEL_TO_APPT_LEAD_HOURS) AS e FROM raw))""",
)
def _(spark, d):
    return profile.null_counts(star.raw_history(spark, d))


@query("distinct_values", "SELECT DISTINCT referring_physician FROM appts WHERE referring_physician IS NOT NULL")
def _(spark, d):
    return profile.distinct_values(star.appointments(spark, d, "referring_physician"), "referring_physician")


@query(
    "min_max_date",
    "SELECT strftime(min(appointment_date), '%Y-%m-%d') AS min_date, strftime(max(appointment_date), '%Y-%m-%d') AS max_date FROM appts",
)
def _(spark, d):
    m = profile.min_max_date(star.appointments(spark, d, "appointment_date"))
    return m.select(day("min_date").alias("min_date"), day("max_date").alias("max_date"))


@query(
    "base_rate",
    """WITH c AS (SELECT count(*) FILTER (WHERE target = 1) AS positives, count(*) FILTER (WHERE target = 0) AS negatives FROM labeled)
       SELECT *, round(positives * 1.0e0 / (positives + negatives), 10) AS base_rate, round(negatives * 1.0e0 / (positives + negatives), 10) AS show_rate,
       round_even(negatives * 1.0e0 / positives, 4) AS pos_weight FROM c""",
)
def _(spark, d):
    b = profile.base_rate(_labeled(spark, d), "target")
    return b.withColumns({c: r10(c) for c in ("base_rate", "show_rate")})


@query(
    "histogram_fixed",
    """WITH m AS (SELECT min(p) AS lo, max(p) AS hi FROM scored), b AS (SELECT least(CAST(floor((p - lo) / ((hi - lo) / 80)) AS INTEGER), 79) AS bin, lo, hi FROM scored, m)
       SELECT bin, round(lo + bin * ((hi - lo) / 80), 10) AS lo, round(lo + (bin + 1) * ((hi - lo) / 80), 10) AS hi, count(*) AS n FROM b GROUP BY b.bin, b.lo, b.hi""",
)
def _(spark, d):
    h = profile.histogram(star.scored(spark, d), "p", 80)
    return h.select("bin", r10("lo").alias("lo"), r10("hi").alias("hi"), "n")


@query(
    "histogram_density",
    """WITH v AS (SELECT target, LEAD_TIME_DAYS AS x FROM labeled WHERE LEAD_TIME_DAYS <= 180),
       m AS (SELECT target, min(x) AS lo, (max(x) - min(x)) / 60 AS w, count(*) AS size FROM v GROUP BY target),
       b AS (SELECT target, lo, w, size, least(CAST(floor((x - lo) / w) AS INTEGER), 59) AS bin FROM v JOIN m USING (target))
       SELECT target, bin, round(lo + bin * w, 10) AS lo, round(lo + (bin + 1) * w, 10) AS hi, count(*) AS n, round(count(*) / (size * w), 10) AS density
       FROM b GROUP BY b.target, b.bin, b.lo, b.w, b.size""",
)
def _(spark, d):
    h = profile.histogram_density(_labeled(spark, d, "LEAD_TIME_DAYS"), "target", "LEAD_TIME_DAYS")
    return h.select("target", "bin", r10("lo").alias("lo"), r10("hi").alias("hi"), "n", r10("density").alias("density"))


@query(
    "box_stats",
    """WITH q AS (SELECT sex, count(*) AS n, min(predicted_risk_prob) AS mn, quantile_cont(predicted_risk_prob, 0.25) AS q1, quantile_cont(predicted_risk_prob, 0.5) AS md,
         quantile_cont(predicted_risk_prob, 0.75) AS q3, max(predicted_risk_prob) AS mx FROM appts GROUP BY sex)
       SELECT sex, n, mn AS min, round(q1, 10) AS q1, round(md, 10) AS median, round(q3, 10) AS q3, mx AS max,
       (SELECT min(predicted_risk_prob) FROM appts a WHERE a.sex = q.sex AND predicted_risk_prob >= q1 - 1.5e0 * (q3 - q1)) AS lower_fence,
       (SELECT max(predicted_risk_prob) FROM appts a WHERE a.sex = q.sex AND predicted_risk_prob <= q3 + 1.5e0 * (q3 - q1)) AS upper_fence FROM q""",
)
def _(spark, d):
    b = profile.box_stats(star.appointments(spark, d, "sex", "predicted_risk_prob"), "sex", "predicted_risk_prob")
    return b.withColumns({c: r10(c) for c in ("q1", "median", "q3")})


@query(
    "patient_history_rate",
    """SELECT patient_id, count(*) AS total, CAST(sum(CASE WHEN status = 'No-Show' THEN 1 ELSE 0 END) AS BIGINT) AS no_shows,
       round(sum(CASE WHEN status = 'No-Show' THEN 1 ELSE 0 END) * 1.0e0 / count(*), 10) AS rate FROM appts GROUP BY patient_id""",
)
def _(spark, d):
    h = history.history_rate(star.appointments(spark, d, "patient_id", "status"), "patient_id")
    return h.withColumn("rate", r10("rate"))


@query(
    "share_of_total",
    "SELECT primary_plan_type, count(*) AS n, round(count(*) * 1.0e0 / sum(count(*)) OVER (), 10) AS share FROM appts GROUP BY ALL",
)
def _(spark, d):
    s = kpi.share_of_total(star.appointments(spark, d, "primary_plan_type"), "primary_plan_type")
    return s.withColumn("share", r10("share"))


@query(
    "score_histogram",
    "SELECT CAST(len(list_filter([k / 20.0e0 FOR k IN range(1, 20)], lambda e: e <= p)) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY ALL",
)
def _(spark, d):
    return profile.histogram_steps(star.scored(spark, d), "p", 20)


@query(
    "percentiles_all_distinct",
    """SELECT status, count(*) AS n, round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.99), 4) AS p99
       FROM (SELECT status, id / 1048576.0e0 AS v FROM appts) GROUP BY status""",
)
def _(spark, d):
    """Exact percentiles of a column without repeats, from the values near them."""
    a = star.appointments(spark, d, "id", "status").withColumn("v", F.col("id") / 1048576.0)
    out = percentiles(a, ["status"], "v", {"p05": 0.05, "median": 0.5, "p99": 0.99}, rows_per_range=1_000, accuracy=1_000)
    return out.select("status", "n", *[F.round(c, 4).alias(c) for c in ("p05", "median", "p99")])
