"""Scalar functions and projections over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from apptlens.functions import cleaning, temporal, text, tiers
from apptlens.operators import filters
from apptlens.plans.registry import day, moment, query, r10
from apptlens.sources import star

_SEASON = """CASE WHEN month(appointment_date) IN (12, 1, 2) THEN 'Winter' WHEN month(appointment_date) IN (3, 4, 5) THEN 'Spring'
 WHEN month(appointment_date) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"""


@query("project_existing", "SELECT id, patient_id, risk_level, predicted_risk_prob FROM appts")
def _(spark, d):
    a = star.appointments(spark, d, "id", "patient_id", "risk_level", "predicted_risk_prob", "status")
    return filters.project_existing(a, ["id", "patient_id", "no_such_column", "risk_level", "predicted_risk_prob"])


@query("rename_columns", 'SELECT risk_level AS "Risk Level", count(*) AS "Count" FROM appts GROUP BY risk_level')
def _(spark, d):
    a = star.appointments(spark, d, "risk_level")
    return a.groupBy("risk_level").count().withColumnsRenamed({"risk_level": "Risk Level", "count": "Count"})


@query("coerce_numeric", "SELECT APPT AS id, TRY_CAST(trim(AGE) AS DOUBLE) AS age_number FROM raw")
def _(spark, d):
    r = star.raw_history(spark, d, "APPT", "AGE")
    return r.select(F.col("APPT").alias("id"), cleaning.coerce_numeric(F.trim("AGE")).alias("age_number"))


@query(
    "parse_mixed_timestamp",
    """SELECT id, CASE WHEN id % 5 = 4 THEN NULL WHEN id % 5 IN (1, 2) THEN strftime(appointment_date, '%Y-%m-%d 00:00:00')
       ELSE strftime(appointment_date, '%Y-%m-%d %H:%M:%S') END AS parsed FROM appts""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date")
    ts, kind = F.col("appointment_date"), F.pmod("id", F.lit(5))
    written = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 2, F.date_format(ts, "MM/dd/yyyy"))
        .when(kind == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .otherwise("soon")
    )
    return a.select("id", moment(temporal.parse_mixed_timestamp(written)).alias("parsed"))


@query("date_only", "SELECT id, strftime(appointment_date, '%Y-%m-%d') AS date_only FROM appts")
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date")
    return a.select("id", day(F.to_date("appointment_date")).alias("date_only"))


@query("lead_time_days", "SELECT id, CAST(lead_days AS INTEGER) AS lead_time_days FROM appts")
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date", "booking_date")
    return a.select("id", temporal.lead_time_days(F.col("appointment_date"), F.col("booking_date")).alias("lead_time_days"))


@query("iso_day_of_week", "SELECT id, CAST(isodow(appointment_date) AS INTEGER) AS dow FROM appts")
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date")
    return a.select("id", temporal.iso_day_of_week(F.col("appointment_date")).alias("dow"))


@query(
    "hour_month_year",
    """SELECT id, CAST(hour(appointment_date) AS INTEGER) AS appt_hour, CAST(month(appointment_date) AS INTEGER) AS appt_month,
       CAST(year(appointment_date) AS INTEGER) AS appt_year FROM appts""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date")
    ts = F.col("appointment_date")
    return a.select("id", F.hour(ts).alias("appt_hour"), F.month(ts).alias("appt_month"), F.year(ts).alias("appt_year"))


@query(
    "is_weekend",
    """SELECT id, CASE WHEN isodow(appointment_date) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN isodow(appointment_date) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend_old FROM appts""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date")
    dow = temporal.iso_day_of_week(F.col("appointment_date"))
    return a.select(
        "id", temporal.is_weekend(dow).alias("is_weekend"), temporal.is_weekend(dow, (0, 6)).alias("is_weekend_old")
    )


@query("season_bucket", f"SELECT id, {_SEASON} AS season FROM appts")
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date")
    return a.select("id", temporal.season_bucket(F.col("appointment_date")).alias("season"))


@query("iso_week", "SELECT id, CAST(week(appointment_date) AS INTEGER) AS week_year FROM appts")
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date")
    return a.select("id", F.weekofyear("appointment_date").alias("week_year"))


@query(
    "year_week_key",
    """SELECT id, CAST(year(appointment_date) AS VARCHAR) || '-W' || lpad(CAST(week(appointment_date) AS VARCHAR), 2, '0') AS year_week,
       CAST(isoyear(appointment_date) AS VARCHAR) || '-W' || lpad(CAST(week(appointment_date) AS VARCHAR), 2, '0') AS iso_year_week
       FROM appts""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date")
    ts = F.col("appointment_date")
    return a.select(
        "id", temporal.year_week_key(ts).alias("year_week"), temporal.year_week_key(ts, iso_year=True).alias("iso_year_week")
    )


@query(
    "week_label",
    """SELECT id, strftime(date_trunc('week', appointment_date), '%b %d') || ' – ' ||
       strftime(date_trunc('week', appointment_date) + INTERVAL 6 DAY, '%b %d') AS week_label FROM appts""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "appointment_date")
    return a.select("id", temporal.week_label(F.col("appointment_date")).alias("week_label"))


@query(
    "clean_age",
    """SELECT APPT AS id, CASE WHEN trim(AGE) = '90+' THEN 95.0e0 ELSE TRY_CAST(trim(AGE) AS DOUBLE) END AS age FROM raw""",
)
def _(spark, d):
    r = star.raw_history(spark, d, "APPT", "AGE")
    return cleaning.clean_age(r).select(F.col("APPT").alias("id"), F.col("AGE").alias("age"))


@query("binary_target", "SELECT APPT AS id, target FROM labeled")
def _(spark, d):
    r = star.raw_history(spark, d, "APPT", "APPT_STATUS")
    return r.select(F.col("APPT").alias("id"), cleaning.binary_target(F.col("APPT_STATUS")).alias("target")).dropna()


@query(
    "three_way_status",
    """SELECT APPT AS id, CASE WHEN APPT_STATUS IS NULL THEN 'Unknown' WHEN APPT_STATUS IN ('NOSHOW', 'No Show') THEN 'NOSHOW'
       WHEN APPT_STATUS = 'Canceled' THEN 'CANCELED' ELSE 'SUCCESS' END AS original_status FROM raw""",
)
def _(spark, d):
    r = star.raw_history(spark, d, "APPT", "APPT_STATUS")
    return r.select(F.col("APPT").alias("id"), cleaning.three_way_status(F.col("APPT_STATUS")).alias("original_status"))


@query(
    "map_values",
    """SELECT APPT AS id, CASE WHEN APPT_STATUS IS NULL THEN NULL WHEN APPT_STATUS IN ('NOSHOW', 'No Show', 'Canceled') THEN 1
       ELSE 0 END AS encoded FROM raw""",
)
def _(spark, d):
    r = star.raw_history(spark, d, "APPT", "APPT_STATUS")
    kind = cleaning.target_class(F.col("APPT_STATUS"))
    return r.select(F.col("APPT").alias("id"), cleaning.map_values(kind, {"SUCCESS": 0, "NOT_SUCCESS": 1}).alias("encoded"))


@query(
    "risk_tier",
    """SELECT id, risk_level AS serving_tier,
       CASE WHEN p < 0.10e0 THEN 'Very Low' WHEN p < 0.20e0 THEN 'Low' WHEN p < 0.35e0 THEN 'Moderate'
            WHEN p < 0.55e0 THEN 'High' WHEN p >= 0.55e0 THEN 'Very High' END AS study_tier,
       CASE WHEN p < 0.15e0 THEN 'Very Low' WHEN p < 0.25e0 THEN 'Low' WHEN p < 0.50e0 THEN 'Moderate'
            WHEN p < 0.70e0 THEN 'High' WHEN p >= 0.70e0 THEN 'Very High' END AS early_tier
       FROM (SELECT id, risk_level, predicted_risk_prob AS p FROM appts)""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "predicted_risk_prob")
    p = F.col("predicted_risk_prob")
    return a.select(
        "id",
        tiers.risk_tier(p).alias("serving_tier"),
        tiers.risk_tier(p, tiers.STUDY_EDGES).alias("study_tier"),
        tiers.risk_tier(p, tiers.EARLY_EDGES).alias("early_tier"),
    )


@query(
    "tier_action",
    """SELECT id, risk_level, CASE risk_level WHEN 'Moderate' THEN 'Automated SMS/email reminder'
       WHEN 'High' THEN 'Manual phone call + reminder' WHEN 'Very High' THEN 'Double-book slot + personal outreach'
       ELSE 'No action' END AS action FROM appts""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "risk_level")
    return tiers.with_tier_details(a, ["action"]).select("id", "risk_level", "action")


@query(
    "tier_rank",
    """SELECT id, CASE risk_level WHEN 'Very Low' THEN 1 WHEN 'Low' THEN 2 WHEN 'Moderate' THEN 3 WHEN 'High' THEN 4
       ELSE 5 END AS tier_order FROM appts""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "risk_level")
    return a.select("id", tiers.tier_rank(F.col("risk_level")).cast("int").alias("tier_order"))


@query("fill_null", "SELECT id, coalesce(referring_physician, 'UNKNOWN') AS referring_physician FROM appts")
def _(spark, d):
    a = star.appointments(spark, d, "id", "referring_physician")
    return a.select("id", cleaning.fill_null(F.col("referring_physician"), "UNKNOWN").alias("referring_physician"))


@query("clip_lower", "SELECT APPT AS id, greatest(LEAD_TIME_DAYS, 0.0e0) AS lead FROM raw")
def _(spark, d):
    r = star.raw_history(spark, d, "APPT", "LEAD_TIME_DAYS")
    return r.select(F.col("APPT").alias("id"), cleaning.clip_lower(F.col("LEAD_TIME_DAYS"), 0.0).alias("lead"))


@query(
    "round_n",
    "SELECT attending_physician, round_even(avg(age), 1) AS age_1, round_even(avg(age), 2) AS age_2 FROM appts GROUP BY ALL",
)
def _(spark, d):
    a = star.appointments(spark, d, "attending_physician", "age")
    mean = F.avg("age")
    return a.groupBy("attending_physician").agg(
        cleaning.round_n(mean, 1).alias("age_1"), cleaning.round_n(mean, 2).alias("age_2")
    )


@query("row_zfill_key", "SELECT id, CASE WHEN length(k) >= 5 THEN k ELSE lpad(k, 5, '0') END AS padded FROM (SELECT id, CAST(id % 1234567 AS VARCHAR) AS k FROM appts)")
def _(spark, d):
    a = star.appointments(spark, d, "id")
    return a.select("id", temporal.zfill((F.col("id") % 1234567).cast("string"), 5).alias("padded"))


@query(
    "format_percent",
    """SELECT risk_level, printf('%.1f%%', n * 100.0e0 / total) AS share_text, printf('%.2fx', n * 5.0e0 / total) AS multiple_text
       FROM (SELECT risk_level, count(*) AS n, sum(count(*)) OVER () AS total FROM appts GROUP BY risk_level)""",
)
def _(spark, d):
    from apptlens.operators.kpi import share_of_total

    shares = share_of_total(star.appointments(spark, d, "risk_level"), "risk_level")
    return shares.select(
        "risk_level", text.as_percent(F.col("share")).alias("share_text"), text.as_multiple(F.col("share") * 5).alias("multiple_text")
    )


@query(
    "decode_feature_value",
    """SELECT id, feature, display FROM (
       SELECT id, 'AGE' AS feature, CAST(age AS VARCHAR) AS display FROM appts UNION ALL
       SELECT id, 'APPT_DOW', strftime(appointment_date, '%a') FROM appts UNION ALL
       SELECT id, 'IS_WEEKEND', CASE WHEN isodow(appointment_date) >= 6 THEN 'Yes' ELSE 'No' END FROM appts UNION ALL
       SELECT id, 'PATIENT_NOSHOW_RATE', printf('%.1f%%', predicted_risk_prob * 100) FROM appts UNION ALL
       SELECT id, 'SEX', sex FROM appts UNION ALL SELECT id, 'LANGUAGE', language FROM appts)""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "age", "appointment_date", "predicted_risk_prob", "sex", "language")
    dow = temporal.iso_day_of_week(F.col("appointment_date"))
    numbers = {"AGE": F.col("age"), "APPT_DOW": dow, "IS_WEEKEND": temporal.is_weekend(dow), "PATIENT_NOSHOW_RATE": F.col("predicted_risk_prob")}
    categories = {"SEX": F.col("sex"), "LANGUAGE": F.col("language")}
    none = F.lit(None)
    entries = [F.struct(F.lit(k).alias("feature"), v.cast("double").alias("number"), none.cast("string").alias("category")) for k, v in numbers.items()]
    entries += [F.struct(F.lit(k).alias("feature"), none.cast("double").alias("number"), v.alias("category")) for k, v in categories.items()]
    long = a.select("id", F.explode(F.array(*entries)).alias("e")).select("id", "e.*")
    return long.select(
        "id", "feature", text.decode_feature_value(F.col("feature"), F.col("number"), F.col("category")).alias("display")
    )


@query("drop_columns", "SELECT id, status FROM appts")
def _(spark, d):
    a = star.appointments(spark, d, "id", "status", "age")
    return a.withColumn("helper", F.col("age") + 1).drop("helper", "age")


@query(
    "safe_ratio",
    """SELECT attending_physician, round(CASE WHEN r > 0 THEN n * 1.0e0 / r ELSE 0.211e0 END, 10) AS rate FROM (
       SELECT attending_physician, count(*) FILTER (WHERE status = 'No-Show' AND month(appointment_date) = 2 AND isodow(appointment_date) = 7) AS n,
       count(*) FILTER (WHERE status <> 'Scheduled' AND month(appointment_date) = 2 AND isodow(appointment_date) = 7) AS r
       FROM appts GROUP BY attending_physician)""",
)
def _(spark, d):
    a = star.appointments(spark, d, "attending_physician", "status", "appointment_date")
    odd_day = (F.month("appointment_date") == 2) & (F.weekday("appointment_date") == 6)
    g = a.groupBy("attending_physician").agg(
        F.count_if(odd_day & (F.col("status") == "No-Show")).alias("n"),
        F.count_if(odd_day & (F.col("status") != "Scheduled")).alias("r"),
    )
    return g.select("attending_physician", r10(cleaning.safe_ratio(F.col("n"), F.col("r"), 0.211)).alias("rate"))


@query(
    "tier_expected_rate",
    """SELECT id, CASE risk_level WHEN 'Very Low' THEN 0.07e0 WHEN 'Low' THEN 0.13e0 WHEN 'Moderate' THEN 0.19e0
       WHEN 'High' THEN 0.30e0 ELSE 0.51e0 END AS expected_rate FROM appts""",
)
def _(spark, d):
    a = star.appointments(spark, d, "id", "risk_level")
    return tiers.with_tier_details(a, ["expected_rate"]).select("id", "expected_rate")
