"""Running rates, curves over rows, rankings, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from apptlens.functions.cleaning import binary_target
from apptlens.functions.temporal import iso_day_of_week
from apptlens.operators import encode, evaluate, explain, history, splits, trend
from apptlens.plans.registry import day, query, r10
from apptlens.sources import star

# Small ranges make the checks cover the split path of large tables.
_SMALL_RANGE = 7_000
_ORDER = ["EVENT_TIME", "APPT"]


def _labeled(spark, d, *columns):
    r = star.raw_history(spark, d, "APPT", "APPT_STATUS", "EVENT_TIME", *columns)
    return r.withColumn("target", binary_target(F.col("APPT_STATUS"))).filter(F.col("target").isNotNull()).drop("APPT_STATUS")


@query(
    "prior_visit_count",
    "SELECT APPT AS id, row_number() OVER (PARTITION BY UNIQUE_ID ORDER BY EVENT_TIME, APPT) - 1 AS prior_visits FROM labeled",
)
def _(spark, d):
    out = history.prior_visit_count(_labeled(spark, d, "UNIQUE_ID"), "UNIQUE_ID", _ORDER)
    return out.select(F.col("APPT").alias("id"), "prior_visits")


@query("total_visit_count", "SELECT APPT AS id, count(APPT) OVER (PARTITION BY UNIQUE_ID) AS total_visits FROM labeled")
def _(spark, d):
    out = history.total_visit_count(_labeled(spark, d, "UNIQUE_ID"), "UNIQUE_ID", "APPT")
    return out.select(F.col("APPT").alias("id"), "total_visits")


_PRIOR = """SELECT APPT AS id, round(CASE WHEN n = 0 THEN {default} ELSE k * 1.0e0 / n END, 10) AS rate FROM (
  SELECT *, count(*) OVER w AS n, coalesce(sum(target) OVER w, 0) AS k, avg(target) OVER () AS base FROM labeled
  WINDOW w AS (PARTITION BY {key} ORDER BY EVENT_TIME, APPT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("prior_patient_rate", _PRIOR.format(key="UNIQUE_ID", default="0.0e0"))
def _(spark, d):
    out = history.prior_patient_rate(_labeled(spark, d, "UNIQUE_ID"), "UNIQUE_ID", "target", _ORDER, name="rate")
    return out.select(F.col("APPT").alias("id"), r10("rate").alias("rate"))


@query("prior_provider_rate", _PRIOR.format(key="ATTENDING_PHYSICIAN", default="base"))
def _(spark, d):
    rows = _labeled(spark, d, "ATTENDING_PHYSICIAN")
    out = history.prior_provider_rate(rows, "ATTENDING_PHYSICIAN", "target", _ORDER, name="rate")
    return out.select(F.col("APPT").alias("id"), r10("rate").alias("rate"))


@query(
    "prior_facility_rate",
    _PRIOR.format(key="FACILITY_CODE", default="base"),
)
def _(spark, d):
    """The provider rate over five keys that hold a fifth of the table each."""
    rows = _labeled(spark, d, "FACILITY_CODE")
    out = history.prior_provider_rate(rows, "FACILITY_CODE", "target", _ORDER, name="rate", rows_per_range=_SMALL_RANGE)
    return out.select(F.col("APPT").alias("id"), r10("rate").alias("rate"))


@query(
    "rolling_7_mean",
    """WITH t AS (SELECT CAST(appointment_date AS DATE) AS dt, count(predicted_risk_prob) AS appts, avg(predicted_risk_prob) AS avg_risk FROM appts GROUP BY ALL)
       SELECT strftime(dt, '%Y-%m-%d') AS date_only, appts, round(avg_risk, 10) AS avg_risk,
       round(avg(avg_risk) OVER (ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 10) AS rolling_risk FROM t""",
)
def _(spark, d):
    t = trend.rolling_mean(trend.daily_trend(star.appointments(spark, d, "appointment_date", "predicted_risk_prob")))
    return t.select(day("date_only").alias("date_only"), "appts", r10("avg_risk").alias("avg_risk"), r10("rolling_risk").alias("rolling_risk"))


@query(
    "gain_curve",
    """SELECT id, p, y, CAST(sum(y) OVER w AS BIGINT) AS cum_actual, round(sum(y) OVER w * 1.0e0 / sum(y) OVER (), 10) AS cum_share_actual,
       round(row_number() OVER w * 1.0e0 / count(*) OVER (), 10) AS cum_share_records FROM scored
       WINDOW w AS (ORDER BY p DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    g = evaluate.gain_curve(star.scored(spark, d), rows_per_range=_SMALL_RANGE)
    return g.withColumns({c: r10(c) for c in ("cum_share_actual", "cum_share_records")})


@query(
    "cumulative_confusion",
    """WITH c AS (SELECT p AS score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM scored GROUP BY p)
       SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM c""",
)
def _(spark, d):
    return evaluate.score_totals(star.scored(spark, d), rows_per_range=100)


_CONTRIBS = """contribs AS (SELECT id, 'f' || CAST(k AS VARCHAR) AS feature, ((id % 1000003) * 31 + k * 17) % 101 - 50.0e0 AS value FROM appts, range(1, 6) t(k))"""


def contributions(spark, d):
    """Contributions from a known formula: five per appointment."""
    a = star.appointments(spark, d, "id", heavy=True)
    number = F.pmod("id", F.lit(1000003))
    values = F.array(*[((number * 31 + k * 17) % 101 - 50).cast("double") for k in range(1, 6)])
    return a.select("id", explain.named_values([f"f{k}" for k in range(1, 6)], values).alias("contribs"))


@query(
    "rank_abs_contrib",
    f"WITH {_CONTRIBS} SELECT id, feature, value, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, feature) AS INTEGER) AS place FROM contribs",
)
def _(spark, d):
    return explain.rank_abs_contrib(contributions(spark, d))


@query(
    "topk_contrib",
    f"""WITH {_CONTRIBS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, feature) AS INTEGER) AS place FROM contribs)
        SELECT id, feature, value, place, CASE WHEN value > 0 THEN 'Increases Risk' ELSE 'Decreases Risk' END AS direction, printf('%+.3f', value) AS value_text
        FROM r WHERE place <= 3""",
)
def _(spark, d):
    return explain.topk_contrib(contributions(spark, d), k=3)


@query("contrib_global", f"WITH {_CONTRIBS} SELECT feature, round(avg(abs(value)), 10) AS mean_abs FROM contribs GROUP BY feature")
def _(spark, d):
    return explain.contrib_global(contributions(spark, d)).withColumn("mean_abs", r10("mean_abs"))


@query(
    "contrib_waterfall",
    f"""WITH {_CONTRIBS}, r AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS step, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS "end"
          FROM contribs WINDOW w AS (PARTITION BY id ORDER BY abs(value), feature))
        SELECT id, feature, value, step, "end", "end" - value AS start, printf('%+.3f', value) AS value_text FROM r""",
)
def _(spark, d):
    return explain.contrib_waterfall(contributions(spark, d))


# Contributions over real model inputs, to show their values next to them.
_WITH_VALUES = """v AS (SELECT id, sex, language, [age * 1.0e0, isodow(appointment_date) * 1.0e0, predicted_risk_prob, CASE sex WHEN 'F' THEN 0.0e0 ELSE 1.0e0 END, n_language] AS x FROM appts
    JOIN (SELECT language, dense_rank() OVER (ORDER BY language) - 1.0e0 AS n_language FROM (SELECT DISTINCT language FROM appts)) USING (language)),
  n AS (SELECT * FROM (VALUES (1, 'AGE'), (2, 'APPT_DOW'), (3, 'PATIENT_NOSHOW_RATE'), (4, 'SEX'), (5, 'LANGUAGE')) t(k, feature)),
  l AS (SELECT id, feature, ((id % 1000003) * 31 + k * 17) % 101 - 50.0e0 AS value, x[k] AS raw_value,
    CASE feature WHEN 'AGE' THEN printf('%.0f', x[k]) WHEN 'APPT_DOW' THEN ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][CAST(x[k] AS INTEGER)]
      WHEN 'PATIENT_NOSHOW_RATE' THEN printf('%.1f%%', x[k] * 100) WHEN 'SEX' THEN sex ELSE language END AS display FROM v, n)"""
_VALUE_INPUTS = ["AGE", "APPT_DOW", "PATIENT_NOSHOW_RATE", "SEX", "LANGUAGE"]


def _with_inputs(spark, d):
    a = star.appointments(spark, d, "id", "age", "appointment_date", "predicted_risk_prob", "sex", "language", heavy=True)
    number = F.pmod("id", F.lit(1000003))
    values = F.array(*[((number * 31 + k * 17) % 101 - 50).cast("double") for k in range(1, 6)])
    rows = a.select(
        "id",
        F.col("age").cast("double").alias("AGE"),
        iso_day_of_week(F.col("appointment_date")).alias("APPT_DOW"),
        F.col("predicted_risk_prob").alias("PATIENT_NOSHOW_RATE"),
        F.col("sex").alias("SEX"),
        F.col("language").alias("LANGUAGE"),
        F.col("sex").alias("sex_text"),
        F.col("language").alias("language_text"),
        explain.named_values(_VALUE_INPUTS, values).alias("contribs"),
    )
    return encode.label_encode_apply(rows, encode.label_encode_fit(rows, ["SEX", "LANGUAGE"]), ["SEX", "LANGUAGE"])


_TEXTS = {"SEX": "sex_text", "LANGUAGE": "language_text"}


@query("contrib_with_values", f"WITH {_WITH_VALUES} SELECT id, feature, value, raw_value, display FROM l")
def _(spark, d):
    return explain.contrib_with_values(_with_inputs(spark, d), _VALUE_INPUTS, _TEXTS)


@query(
    "contrib_top5",
    f"""WITH {_WITH_VALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, feature) AS place FROM l)
        SELECT id, feature, value, raw_value, display, CASE WHEN value > 0 THEN 'Increases Risk' ELSE 'Decreases Risk' END AS direction,
        printf('%+.3f', value) AS value_text FROM r WHERE place <= 3""",
)
def _(spark, d):
    return explain.contrib_top5(_with_inputs(spark, d), _VALUE_INPUTS, _TEXTS, k=3)


@query("lead_vs_risk", "SELECT id, CAST(lead_days AS INTEGER) AS lead_time_days, predicted_risk_prob, age, risk_level, medical_service_code FROM appts")
def _(spark, d):
    from apptlens.functions.temporal import lead_time_days

    a = star.appointments(spark, d, "id", "appointment_date", "booking_date", "predicted_risk_prob", "age", "risk_level", "medical_service_code")
    lead = lead_time_days(F.col("appointment_date"), F.col("booking_date")).alias("lead_time_days")
    return a.select("id", lead, "predicted_risk_prob", "age", "risk_level", "medical_service_code")


# --- splits and samples ------------------------------------------------------

_SPREAD = "id % 2147483647 * 48271 % 2147483647"
_RANKED = f"""ranked AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {_SPREAD}, id) AS r, count(*) OVER (PARTITION BY y) AS n,
  count(*) OVER () AS total FROM scored)"""


def _spread():
    """An arithmetic shuffling order that both engines compute alike."""
    return F.pmod("id", F.lit(2147483647)) * 48271 % 2147483647


@query(
    "split_stratified_3way",
    f"""WITH {_RANKED}, t AS (SELECT *, CAST(floor(n * 0.2e0 + 0.5e0) AS BIGINT) AS nt FROM ranked)
        SELECT id, y, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + floor((n - nt) * 0.2e0 + 0.5e0) THEN 'calibration' ELSE 'train' END AS part FROM t""",
)
def _(spark, d):
    s = star.scored(spark, d).select("id", "y")
    return splits.split_stratified_3way(s, "y", "id", _spread(), rows_per_range=_SMALL_RANGE)


@query(
    "split_by_group",
    """WITH patients AS (SELECT DISTINCT patient_id, CAST(substr(patient_id, 2) AS BIGINT) AS k FROM appts),
       ranked AS (SELECT patient_id, row_number() OVER (ORDER BY k % 2147483647 * 48271 % 2147483647, patient_id) AS r, count(*) OVER () AS n FROM patients)
       SELECT patient_id, CASE WHEN r <= ceil(n * 0.25e0) THEN 'test' ELSE 'train' END AS side FROM ranked""",
)
def _(spark, d):
    a = star.appointments(spark, d, "patient_id")
    number = F.substring("patient_id", 2, 20).cast("long")
    return splits.split_by_group(a, "patient_id", F.pmod(number, F.lit(2147483647)) * 48271 % 2147483647, rows_per_range=400)


@query("stratified_sample", f"WITH {_RANKED} SELECT id, y FROM ranked WHERE r <= floor(n * 10000 * 1.0e0 / total + 0.5e0)")
def _(spark, d):
    return splits.stratified_sample(star.scored(spark, d).select("id", "y"), "y", "id", 10_000, _spread())


@query("kfold_stratified", f"WITH {_RANKED} SELECT id, y, CAST((r - 1) % 3 AS INTEGER) AS fold FROM ranked")
def _(spark, d):
    return splits.kfold_stratified(star.scored(spark, d).select("id", "y"), "y", "id", 3, _spread())


@query("background_sample", f"SELECT id, y FROM scored ORDER BY {_SPREAD}, id LIMIT 100")
def _(spark, d):
    return splits.background_sample(star.scored(spark, d).select("id", "y"), "id", 100, _spread())
