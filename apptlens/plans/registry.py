"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The derived tables of ``sources.star`` once more, in the checking engine's SQL.
_LEAD = "CAST(floor(epoch(appointment_date - booking_date) / 86400.0e0) AS BIGINT)"
_BASE = f"""
base AS (
  SELECT *,
    (l_orderkey * 8 + l_linenumber) * 1048576
      + (l_partkey * 1009 + l_suppkey + (CAST(l_shipdate AS DATE) - DATE '1992-01-01') * 131) % 1048576 AS id,
    'P' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS patient_id,
    l_shipdate + to_hours(8 + l_partkey % 10) AS appointment_date,
    o_orderdate + to_hours(o_custkey % 24) AS booking_date,
    CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
    CAST(o_custkey % 900 + 100 AS VARCHAR) AS zipcode,
    'N' || CAST(l_partkey % 12 AS VARCHAR) AS nurse_unit_code,
    'S' || CAST(l_suppkey % 8 AS VARCHAR) AS service_line_used,
    'D' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS attending_physician,
    CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE p_brand END AS referring_physician,
    ((l_partkey * 7919 + l_orderkey * 104729) % 800
       + CASE WHEN l_returnflag = 'R' THEN 200 ELSE 0 END) / 1000.0e0 AS score,
    8 + l_partkey % 10 AS appt_hour
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  JOIN part ON p_partkey = l_partkey),
appts AS (
  SELECT id, patient_id, appointment_date, booking_date, sex,
    CASE WHEN l_quantity + 45 >= 90 THEN 95 ELSE CAST(l_quantity + 45 AS INTEGER) END AS age,
    n_name AS language, zipcode, p_brand AS appt_type_code, p_type AS medical_service_code,
    r_name AS facility_code, nurse_unit_code, service_line_used, attending_physician, referring_physician,
    c_mktsegment AS primary_plan_type, score AS predicted_risk_prob,
    CASE WHEN score < 0.10e0 THEN 'Very Low' WHEN score < 0.15e0 THEN 'Low' WHEN score < 0.25e0 THEN 'Moderate'
         WHEN score < 0.40e0 THEN 'High' ELSE 'Very High' END AS risk_level,
    CASE l_returnflag WHEN 'R' THEN 'No-Show' WHEN 'A' THEN 'Completed' ELSE 'Scheduled' END AS status,
    booking_date AS created_at,
    greatest(0, {_LEAD}) AS lead_days
  FROM base),
raw AS (
  SELECT patient_id AS UNIQUE_ID, l_orderkey AS ENCNTR, id AS APPT,
    CASE WHEN l_partkey % 101 = 0 THEN NULL
         WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'NOSHOW'
         WHEN l_returnflag = 'R' AND l_linenumber % 3 = 1 THEN 'No Show'
         WHEN l_returnflag = 'R' THEN 'Canceled'
         WHEN l_returnflag = 'A' THEN 'CHECKED OUT' ELSE 'CONFIRMED' END AS APPT_STATUS,
    CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS QUALIFYING_FLAG,
    o_orderpriority AS ENCNTR_TYPE,
    CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 2 THEN CAST(l_partkey % 200 AS DOUBLE) END AS SCH_CANCEL_LEAD_HOURS,
    CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 2 THEN CAST(l_suppkey % 72 AS DOUBLE) END AS CANCEL_TO_APPT_LEAD_HOURS,
    CAST({_LEAD} AS DOUBLE) AS LEAD_TIME_DAYS,
    CASE WHEN l_partkey % 97 = 0 THEN 'abc' WHEN l_quantity + 45 >= 90 THEN '90+'
         WHEN l_partkey % 53 = 0 THEN ' ' || CAST(CAST(l_quantity + 45 AS INTEGER) AS VARCHAR) || ' '
         ELSE CAST(CAST(l_quantity + 45 AS INTEGER) AS VARCHAR) END AS AGE,
    CAST(isodow(l_shipdate) AS INTEGER) AS APPT_DOW, CAST(appt_hour AS INTEGER) AS APPT_HOUR,
    15 * (1 + l_linenumber % 4) AS DURATION,
    sex AS SEX, n_name AS LANGUAGE, zipcode AS ZIPCODE3, p_brand AS APPT_TYPE_CODE, p_type AS MEDICAL_SERVICE_CODE,
    r_name AS FACILITY_CODE, nurse_unit_code AS NURSE_UNIT_CODE, service_line_used AS SERVICE_LINE_USED,
    attending_physician AS ATTENDING_PHYSICIAN, referring_physician AS REFERRING_PHYSICIAN,
    c_mktsegment AS PRIMARY_PLAN_TYPE,
    CASE WHEN appt_hour < 12 THEN 'Morning' WHEN appt_hour < 17 THEN 'Afternoon' ELSE 'Evening' END AS TIME_OF_DAY_BUCKET,
    CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'Winter' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'Spring'
         WHEN month(l_shipdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS SEASON_BUCKET,
    appointment_date AS EVENT_TIME
  FROM base),
labeled AS (
  SELECT *, CASE WHEN APPT_STATUS IN ('NOSHOW', 'No Show', 'Canceled') THEN 1 ELSE 0 END AS target
  FROM raw WHERE APPT_STATUS IS NOT NULL),
scored AS (
  SELECT id, CASE WHEN status = 'No-Show' THEN 1 ELSE 0 END AS y, predicted_risk_prob AS p,
         sqrt(predicted_risk_prob) AS p_raw
  FROM appts WHERE status <> 'Scheduled')"""


def oracle(sql: str) -> str:
    """A checking query over the derived tables."""
    body = sql.strip()
    head = f"WITH {_BASE.strip()}"
    if body[:5].upper() == "WITH ":
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its key, with its checking SQL if there is one."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return add


def r10(col: Column | str) -> Column:
    """Ten digits: more than the last-bit noise of a floating sum."""
    return F.round(col, 10)


def r6(col: Column | str) -> Column:
    """Six digits, for higher moments."""
    return F.round(col, 6)


def day(col: Column | str) -> Column:
    """Date as text, the same in both engines."""
    return F.date_format(col, "yyyy-MM-dd")


def moment(col: Column | str) -> Column:
    """Timestamp as text, the same in both engines."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
