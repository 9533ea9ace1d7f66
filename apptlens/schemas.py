"""Declared schemas and column groups. Reads never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()

APPOINTMENTS_SCHEMA = T.StructType(
    [
        T.StructField("id", _L),
        T.StructField("patient_id", _S),
        T.StructField("appointment_date", _TS),
        T.StructField("booking_date", _TS),
        T.StructField("sex", _S),
        T.StructField("age", _I),
        T.StructField("language", _S),
        T.StructField("zipcode", _S),
        T.StructField("appt_type_code", _S),
        T.StructField("medical_service_code", _S),
        T.StructField("facility_code", _S),
        T.StructField("nurse_unit_code", _S),
        T.StructField("service_line_used", _S),
        T.StructField("attending_physician", _S),
        T.StructField("referring_physician", _S),
        T.StructField("primary_plan_type", _S),
        T.StructField("predicted_risk_prob", _D),
        T.StructField("risk_level", _S),
        T.StructField("status", _S),
        T.StructField("created_at", _TS),
    ]
)

# The booking columns a caller provides; id and created_at belong to the table.
BOOKING_COLUMNS = [f.name for f in APPOINTMENTS_SCHEMA if f.name not in ("id", "created_at")]

RAW_SCHEMA = T.StructType(
    [
        T.StructField("UNIQUE_ID", _S),
        T.StructField("ENCNTR", _L),
        T.StructField("APPT", _L),
        T.StructField("APPT_STATUS", _S),
        T.StructField("QUALIFYING_FLAG", _I),
        T.StructField("ENCNTR_TYPE", _S),
        T.StructField("SCH_CANCEL_LEAD_HOURS", _D),
        T.StructField("CANCEL_TO_APPT_LEAD_HOURS", _D),
        T.StructField("LEAD_TIME_DAYS", _D),
        T.StructField("AGE", _S),
        T.StructField("APPT_DOW", _I),
        T.StructField("APPT_HOUR", _I),
        T.StructField("DURATION", _I),
        T.StructField("SEX", _S),
        T.StructField("LANGUAGE", _S),
        T.StructField("ZIPCODE3", _S),
        T.StructField("APPT_TYPE_CODE", _S),
        T.StructField("MEDICAL_SERVICE_CODE", _S),
        T.StructField("FACILITY_CODE", _S),
        T.StructField("NURSE_UNIT_CODE", _S),
        T.StructField("SERVICE_LINE_USED", _S),
        T.StructField("ATTENDING_PHYSICIAN", _S),
        T.StructField("REFERRING_PHYSICIAN", _S),
        T.StructField("PRIMARY_PLAN_TYPE", _S),
        T.StructField("TIME_OF_DAY_BUCKET", _S),
        T.StructField("SEASON_BUCKET", _S),
        # Says what "earlier" means for running rates; never a model input.
        T.StructField("EVENT_TIME", _TS),
    ]
)

# Columns that may be empty without dropping the row.
NULLABLE_RAW = ["SCH_CANCEL_LEAD_HOURS", "CANCEL_TO_APPT_LEAD_HOURS"]

# Columns that must not reach a model (ids, outcome, leakage).
NON_FEATURES = [
    "SCH_CANCEL_LEAD_HOURS",
    "CANCEL_TO_APPT_LEAD_HOURS",
    "APPT_STATUS",
    "QUALIFYING_FLAG",
    "TARGET_CLASS",
    "TARGET_ENCODED",
    "UNIQUE_ID",
    "ENCNTR",
    "APPT",
    "DURATION",
    "ORIGINAL_STATUS",
    "ENCNTR_TYPE",
    "TIME_OF_DAY_BUCKET",
]
# Our own event clock is no model input either.
NON_FEATURES = [*NON_FEATURES, "EVENT_TIME"]

# Model inputs, numeric first, then the encoded categories.
NUMERIC_FEATURES = [
    "AGE",
    "LEAD_TIME_DAYS",
    "APPT_DOW",
    "APPT_HOUR",
    "IS_WEEKEND",
    "APPT_COUNT_BY_PATIENT",
    "PATIENT_NOSHOW_RATE",
    "PHYSICIAN_NOSHOW_RATE",
]
CATEGORY_FEATURES = [
    "SEX",
    "LANGUAGE",
    "ZIPCODE3",
    "APPT_TYPE_CODE",
    "MEDICAL_SERVICE_CODE",
    "FACILITY_CODE",
    "NURSE_UNIT_CODE",
    "SERVICE_LINE_USED",
    "ATTENDING_PHYSICIAN",
    "REFERRING_PHYSICIAN",
    "PRIMARY_PLAN_TYPE",
    "SEASON_BUCKET",
]
FEATURES = NUMERIC_FEATURES + CATEGORY_FEATURES
