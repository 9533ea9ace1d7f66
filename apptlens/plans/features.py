"""From raw history or bookings to model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptlens.functions.cleaning import binary_target, clean_age, coerce_numeric, fill_null
from apptlens.functions.temporal import is_weekend, iso_day_of_week, lead_time_days, season_bucket
from apptlens.operators.encode import align_features, label_encode_apply
from apptlens.operators.filters import drop_missing, filter_nonneg_lead
from apptlens.operators.history import enrich_history, prior_rate
from apptlens.operators.prefix import ROWS_PER_RANGE
from apptlens.schemas import CATEGORY_FEATURES, FEATURES, NULLABLE_RAW
from apptlens.session import WIDE, materialize
from apptlens.sources.history_state import HistoryState

_NUMBERS = ("LEAD_TIME_DAYS", "APPT_HOUR", "DURATION", "APPT_DOW")
_EVENT_ORDER = ("EVENT_TIME", "APPT")


def complete_history(raw: DataFrame) -> DataFrame:
    """Plausible, complete rows."""
    return drop_missing(filter_nonneg_lead(raw), NULLABLE_RAW)


def clean_history(raw: DataFrame) -> DataFrame:
    """Plausible, complete rows with numeric age, 0/1 target and weekend flag."""
    return clean_values(complete_history(raw))


def clean_values(rows: DataFrame) -> DataFrame:
    """Complete rows (all, or only some of their columns) with numeric age, 0/1 target and weekend flag."""
    rows = clean_age(rows)
    rows = rows.withColumns({c: coerce_numeric(F.col(c)) for c in _NUMBERS if c in rows.columns})
    rows = rows.withColumn("TARGET_ENCODED", binary_target(F.col("APPT_STATUS")))
    rows = rows.filter(F.col("TARGET_ENCODED").isNotNull())
    return rows.withColumn("IS_WEEKEND", is_weekend(F.col("APPT_DOW")))


def add_running_rates(
    rows: DataFrame, base_rate: float, rows_per_range: int = ROWS_PER_RANGE, n_rows: int | None = None, provider: str = "ATTENDING_PHYSICIAN"
) -> DataFrame:
    """Prior visits, prior patient rate and prior provider rate, in event order."""
    n_rows = rows.count() if n_rows is None else n_rows
    rows = rows.withColumn(provider, fill_null(F.col(provider), "UNKNOWN"))
    rows = prior_rate(
        rows, "UNIQUE_ID", "TARGET_ENCODED", _EVENT_ORDER, "PATIENT_NOSHOW_RATE", 0.0,
        count_name="APPT_COUNT_BY_PATIENT", rows_per_range=rows_per_range, n_rows=n_rows,
    )
    # Stored, one sort is done with before the other begins, and its files are gone.
    rows = materialize(rows, "patient-rates", WIDE)
    return prior_rate(
        rows, provider, "TARGET_ENCODED", _EVENT_ORDER, "PHYSICIAN_NOSHOW_RATE", base_rate,
        rows_per_range=rows_per_range, n_rows=n_rows,
    )


def booking_inputs(
    bookings: DataFrame, history: DataFrame | HistoryState, hot_rows: int = 1_000_000, before: str | None = None, resolved_only: bool = False
) -> DataFrame:
    """Model inputs of bookings before encoding, next to the booking columns.

    The history is the table itself or its kept counts; ``before`` names the
    booking's own moment, and only what is earlier counts.
    """
    options = {"resolved_only": resolved_only, "hot_rows": hot_rows, "before": before}
    if isinstance(history, HistoryState):
        rows = history.enrich(bookings, **options)
    else:
        rows = enrich_history(bookings, history, **options)
    at, booked = F.col("appointment_date"), F.col("booking_date")
    dow = iso_day_of_week(at)
    same = {
        "AGE": "age", "SEX": "sex", "LANGUAGE": "language", "ZIPCODE3": "zipcode", "APPT_TYPE_CODE": "appt_type_code",
        "MEDICAL_SERVICE_CODE": "medical_service_code", "FACILITY_CODE": "facility_code", "NURSE_UNIT_CODE": "nurse_unit_code",
        "SERVICE_LINE_USED": "service_line_used", "ATTENDING_PHYSICIAN": "attending_physician",
        "REFERRING_PHYSICIAN": "referring_physician", "PRIMARY_PLAN_TYPE": "primary_plan_type",
        "APPT_COUNT_BY_PATIENT": "patient_visits", "PATIENT_NOSHOW_RATE": "patient_rate", "PHYSICIAN_NOSHOW_RATE": "provider_rate",
    }
    computed = {
        "LEAD_TIME_DAYS": lead_time_days(at, booked), "APPT_DOW": dow, "APPT_HOUR": F.hour(at),
        "IS_WEEKEND": is_weekend(dow), "SEASON_BUCKET": season_bucket(at),
    }
    computed.update({name: F.col(source) for name, source in same.items()})
    kept = [F.col(c) for c in bookings.columns if c.upper() not in computed]
    return rows.select(*kept, *[v.alias(k) for k, v in computed.items()])


def build_features(
    bookings: DataFrame,
    history: DataFrame | HistoryState,
    encoders: DataFrame,
    features: Sequence[str] = FEATURES,
    keep: Sequence[str] = ("id",),
    hot_rows: int = 1_000_000,
    before: str | None = None,
    resolved_only: bool = False,
) -> DataFrame:
    """Bookings to encoded, ordered model inputs."""
    rows = booking_inputs(bookings, history, hot_rows, before, resolved_only)
    encoded = label_encode_apply(rows, encoders, CATEGORY_FEATURES)
    return align_features(encoded, features, keep)
