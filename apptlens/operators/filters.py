"""Row filters and worklists.

Dates are compared on the stored timestamp with half-open ranges, so the
predicates reach the Parquet scan. ``as_of`` is always a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptlens.functions.tiers import HIGH_TIERS, is_high


def _ts(moment: date | datetime) -> Column:
    text = moment.isoformat(sep=" ") if isinstance(moment, datetime) else f"{moment.isoformat()} 00:00:00"
    return F.lit(text).cast("timestamp_ntz")


def _day(moment: date | datetime) -> date:
    return moment.date() if isinstance(moment, datetime) else moment


def filter_nonneg_lead(df: DataFrame, column: str = "LEAD_TIME_DAYS") -> DataFrame:
    """Keep rows whose lead time is known and not negative."""
    return df.filter(F.col(column) >= 0)


def drop_missing(df: DataFrame, may_be_empty: Sequence[str]) -> DataFrame:
    """Keep rows with a value in every column but the named ones."""
    return df.dropna(subset=[c for c in df.columns if c not in may_be_empty])


def missing_report(df: DataFrame, may_be_empty: Sequence[str]) -> DataFrame:
    """Row counts before and after ``drop_missing``, in one pass."""
    complete = F.lit(True)
    for c in df.columns:
        if c not in may_be_empty:
            complete = complete & F.col(c).isNotNull()
    return df.agg(
        F.count("*").alias("rows_before"),
        F.count_if(complete).alias("rows_after"),
        (F.count("*") - F.count_if(complete)).alias("rows_dropped"),
    )


def filter_tier_in(df: DataFrame, tiers: Sequence[str] = HIGH_TIERS) -> DataFrame:
    """Keep rows in the given tiers."""
    return df.filter(F.col("risk_level").isin(*tiers))


def filter_date_range(df: DataFrame, first: date, last: date, column: str = "appointment_date") -> DataFrame:
    """Keep rows from the first day to the last day, both included."""
    return df.filter((F.col(column) >= _ts(first)) & (F.col(column) < _ts(last + timedelta(days=1))))


def filter_multi_select(
    df: DataFrame,
    required: dict[str, Sequence],
    optional: dict[str, Sequence] | None = None,
) -> DataFrame:
    """AND of IN-lists. An empty required list keeps nothing; an empty optional one is ignored."""
    for column, values in required.items():
        df = df.filter(F.col(column).isin(*values) if values else F.lit(False))
    for column, values in (optional or {}).items():
        if values:
            df = df.filter(F.col(column).isin(*values))
    return df


def search_patient(df: DataFrame, text: str, literal: bool = False, column: str = "patient_id") -> DataFrame:
    """Case-insensitive search; a regular expression unless ``literal``. Blank text keeps all rows."""
    text = text.strip()
    if not text:
        return df
    if literal:
        return df.filter(F.contains(F.lower(column), F.lit(text.lower())))
    return df.filter(F.col(column).rlike(f"(?i){text}"))


def upcoming_high_risk(df: DataFrame, as_of: datetime, k: int = 6) -> DataFrame:
    """The next k scheduled high-risk appointments from the given day on."""
    rows = df.filter(
        is_high(F.col("risk_level")) & (F.col("status") == "Scheduled") & (F.col("appointment_date") >= _ts(_day(as_of)))
    )
    return rows.orderBy("appointment_date", "id").limit(k)


def urgent_48h(df: DataFrame, as_of: datetime) -> DataFrame:
    """Scheduled high-risk rows up to the day 48 hours ahead; overdue rows count too."""
    cutoff = _day(as_of + timedelta(hours=48)) + timedelta(days=1)
    return df.filter(
        is_high(F.col("risk_level")) & (F.col("status") == "Scheduled") & (F.col("appointment_date") < _ts(cutoff))
    )


def provider_drilldown(df: DataFrame, provider: str) -> DataFrame:
    """Rows of one provider."""
    return df.filter(F.col("attending_physician") == provider)


def point_lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with one key value."""
    return df.filter(F.col(column) == value)


def filter_outcome_capped(df: DataFrame, target: str, outcome: int, lead: str, cap: int = 180) -> DataFrame:
    """Rows with the given outcome and a lead time up to the cap."""
    return df.filter((F.col(target) == outcome) & (F.col(lead) <= cap))


def predict_class(df: DataFrame, threshold: float = 0.5, p: str = "p") -> DataFrame:
    """Add ``predicted``: 1 where the score reaches the threshold."""
    return df.withColumn("predicted", (F.col(p) >= threshold).cast("int"))


def filter_predicted_positive(df: DataFrame, threshold: float = 0.5, p: str = "p") -> DataFrame:
    """Rows predicted positive."""
    return df.filter(F.col(p) >= threshold)


def overdue_scheduled(df: DataFrame, as_of: datetime) -> DataFrame:
    """Scheduled appointments whose time has passed."""
    return df.filter((F.col("status") == "Scheduled") & (F.col("appointment_date") < _ts(as_of)))


def sort_by_date(df: DataFrame) -> DataFrame:
    """Worklist order: appointment time, then id."""
    return df.orderBy("appointment_date", "id")


def topk_recent(df: DataFrame, k: int = 10) -> DataFrame:
    """The k latest appointments."""
    return df.orderBy(F.desc("appointment_date"), "id").limit(k)


def project_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])
