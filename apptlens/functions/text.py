"""Readable text for numbers and feature values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day names by ISO day, 1 = Monday.
DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def as_percent(share: Column, digits: int = 1) -> Column:
    """0.123 to ``12.3%``."""
    return F.format_string(f"%.{digits}f%%", share.cast("double") * 100)


def as_multiple(x: Column, digits: int = 2) -> Column:
    """1.41 to ``1.41x``."""
    return F.format_string(f"%.{digits}fx", x.cast("double"))


def as_range(lo: Column, hi: Column) -> Column:
    """0.1 and 0.15 to ``0.10 – 0.15``."""
    return F.format_string("%.2f – %.2f", lo, hi)


def as_signed(x: Column, digits: int = 3) -> Column:
    """0.1234 to ``+0.123``."""
    return F.format_string(f"%+.{digits}f", x.cast("double"))


def decode_feature_value(feature: Column, number: Column, category: Column) -> Column:
    """Readable value of a model input.

    ``number`` is the numeric model input, ``category`` the original text of
    an encoded one. Days become names, flags Yes/No, rates percentages.
    """
    whole = F.format_string("%.0f", number.cast("double"))
    days = F.array(*[F.lit(x) for x in DAY_NAMES])
    return (
        F.when(feature == "APPT_DOW", F.get(days, number.cast("int") - 1))
        .when(feature == "IS_WEEKEND", F.when(number == 1, "Yes").otherwise("No"))
        .when(feature.isin("PATIENT_NOSHOW_RATE", "PHYSICIAN_NOSHOW_RATE"), as_percent(number))
        .when(feature.isin("AGE", "LEAD_TIME_DAYS", "APPT_HOUR", "APPT_COUNT_BY_PATIENT"), whole)
        .otherwise(F.coalesce(category, F.lit("")))
    )
