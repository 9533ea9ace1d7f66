"""Cleaning and mapping expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text for ages above the top code, and what it stands for.
TOP_AGE_TEXT = "90+"
TOP_AGE_SEEN = 95
TOP_AGE_PADDED_ONLY = 90


def coerce_numeric(col: Column) -> Column:
    """Number from text; text that is not a number becomes null."""
    return col.try_cast("double")


def clean_age(df: DataFrame, column: str = "AGE") -> DataFrame:
    """Replace the top-coded age text by a number and cast the rest.

    The top code stands for 95 when the exact text occurs anywhere in the
    table and for 90 otherwise (then only padded forms of it exist).
    """
    seen = df.select(F.coalesce(F.bool_or(F.col(column) == TOP_AGE_TEXT), F.lit(False))).scalar()
    text = F.trim(F.col(column))
    top = F.when(seen, F.lit(float(TOP_AGE_SEEN))).otherwise(F.lit(float(TOP_AGE_PADDED_ONLY)))
    return df.withColumn(column, F.when(text == TOP_AGE_TEXT, top).otherwise(coerce_numeric(text)))


def _is_no_show(status: Column) -> Column:
    return F.upper(status).rlike("NO ?SHOW")


def _is_canceled(status: Column) -> Column:
    return F.upper(status).contains("CANCEL")


def binary_target(status: Column) -> Column:
    """1 for a no-show or cancellation, 0 for any other status, null if unknown."""
    return F.when(_is_no_show(status) | _is_canceled(status), 1).when(status.isNotNull(), 0)


def three_way_status(status: Column) -> Column:
    """NOSHOW, CANCELED, SUCCESS, or Unknown for a missing status."""
    return (
        F.when(status.isNull(), "Unknown")
        .when(_is_no_show(status), "NOSHOW")
        .when(_is_canceled(status), "CANCELED")
        .otherwise("SUCCESS")
    )


def target_class(status: Column) -> Column:
    """The target as text: NOT_SUCCESS, SUCCESS, or Unknown."""
    target = binary_target(status)
    return F.when(target == 1, "NOT_SUCCESS").when(target == 0, "SUCCESS").otherwise("Unknown")


def map_values(col: Column, mapping: Mapping) -> Column:
    """Look each value up in a small fixed mapping; others become null."""
    first, *rest = mapping.items()
    chain = F.when(col == first[0], first[1])
    for key, value in rest:
        chain = chain.when(col == key, value)
    return chain


def fill_null(col: Column, value) -> Column:
    """A default in place of null."""
    return F.coalesce(col, F.lit(value))


def clip_lower(col: Column, floor) -> Column:
    """Raise values below the floor to it; null stays null."""
    return F.when(col < floor, F.lit(floor)).otherwise(col)


def safe_ratio(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """A quotient with a default where there is nothing to divide by."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(default).cast("double"))


def round_n(col: Column, digits: int) -> Column:
    """Round with ties to the even digit."""
    return F.bround(col, digits)
