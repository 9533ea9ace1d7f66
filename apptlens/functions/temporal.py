"""Calendar expressions.

Everything works on TIMESTAMP_NTZ and TIMESTAMP columns alike and returns
integers or text, so results do not depend on a machine's clock or zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO days that count as weekend (Saturday, Sunday).
WEEKEND_DAYS = (6, 7)

# Text layouts accepted for dates, tried in this order.
TIMESTAMP_LAYOUTS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")


def parse_mixed_timestamp(text: Column, layouts: Sequence[str] = TIMESTAMP_LAYOUTS) -> Column:
    """Text in any of the layouts to a timestamp; unreadable text gives null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in layouts]).cast("timestamp_ntz")


def whole_days_between(end: Column, start: Column) -> Column:
    """Whole 24-hour periods from start to end, floored (negative if end is earlier).

    Not ``datediff``: that counts midnights, so 14:00 to 09:00 the next day
    would be one day.
    """
    midnights = F.datediff(end, start)
    reached = start + F.make_dt_interval(midnights) <= end
    return F.when(reached, midnights).when(~reached, midnights - 1)


def lead_time_days(appointment: Column, booking: Column) -> Column:
    """Whole days of notice, never below zero; null if either date is missing."""
    days = whole_days_between(appointment, booking)
    return F.when(days < 0, 0).otherwise(days)


def iso_day_of_week(ts: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(ts) + 1


def is_weekend(iso_dow: Column, weekend: Sequence[int] = WEEKEND_DAYS) -> Column:
    """1 on weekend days, else 0 (a missing day is not a weekend)."""
    return F.coalesce(iso_dow.isin(*weekend).cast("int"), F.lit(0))


def season_bucket(ts: Column) -> Column:
    """Meteorological season of the month."""
    month = F.month(ts)
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.between(3, 5), "Spring")
        .when(month.between(6, 8), "Summer")
        .when(month.between(9, 11), "Fall")
    )


def time_of_day_bucket(hour: Column) -> Column:
    """Coarse part of the day; only a raw-table category, never a model input."""
    return F.when(hour < 12, "Morning").when(hour < 17, "Afternoon").otherwise("Evening")


def zfill(text: Column, width: int) -> Column:
    """Left-pad with zeros; longer text is kept whole (``lpad`` would cut it)."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def year_week_key(ts: Column, iso_year: bool = False) -> Column:
    """``2024-W01``. The year is the calendar year unless ``iso_year`` is set."""
    year = F.extract(F.lit("YEAROFWEEK"), ts) if iso_year else F.year(ts)
    return F.concat_ws("-W", year.cast("string"), zfill(F.weekofyear(ts).cast("string"), 2))


def week_label(ts: Column) -> Column:
    """Monday and Sunday of the row's week, e.g. ``Dec 30 – Jan 05``."""
    monday = F.date_sub(F.to_date(ts), F.weekday(ts))
    return F.concat(F.date_format(monday, "MMM dd"), F.lit(" – "), F.date_format(F.date_add(monday, 6), "MMM dd"))
