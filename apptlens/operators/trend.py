"""Daily trend and the calendar view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apptlens.functions.temporal import lead_time_days, week_label, year_week_key

CALENDAR_KEYS = ["year", "week_year", "day_of_week", "date_only"]


def daily_trend(df: DataFrame) -> DataFrame:
    """Scored rows and mean score per appointment day."""
    rows = df.filter(F.col("appointment_date").isNotNull())
    return rows.groupBy(F.to_date("appointment_date").alias("date_only")).agg(
        F.count("predicted_risk_prob").alias("appts"), F.avg("predicted_risk_prob").alias("avg_risk")
    )


def rolling_mean(daily: DataFrame, days: int = 7) -> DataFrame:
    """Mean of the last ``days`` rows present (not calendar days), unweighted.

    The input has one row per calendar day, a few hundred per year of data
    however many appointments there are, so one sorted partition is enough.
    """
    last = Window.orderBy("date_only").rowsBetween(1 - days, 0)
    return daily.withColumn("rolling_risk", F.avg("avg_risk").over(last))


def with_calendar_keys(df: DataFrame) -> DataFrame:
    """Add year, ISO week, 0-based weekday and date of the appointment."""
    ts = F.col("appointment_date")
    return df.filter(ts.isNotNull()).withColumns(
        {
            "year": F.year(ts),
            "week_year": F.weekofyear(ts),
            "day_of_week": F.weekday(ts),
            "date_only": F.to_date(ts),
        }
    )


def calendar_values(df: DataFrame, metric: str) -> DataFrame:
    """One value per calendar day: volume, avg_risk, avg_lead or providers."""
    value = {
        "volume": lambda: F.count("*"),
        "avg_risk": lambda: F.avg("predicted_risk_prob"),
        "avg_lead": lambda: F.avg(lead_time_days(F.col("appointment_date"), F.col("booking_date"))),
        "providers": lambda: F.count_distinct("attending_physician"),
    }[metric]
    return with_calendar_keys(df).groupBy(*CALENDAR_KEYS).agg(value().alias("value"))


def with_week_keys(cal: DataFrame) -> DataFrame:
    """Add the sortable week key and the readable week label."""
    day = F.col("date_only")
    return cal.withColumns({"year_week": year_week_key(day), "week_label": week_label(day)})


def distinct_pairs(cal: DataFrame) -> DataFrame:
    """Distinct (week key, label) pairs; a year-end key can have two labels."""
    return cal.select("year_week", "week_label").dropDuplicates()


def week_labels(cal: DataFrame) -> DataFrame:
    """One label per week key: the pair that appears last in calendar order wins."""
    first = cal.groupBy("year_week", "week_label").agg(F.min(F.struct("day_of_week", "date_only")).alias("at"))
    return first.groupBy("year_week").agg(F.max_by("week_label", "at").alias("week_label"))


def cell_values(cal: DataFrame) -> DataFrame:
    """Mean value and first date of each (weekday, week key) cell."""
    return cal.groupBy("day_of_week", "year_week").agg(
        F.avg("value").alias("value"), F.min("date_only").alias("first_date")
    )


def calendar_pivot(cal: DataFrame, weeks: Sequence[str] | None = None) -> DataFrame:
    """Weekday rows (always seven) by week columns.

    Without an explicit week list, the weeks present are looked up first; a
    century of data has about 5,300 of them.
    """
    if weeks is None:
        weeks = [r.year_week for r in cal.select("year_week").distinct().orderBy("year_week").collect()]
    wide = cal.groupBy("day_of_week").pivot("year_week", list(weeks)).agg(F.avg("value"))
    days = cal.sparkSession.range(7).select(F.col("id").cast("int").alias("day_of_week"))
    return days.join(wide, "day_of_week", "left").orderBy("day_of_week")
