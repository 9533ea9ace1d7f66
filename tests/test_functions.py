"""Edge cases of the column functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from apptlens.functions import cleaning, temporal, text, tiers


def _one(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[v.alias(k) for k, v in columns.items()]).collect()]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_lead_time_counts_whole_days(spark, kind):
    rows = [
        (datetime(2024, 5, 2, 9), datetime(2024, 5, 1, 14)),
        (datetime(2024, 5, 2, 14), datetime(2024, 5, 1, 14)),
        (datetime(2024, 5, 2, 13, 59, 59), datetime(2024, 5, 1, 14)),
        (datetime(2024, 5, 1, 9), datetime(2024, 5, 1, 14)),
        (datetime(2024, 4, 1, 9), datetime(2024, 5, 1, 14)),
        (None, datetime(2024, 5, 1, 14)),
    ]
    a, b = F.col("a").cast(kind), F.col("b").cast(kind)
    got = _one(spark, rows, "a timestamp, b timestamp", lead=temporal.lead_time_days(a, b), days=temporal.whole_days_between(a, b))
    assert [g[0] for g in got] == [0, 1, 0, 0, 0, None]
    assert [g[1] for g in got] == [0, 1, 0, -1, -31, None]


def test_year_end_weeks(spark):
    rows = [(datetime(2024, 12, 29),), (datetime(2024, 12, 30),), (datetime(2025, 1, 1),)]
    d = F.col("d")
    got = _one(
        spark, rows, "d timestamp", key=temporal.year_week_key(d), iso=temporal.year_week_key(d, iso_year=True), label=temporal.week_label(d)
    )
    assert got == [
        ("2024-W52", "2024-W52", "Dec 23 – Dec 29"),
        ("2024-W01", "2025-W01", "Dec 30 – Jan 05"),
        ("2025-W01", "2025-W01", "Dec 30 – Jan 05"),
    ]


def test_days_and_weekend(spark):
    rows = [(datetime(2024, 5, 6 + i),) for i in range(7)]
    dow = temporal.iso_day_of_week(F.col("d"))
    got = _one(spark, rows, "d timestamp", dow=dow, weekend=temporal.is_weekend(dow))
    assert got == [(i + 1, int(i >= 5)) for i in range(7)]


def test_mixed_timestamps(spark):
    rows = [("2024-05-01 10:11:12",), ("2024-05-01 10:11:12.123456",), ("2024-05-01T10:11:12",), ("2024-05-01",), ("05/01/2024",), ("soon",), (None,)]
    got = [g[0] for g in _one(spark, rows, "t string", p=temporal.parse_mixed_timestamp(F.col("t")))]
    full, midnight = datetime(2024, 5, 1, 10, 11, 12), datetime(2024, 5, 1)
    assert got == [full, datetime(2024, 5, 1, 10, 11, 12, 123456), full, midnight, midnight, None, None]


def test_zfill_keeps_long_text(spark):
    assert _one(spark, [("7",), ("123456",)], "t string", z=temporal.zfill(F.col("t"), 4)) == [("0007",), ("123456",)]


@pytest.mark.parametrize(
    "values, expected",
    [
        (["45", "90+", " 30 ", "abc", " 90+", None], [45.0, 95.0, 30.0, None, 95.0, None]),
        (["45", " 90+"], [45.0, 90.0]),
    ],
)
def test_clean_age(spark, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, AGE string")
    assert [r.AGE for r in cleaning.clean_age(df).orderBy("i").collect()] == expected


def test_targets(spark):
    rows = [("NOSHOW",), ("No Show",), ("Canceled",), ("CHECKED OUT",), (None,), ("no show / canceled",)]
    s = F.col("s")
    got = _one(spark, rows, "s string", y=cleaning.binary_target(s), three=cleaning.three_way_status(s), text=cleaning.target_class(s))
    assert [g[0] for g in got] == [1, 1, 1, 0, None, 1]
    assert [g[1] for g in got] == ["NOSHOW", "NOSHOW", "CANCELED", "SUCCESS", "Unknown", "NOSHOW"]
    assert [g[2] for g in got] == ["NOT_SUCCESS", "NOT_SUCCESS", "NOT_SUCCESS", "SUCCESS", "Unknown", "NOT_SUCCESS"]


def test_tier_edges(spark):
    rows = [(0.0999,), (0.10,), (0.15,), (0.25,), (0.40,), (1.0,), (None,)]
    t = tiers.risk_tier(F.col("p"))
    got = _one(spark, rows, "p double", t=t, r=tiers.tier_rank(t), h=tiers.is_high(t))
    assert [g[0] for g in got] == ["Very Low", "Low", "Moderate", "High", "Very High", "Very High", None]
    assert [g[1] for g in got] == [1, 2, 3, 4, 5, 5, None]
    assert [g[2] for g in got] == [False, False, False, True, True, True, False]


def test_rounding_and_ratio(spark):
    got = _one(
        spark, [(12.25, 0.0), (12.35, 2.0)], "a double, b double",
        r=cleaning.round_n(F.col("a"), 1), q=cleaning.safe_ratio(F.col("a"), F.col("b"), 0.211), c=cleaning.clip_lower(F.col("b"), 1.0),
    )
    assert got[0] == (12.2, 0.211, 1.0)
    assert got[1][1:] == (12.35 / 2, 2.0)


def test_texts(spark):
    got = _one(
        spark, [(0.123, 1.409)], "a double, b double",
        p=text.as_percent(F.col("a")), m=text.as_multiple(F.col("b")), s=text.as_signed(-F.col("a")), r=text.as_range(F.col("a"), F.col("b")),
    )
    assert got == [("12.3%", "1.41x", "-0.123", "0.12 – 1.41")]


def test_decoded_values(spark):
    rows = [("APPT_DOW", 7.0, None), ("IS_WEEKEND", 1.0, None), ("PATIENT_NOSHOW_RATE", 0.25, None), ("SEX", 1.0, "M"), ("APPT_HOUR", 9.0, None), ("ODD", 1.0, None)]
    got = _one(spark, rows, "f string, n double, c string", v=text.decode_feature_value(F.col("f"), F.col("n"), F.col("c")))
    assert [g[0] for g in got] == ["Sun", "Yes", "25.0%", "M", "9", ""]
