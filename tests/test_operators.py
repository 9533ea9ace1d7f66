"""Behaviour of filters, history, trend, profile, splits and encoders."""

from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from apptlens.operators import encode, filters, history, kpi, profile, providers, splits, trend


@pytest.fixture(scope="module")
def worklist(spark):
    rows = [
        (1, "P125", "High", "Scheduled", datetime(1999, 5, 1, 9)),
        (2, "p1x5", "Very High", "Scheduled", datetime(1999, 6, 3, 23, 59)),
        (3, None, "High", "Scheduled", datetime(1999, 6, 4, 0, 0)),
        (4, "Q200", "High", "Completed", datetime(1999, 6, 1, 8)),
        (5, "Q300", None, "Scheduled", datetime(1999, 6, 2, 8)),
        (6, "Q400", "Low", None, None),
    ]
    return spark.createDataFrame(rows, "id int, patient_id string, risk_level string, status string, t timestamp").withColumn(
        "appointment_date", F.col("t").cast("timestamp_ntz")
    )


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_search_is_a_pattern(worklist):
    assert _ids(filters.search_patient(worklist, "1.")) == [1, 2]
    assert _ids(filters.search_patient(worklist, "p1.5")) == [1, 2]
    assert _ids(filters.search_patient(worklist, "1.", literal=True)) == []
    assert _ids(filters.search_patient(worklist, "  ")) == [1, 2, 3, 4, 5, 6]


def test_empty_lists(worklist):
    assert _ids(filters.filter_multi_select(worklist, {"risk_level": ["High"]}, {"status": []})) == [1, 3, 4]
    assert _ids(filters.filter_multi_select(worklist, {"risk_level": []}, {"status": ["Scheduled"]})) == []


def test_urgent_includes_overdue(worklist):
    assert _ids(filters.urgent_48h(worklist, datetime(1999, 6, 1, 12))) == [1, 2]
    assert _ids(filters.overdue_scheduled(worklist, datetime(1999, 6, 1, 12))) == [1]
    assert _ids(filters.upcoming_high_risk(worklist, datetime(1999, 6, 1, 12))) == [2, 3]


def test_date_range_is_inclusive(worklist):
    assert _ids(filters.filter_date_range(worklist, date(1999, 6, 1), date(1999, 6, 3))) == [2, 4, 5]


def test_own_outcome_never_counts(spark):
    rows = [(i, "a" if i < 3 else "b", i, y) for i, y in enumerate([1, 0, 1, 0, 1])]
    df = spark.createDataFrame(rows, "id int, k string, t int, y int")
    flipped = df.withColumn("y", F.when(F.col("id") == 2, 1 - F.col("y")).otherwise(F.col("y")))

    def rates(x):
        return [r.patient_rate for r in history.prior_patient_rate(x, "k", "y", ["t"], count_name="seen").orderBy("id").collect()]

    assert rates(df) == [0.0, 1.0, 0.5, 0.0, 0.0]
    assert rates(flipped) == rates(df)
    by_provider = history.prior_provider_rate(df, "k", "y", ["t"]).orderBy("id").collect()
    assert [r.provider_rate for r in by_provider] == [0.6, 1.0, 0.5, 0.6, 0.0]


def test_enrich_history_defaults(spark):
    known = spark.createDataFrame([("p", "d", "No-Show"), ("p", "d", "Scheduled"), ("q", None, "Completed")], "patient_id string, attending_physician string, status string")
    new = spark.createDataFrame([(1, "p", "d"), (2, "zz", "zz"), (3, None, None)], "id int, patient_id string, attending_physician string")
    got = [tuple(r)[-3:] for r in history.enrich_history(new, known).orderBy("id").collect()]
    assert got == [(2, 0.5, 0.5), (0, 0.0, 0.211), (0, 0.0, 0.211)]
    resolved = history.enrich_history(new, known, resolved_only=True).orderBy("id").first()
    assert (resolved.patient_visits, resolved.patient_rate) == (1, 1.0)


def test_calendar_year_end(spark):
    days = [datetime(2024, 1, 2), datetime(2024, 12, 30), datetime(2024, 12, 31)]
    df = spark.createDataFrame([(d, 0.5) for d in days], "appointment_date timestamp, predicted_risk_prob double")
    cal = trend.with_week_keys(trend.calendar_values(df, "volume"))
    assert trend.distinct_pairs(cal).count() == 2
    wide = trend.calendar_pivot(cal)
    assert wide.count() == 7 and wide.columns == ["day_of_week", "2024-W01"]


def test_week_label_of_later_pair_wins(spark):
    days = [datetime(2024, 1, 1), datetime(2024, 12, 30)]
    df = spark.createDataFrame([(d, 0.5) for d in days], "appointment_date timestamp, predicted_risk_prob double")
    cal = trend.with_week_keys(trend.calendar_values(df, "volume"))
    assert trend.week_labels(cal).first().week_label == "Dec 30 – Jan 05"


def test_rolling_mean_is_over_rows(spark):
    daily = spark.createDataFrame([(date(2024, 1, 1 + 3 * i), 1, float(i)) for i in range(9)], "date_only date, appts int, avg_risk double")
    got = [r.rolling_risk for r in trend.rolling_mean(daily).orderBy("date_only").collect()]
    assert got == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0]


def test_tier_distribution_gaps(spark):
    df = spark.createDataFrame([("High",), ("High",), ("Low",), (None,)], "risk_level string")
    assert [tuple(r) for r in kpi.tier_distribution(df).collect()] == [("Low", 2, 1, 1 / 3), ("High", 4, 2, 2 / 3)]
    assert [r.n for r in kpi.tier_distribution(df, keep_empty=True).collect()] == [0, 1, 0, 2, 0]


def test_kpis_of_nothing(spark):
    df = spark.createDataFrame([], "risk_level string, predicted_risk_prob double, status string")
    k = kpi.kpi_overview(df).first()
    assert (k.total, k.high_risk_share, k.avg_risk, k.no_show_rate) == (0, 0.0, None, 0.0)


def test_quadrants(spark):
    rows = [(i, f"d{i % 3}", 0.3, "High" if i % 3 == 0 else "Low") for i in range(9)]
    df = spark.createDataFrame(rows, "id int, attending_physician string, predicted_risk_prob double, risk_level string")
    q = {r.attending_physician: (r.flagged, r.quadrant) for r in providers.quadrant_flags(providers.provider_stats(df)).collect()}
    assert q["d0"] == (1, "High Volume, High Risk")


@pytest.mark.parametrize("values", [[1, 1, 1, 1, 2, 3, 3, 9], list(range(40)), [5, 5, 5]])
def test_quantile_bins_match_pandas(spark, values):
    pdf = pd.DataFrame({"x": [float(v) for v in values], "y": [i % 2 for i in range(len(values))]})
    got = profile.rate_by_quantile_bin(spark.createDataFrame(pdf), "x", "y", 4).orderBy("bin").collect()
    if pdf.x.nunique() == 1:
        assert [r.n for r in got] == [len(values)]
        return
    want = pdf.groupby(pd.qcut(pdf.x, 4, duplicates="drop"), observed=True)["y"].agg(["count", "mean"])
    assert [(r.n, r.rate) for r in got] == [tuple(w) for w in want.itertuples(index=False)]


def test_profiles(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 2.0, 5.0, 11.0, None]})
    p = profile.profile_numeric(spark.createDataFrame([(v,) for v in [1.0, 2.0, 2.0, 5.0, 11.0, None]], "x double"), ["x"]).first()
    s = pdf.x
    assert (p["count"], p.null_count, p.unique_count, p.median) == (5, 1, 4, 2.0)
    assert p["std"] == pytest.approx(s.std()) and p.skewness == pytest.approx(s.skew()) and p.kurtosis == pytest.approx(s.kurtosis())
    c = profile.profile_categorical(spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string"), ["c"]).first()
    assert (c.mode, c.mode_frequency, c.unique_count, c.null_count, c.null_pct, c.top_values) == ("a", 2, 2, 1, 20.0, "a, b")


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.15, 0.95, 1.0)], "p double")
    assert {r.bin: r.n for r in profile.histogram_steps(df, "p").collect()} == {0: 1, 2: 1, 3: 1, 19: 2}
    assert {r.bin: r.n for r in profile.histogram(df, "p", 2).collect()} == {0: 3, 1: 2}


def test_splits_are_repeatable_and_exact(spark):
    df = spark.range(1000).select("id", F.pmod("id", F.lit(4)).cast("int").alias("raw")).withColumn("y", (F.col("raw") == 0).cast("int"))
    one = splits.split_stratified_3way(df, "y", "id")
    two = splits.split_stratified_3way(df.repartition(7), "y", "id", rows_per_range=90)
    assert one.exceptAll(two).count() == 0
    sizes = {(r.y, r.part): r["count"] for r in one.groupBy("y", "part").count().collect()}
    assert sizes == {(1, "test"): 50, (1, "calibration"): 40, (1, "train"): 160, (0, "test"): 150, (0, "calibration"): 120, (0, "train"): 480}
    sample = splits.stratified_sample(df, "y", "id", 100).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in sample} == {0: 75, 1: 25}
    folds = splits.kfold_stratified(df, "y", "id", 3).groupBy("y", "fold").count().collect()
    assert all(r["count"] in (83, 84, 250) for r in folds)
    groups = splits.split_by_group(df, "raw")
    assert {r.side: r["count"] for r in groups.groupBy("side").count().collect()} == {"test": 1, "train": 3}


def test_unseen_label_takes_the_first_class(spark):
    enc = encode.label_encode_fit(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string"), ["c"])
    assert [tuple(r) for r in encode.encoding_map(enc, "c").collect()] == [("a", 0), ("b", 1)]
    rows = spark.createDataFrame([(1, "b"), (2, "new"), (3, None)], "id int, c string")
    coded = encode.label_encode_apply(rows, enc, ["c"])
    assert [r.c for r in coded.orderBy("id").collect()] == [1, 0, 0]
    assert [r.c for r in encode.label_decode(coded, enc, ["c"]).orderBy("id").collect()] == ["b", "a", "a"]


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "i int, s string, d double")
    assert encode.select_by_type(df) == {"text": ["s"], "numeric": ["i", "d"]}
    assert encode.except_columns(df.columns, ["s"]) == ["i", "d"]
    assert encode.align_features(df, ["d", "zz", "i"]).first() == (2.0, 0, 1)


def _watched(spark, rows):
    """A frame that counts how many of its rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(rows, "x double, y int")
    return frame.mapInArrow(pass_on, frame.schema), seen


def test_profiles_compute_their_input_once(spark):
    rows = [(float(i % 10) if i % 7 else None, i % 2) for i in range(100)]
    frame, seen = _watched(spark, rows)
    got = profile.profile_numeric(frame, ["x"]).first()
    assert (got["count"], got["null_count"], got["unique_count"], seen.value) == (85, 15, 10, 100)
    frame, seen = _watched(spark, rows)
    bins = profile.rate_by_quantile_bin(frame, "x", "y", 4).collect()
    assert sum(r["n"] for r in bins) == 85 and seen.value == 100
