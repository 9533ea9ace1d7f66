"""History as of a moment, and kept counts in place of the history."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from apptlens.operators import history
from apptlens.plans import features
from apptlens.plans.catalog import filters_joins
from apptlens.plans.registry import QUERIES
from apptlens.schemas import APPOINTMENTS_SCHEMA
from apptlens.session import materialize, shared_dir
from apptlens.sources import star
from apptlens.sources.history_state import HistoryState, day_counts

START = datetime(2024, 1, 1)
SCHEMA = "id long, patient_id string, attending_physician string, status string, appointment_date timestamp_ntz, booking_date timestamp_ntz"


def table(n, seed=1):
    """A third of all rows in one provider, missing keys and times, many ties."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(hours=rng.randint(0, 24 * 20))
        rows.append(
            (
                i,
                rng.choice([None, *[f"p{k}" for k in range(30)]]),
                "hot" if rng.random() < 0.34 else rng.choice([None, "d1", "d2", "d3"]),
                rng.choice(["No-Show", "Completed", "Scheduled", None]),
                None if rng.random() < 0.03 else at,
                None if rng.random() < 0.03 else at - timedelta(hours=rng.randint(0, 100)),
            )
        )
    return rows


def rates(rows, i, resolved_only, before):
    """By looking at every row."""
    out = []
    for key, base in ((1, 0.0), (2, 0.211)):
        mine = [r for r in rows if r[key] is not None and r[key] == i[key]]
        if resolved_only:
            mine = [r for r in mine if r[3] not in (None, "Scheduled")]
        mine = [r for r in mine if before(r, i)]
        out.append((len(mine), sum(r[3] == "No-Show" for r in mine) / len(mine) if mine else base))
    return out[0][0], out[0][1], out[1][1]


def found(df):
    return {r.id: (r.patient_visits, r.patient_rate, r.provider_rate) for r in df.collect()}


@pytest.mark.parametrize("resolved_only", [False, True])
@pytest.mark.parametrize("few, rows_per_range", [(100_000, 2_000_000), (0, 60)])
def test_as_of_the_booking(spark, monkeypatch, few, rows_per_range, resolved_only):
    monkeypatch.setattr(history, "FEW_ROWS", few)
    rows = table(700)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = found(history.enrich_history(df, df, resolved_only=resolved_only, before="booking_date", rows_per_range=rows_per_range))

    def earlier(r, i):
        return r[4] is not None and i[5] is not None and r[4] < i[5]

    assert len(got) == 700
    for i in rows:
        assert got[i[0]] == pytest.approx(rates(rows, i, resolved_only, earlier))


def test_first_visits_and_empty_history(spark):
    df = spark.createDataFrame(table(50), SCHEMA)
    got = found(history.enrich_history(df, df.limit(0), before="booking_date"))
    assert set(got.values()) == {(0, 0.0, 0.211)}
    assert found(history.enrich_history(df.limit(0), df, before="booking_date")) == {}


def test_serving_agrees_with_training(spark):
    """A row's rate as of its own time is the running rate it is trained with."""
    rows = [r for r in table(400, 7) if r[4] is not None and r[1] and r[3] in ("No-Show", "Completed")]
    times = {}
    rows = [r for r in rows if times.setdefault((r[1], r[4]), r[0]) == r[0]]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("y", (F.col("status") == "No-Show").cast("int"))
    trained = history.prior_patient_rate(df, "patient_id", "y", ["appointment_date", "id"])
    served = history.enrich_history(df, df, resolved_only=True, before="appointment_date")
    pairs = trained.select("id", F.col("patient_rate").alias("trained")).join(served.select("id", "patient_rate"), "id")
    assert pairs.count() == len(rows) and pairs.filter(F.abs(F.col("trained") - F.col("patient_rate")) > 1e-12).isEmpty()


@pytest.fixture(scope="module")
def dated():
    return [r for r in table(900, 3) if r[4] is not None]


def state_rows(state):
    return sorted((k, *r) for k in ("patient", "provider") for r in state.totals(k).collect())


def at(day):
    return F.to_date("appointment_date") <= F.lit(day)


def test_three_days_equal_a_rebuild(spark, dated):
    df = spark.createDataFrame(dated, SCHEMA)
    state, whole = (HistoryState(spark, shared_dir(spark, "state")) for _ in range(2))
    state.rebuild(df, date(2024, 1, 10))
    for day in (11, 12, 13):
        state.refresh(df.filter(at(date(2024, 1, day))))
    whole.rebuild(df, date(2024, 1, 13))
    assert state_rows(state) == state_rows(whole)
    assert (state.upto(), state.last_day()) == (date(2024, 1, 10), date(2024, 1, 13))
    # Again: nothing changes. Later days: counted too. Merged: the same totals.
    state.refresh(df.filter(at(date(2024, 1, 13))))
    assert state_rows(state) == state_rows(whole)
    state.refresh(df)
    before = state_rows(state)
    state.compact(date(2024, 1, 15))
    assert state.upto() == date(2024, 1, 15) and state_rows(state) == before
    whole.rebuild(df, date(2024, 1, 31))
    assert state_rows(whole) == before
    for late in (date(2024, 1, 15), date(2024, 1, 2)):
        with pytest.raises(ValueError):
            state.compact(late)


def test_refresh_reads_and_writes_new_days_only(spark, dated):
    df = spark.createDataFrame(dated, SCHEMA)
    state = HistoryState(spark, shared_dir(spark, "state"))
    state.rebuild(df, date(2024, 1, 10))
    state.refresh(df.filter(at(date(2024, 1, 12))))

    def files():
        days = spark.read.parquet(f"{state.path}/days")
        return {(r.day, r.f) for r in days.select("day", F.input_file_name().alias("f")).distinct().collect()}

    before = files()
    state.refresh(df)
    after = files()
    assert {f for f in before if f[0] < date(2024, 1, 12)} <= after
    assert not {f for f in before if f[0] == date(2024, 1, 12)} & after
    # A day whose rows were resolved since is counted again by itself.
    day = date(2024, 1, 15)
    changed = df.withColumn("status", F.when(F.to_date("appointment_date") == F.lit(day), "No-Show").otherwise(F.col("status")))
    state.refresh(changed, days=[day])
    rebuilt = HistoryState(spark, shared_dir(spark, "state"))
    rebuilt.rebuild(changed, date(2024, 1, 31))
    assert state_rows(state) == state_rows(rebuilt)
    assert {f for f in after if f[0] != day} <= files()
    with pytest.raises(ValueError):
        state.refresh(changed, days=[date(2024, 1, 9)])


@pytest.mark.parametrize("resolved_only", [False, True])
def test_lookups_agree_with_the_history(spark, dated, resolved_only):
    df = spark.createDataFrame(dated, SCHEMA)
    state = HistoryState(spark, shared_dir(spark, "state"))
    state.rebuild(df, date(2024, 1, 6))
    state.refresh(df)
    want = found(history.enrich_history(df, df, resolved_only=resolved_only))
    assert found(state.enrich(df, resolved_only=resolved_only, hot_rows=100)) == want
    late = [r for r in dated if r[5] is None or r[5].date() > date(2024, 1, 6)]

    def earlier(r, i):
        return i[5] is not None and r[4].date() < i[5].date()

    got = found(state.enrich(spark.createDataFrame(late, SCHEMA), resolved_only=resolved_only, before="booking_date", rows_per_range=50))
    for i in late:
        assert got[i[0]] == pytest.approx(rates(dated, i, resolved_only, earlier))
    with pytest.raises(PySparkException, match="are merged"):
        state.enrich(df, before="booking_date").collect()


def test_a_lookup_does_not_scan_the_history(spark, sf_dir):
    path = shared_dir(spark, "plain")
    star.appointments(spark, sf_dir).select(*APPOINTMENTS_SCHEMA.fieldNames()).write.parquet(path)
    rows = spark.read.schema(APPOINTMENTS_SCHEMA).parquet(path)
    state = HistoryState(spark, shared_dir(spark, "state"))
    state.rebuild(rows, date(1997, 1, 1))
    state.refresh(rows.filter(at(date(1997, 1, 20))))
    bookings = spark.createDataFrame(rows.limit(20).collect(), APPOINTMENTS_SCHEMA)
    read = features.booking_inputs(bookings, state).inputFiles()
    assert read and all(state.path in f for f in read)
    assert any(path in f for f in features.booking_inputs(bookings, rows).inputFiles())
    refreshed = day_counts(rows.filter(F.col("appointment_date") >= F.lit("1997-01-20").cast("timestamp_ntz")))
    plan = refreshed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(appointment_da" in plan[plan.index("PushedFilters") :]


def test_base_is_counted_without_days(spark, monkeypatch):
    handed = []
    write = HistoryState._write_base

    def watched(self, counts, upto):
        handed.append(counts.count())
        write(self, counts, upto)

    monkeypatch.setattr(HistoryState, "_write_base", watched)
    rows = [(i, f"p{i % 3}", "d", "No-Show" if i % 4 == 0 else "Completed", START + timedelta(days=i), START) for i in range(40)]
    state = HistoryState(spark, shared_dir(spark, "state"))
    state.rebuild(spark.createDataFrame(rows, SCHEMA), (START + timedelta(days=40)).date())
    # One row per key: three patients and a provider, not one per key and day.
    assert handed == [4]
    assert {tuple(r) for r in state.totals("provider").select("total", "no_shows").collect()} == {(40, 10)}


def test_rows_as_of_a_moment_come_from_a_stored_table(spark, sf_dir, monkeypatch):
    stored = []
    for module in (filters_joins, history):
        monkeypatch.setattr(module, "materialize", lambda df, purpose: stored.append(purpose) or materialize(df, purpose))
    out = QUERIES["enrich_history_asof"](spark, sf_dir)
    assert stored == ["appointments", "known"]
    assert "Join Inner" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rows_as_of_a_moment_keep_their_types(spark):
    """Also where the facts have the key and the moment in other types."""
    rows = spark.sql("SELECT * FROM VALUES (1, date'2024-01-03', 'x'), (2, null, 'y'), (null, date'2024-01-05', 'z') AS t(k, on, more)")
    facts = spark.sql("SELECT cast(k AS long) AS k, cast(at AS timestamp_ntz) AS at, 1 AS seen, 1 AS hits FROM VALUES (1, date'2024-01-02'), (1, date'2024-01-03'), (2, date'2024-01-01') AS t(k, at)")
    for told in (facts, facts.select(F.col("k").cast("int").alias("k"), F.col("at").cast("date").alias("at"), "seen", "hits")):
        out = history.known_before(rows, told, "k", "on", "n", "h")
        assert [f.dataType for f in out.schema[:3]] == [f.dataType for f in rows.schema[:3]]
        assert {(r.k, r.more, r.n, r.h) for r in out.collect()} == {(1, "x", 1, 1), (2, "y", 0, 0), (None, "z", 0, 0)}
