"""Running totals, lookups and percentiles under skew, against plain windows."""

import re
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from apptlens.operators import prefix


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 rows: a third in one key, some without a key, tied order values."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 41 == 0, None).otherwise(F.concat(F.lit("k"), (i % 97).cast("string")))
    return spark.range(6000).select(
        "id", key.alias("k"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("t"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).alias("y")
    )


@pytest.mark.parametrize("rows_per_range", [10_000, 500, 60])
@pytest.mark.parametrize("keys", [["k"], []])
def test_running_totals(skewed, keys, rows_per_range):
    got = prefix.running_totals(skewed, keys, ["t", "id"], {"s": F.col("y"), "n": F.lit(1)}, rows_per_range)
    w = Window.partitionBy(*keys).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select("*", F.coalesce(F.sum("y").over(w), F.lit(0)).alias("s"), F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0)).alias("n"))
    assert got.exceptAll(want).count() == 0
    assert got.count() == 6000


def test_hot_key_is_split(skewed):
    """No task of the split window sorts more than a few ranges' worth of rows."""
    work = skewed.select("*", F.col("k").alias("__k0"), F.col("t").alias("__o0"), F.col("id").alias("__o1"))
    cuts = prefix._sampled_cuts(work, 1, 2, 6000, 200)
    assert set(cuts) == {("hot",)}
    sizes = prefix._attach_ranges(work, 1, 2, cuts).groupBy("k", "__r").count().agg(F.max("count")).first()[0]
    assert sizes < 3 * 200


def test_split_plan_has_no_single_partition_sort_of_rows(skewed):
    got = prefix.running_totals(skewed, [], ["t", "id"], {"s": F.col("y")}, 500)
    plan = got._jdf.queryExecution().executedPlan().toString()
    for line_no, line in enumerate(plan.splitlines()):
        if "Exchange SinglePartition" in line:
            # Only the per-range totals may meet in one partition.
            assert "HashAggregate" in plan.splitlines()[line_no + 1]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 5)), min_size=1, max_size=60), st.integers(1, 20))
def test_running_totals_any_data(spark, rows, rows_per_range):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "id int, k string, v int")
    got = prefix.running_totals(df, ["k"], ["v", "id"], {"s": F.col("v")}, rows_per_range).collect()
    for r in got:
        assert r.s == sum(v for i, (k, v) in enumerate(rows) if k == r.k and (v, i) < (r.v, r.id))


@pytest.mark.parametrize("hot_rows", [100, 1_000_000])
def test_lookup(skewed, hot_rows):
    groups = skewed.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.sum("y").alias("ys"))
    got = prefix.lookup(skewed, groups, ["k"], "n", hot_rows)
    want = skewed.join(groups, "k", "left").select(got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 6000


def test_lookup_shuffles_on_key_and_salt(spark, skewed):
    groups = skewed.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = prefix.lookup(skewed, groups, ["k"], "n", 100)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(k#\d+, __salt#\d+L", plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("rows_per_range", [10, 10_000])
def test_percentiles(skewed, rows_per_range):
    got = prefix.percentiles(skewed.filter("k is not null"), ["k"], "t", {"q1": 0.25, "m": 0.5, "hi": 1.0}, rows_per_range)
    rows = skewed.filter("k is not null").collect()
    for r in got.collect():
        values = sorted(x.t for x in rows if x.k == r.k)
        assert r.n == len(values) and r.m == statistics.median(values) and r.hi == values[-1]
        assert r.q1 == pytest.approx(statistics.quantiles(values, n=4, method="inclusive")[0])


def test_scalars(spark):
    df = prefix.scalars(spark.range(3), spark.range(5).agg(F.max("id").alias("top"), F.count("*").alias("n")))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(0, 4, 5), (1, 4, 5), (2, 4, 5)]


@pytest.fixture(scope="module")
def continuous(spark):
    """All values distinct but for the ties of one key; a third of the rows in one key, some without a key."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 41 == 0, None).otherwise(F.concat(F.lit("k"), (i % 5).cast("string")))
    noise = F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double") / 1000 - 5e8
    value = F.when(key == "k1", F.floor(noise / 1e8).cast("double")).when(i % 97 == 0, None).otherwise(noise)
    return spark.range(30_000).select("id", key.alias("k"), value.alias("v"))


POINTS = {"lo": 0.0, "q1": 0.25, "m": 0.5, "q999": 0.999, "hi": 1.0}


def interpolated(values, q):
    place = (len(values) - 1) * q
    lo = values[int(place)]
    return lo + (values[-int(-place // 1)] - lo) * (place - int(place))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("accuracy", [10_000, 200])
def test_bracketed_percentiles(continuous, monkeypatch, keys, accuracy):
    monkeypatch.setattr(prefix, "_counted_percentiles", None)
    got = prefix.percentiles(continuous, keys, "v", POINTS, 500, accuracy).collect()
    rows = [r for r in continuous.collect() if r.v is not None]
    assert len(got) == (len({r.k for r in rows}) if keys else 1)
    for r in got:
        values = sorted(x.v for x in rows if not keys or x.k == r.k)
        assert r.n == len(values)
        for name, q in POINTS.items():
            assert r[name] == pytest.approx(interpolated(values, q), rel=1e-12)


def test_brackets_and_counts_agree(continuous):
    brackets = prefix._bracketed_percentiles(continuous.select("k", F.col("v").alias("__v")).dropna(subset=["__v"]), ["k"], POINTS, 500, 300)
    counts = prefix._counted_percentiles(continuous.select("k", F.col("v").alias("__v")).dropna(subset=["__v"]), ["k"], POINTS, 500)
    assert sorted(map(str, brackets.collect())) == sorted(map(str, counts.collect()))


def test_brackets_that_miss_lead_back_to_counts(continuous, monkeypatch):
    monkeypatch.setattr(prefix.F, "percentile_approx", lambda *_: F.array(*[F.lit(0.5)] * 10))
    got = prefix.percentiles(continuous, [], "v", POINTS, 500).collect()
    monkeypatch.undo()
    assert got == prefix.percentiles(continuous, [], "v", POINTS, 500).collect()


def test_brackets_shuffle_few_values(spark, continuous, monkeypatch):
    """What is stored between the passes does not grow with the distinct values."""
    kept = {}

    def stored(df, purpose, write=prefix.materialize):
        out = write(df, purpose)
        kept[purpose] = out.count()
        return out

    monkeypatch.setattr(prefix, "materialize", stored)
    prefix.percentiles(continuous, [], "v", {"m": 0.5}, 500, 1_000)
    assert 0 < kept["bracketed"] < 30_000 * 0.02 and "counts" not in kept


def test_percentiles_of_nothing(continuous):
    none = continuous.filter("v is null")
    assert prefix.percentiles(none, ["k"], "v", {"m": 0.5}).collect() == []
    wide = prefix.percentiles(continuous.filter("id < 3"), ["id"], "v", {"m": 0.5}, 1)
    assert wide.count() == 2


def test_keys_and_orders_are_shuffled_once(spark):
    rows = spark.range(30).select(F.format_string("k%d", F.col("id") % 3).alias("key"), "id", (F.col("id") * 2).alias("more"))
    out = prefix.running_totals(prefix.materialize(rows, "rows"), ["key"], ["id"], {"total": F.lit(1)})
    assert out.columns == ["key", "id", "more", "total"]
    assert out.filter("total <> id div 3 OR more <> 2 * id OR key <> concat('k', id % 3)").count() == 0
    below = out._jdf.queryExecution().optimizedPlan().toString().split("Window")[-1]
    shuffled = re.search(r"Project \[(.*)\]", below).group(1)
    assert not re.search(r"\b(key#\d+|id#\d+L)(, |$)", shuffled) and "AS __k0" in shuffled
