"""Training, calibration, scoring, attribution, saving and streaming."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from apptlens.operators import encode, evaluate, explain, models, splits
from apptlens.plans import scoring, training
from apptlens.plans.catalog import modeling
from apptlens.plans.features import build_features
from apptlens.plans.registry import QUERIES
from apptlens.schemas import BOOKING_COLUMNS, FEATURES
from apptlens.session import materialize, settings, shared_dir
from apptlens.sources import artifacts, star
from apptlens.streaming import bookings as streaming

QUICK = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3}


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    """Embedding rows, y = label below 2: a task with something to learn."""
    e = star.table(spark, sf_dir, "embeddings")
    names = [f"x{i}" for i in range(8)]
    rows = e.select(
        F.col("vec_id").alias("id"),
        (F.col("label") < 2).cast("int").alias("y"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    )
    return names, models.assemble(rows, names).cache()


@pytest.fixture(scope="module")
def boosted(vectors):
    return models.train_gbt(vectors[1], **QUICK)


def test_attribution_adds_up(vectors, boosted):
    names, rows = vectors
    parts = explain.contrib_batch(rows, boosted, names)
    total = parts.select("id", F.aggregate("contribs", F.col("bias"), lambda a, c: a + c["value"]).alias("total"))
    margin = boosted.transform(rows).select("id", (2 * vector_to_array("rawPrediction")[1]).alias("margin"))
    worst = total.join(margin, "id").agg(F.count("*"), F.max(F.abs(F.col("total") - F.col("margin")))).first()
    assert worst[0] == rows.count() and worst[1] < 1e-9


def test_attribution_is_the_shapley_value(vectors, boosted):
    names, rows = vectors
    leaves = explain.tree_leaves(boosted)
    x = np.array([r[0] for r in rows.orderBy("id").select(vector_to_array("features")).limit(5).collect()])
    got = explain.attribute(leaves, x)
    n = len(names)

    def value(known, row):
        total = 0.0
        for leaf in leaves:
            inside = (row[leaf.features] > leaf.low) & (row[leaf.features] <= leaf.high)
            total += leaf.value * np.prod([float(i) if f in known else s for f, i, s in zip(leaf.features, inside, leaf.share)])
        return total

    for row, phi in zip(x, got):
        memo = {s: value(set(s), row) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
        for f in range(n):
            want = 0.0
            for s in memo:
                if f not in s:
                    share = math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n)
                    want += share * (memo[tuple(sorted((*s, f)))] - memo[s])
            assert phi[f] == pytest.approx(want, abs=1e-10)


def test_skill_beats_shuffled_labels(vectors, boosted):
    _, rows = vectors
    real = evaluate.roc_auc(models.positive_probability(rows, boosted, "p")).first()[0]
    shuffled = rows.withColumn("truth", F.col("y")).withColumn("y", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).cast("int"))
    other = models.train_gbt(shuffled, **QUICK)
    control = models.positive_probability(shuffled, other, "p").withColumn("y", F.col("truth"))
    assert real > evaluate.roc_auc(control).first()[0]


def test_platt_keeps_order_and_helps(spark, vectors):
    names, rows = vectors
    weighted = rows.withColumn("weight", F.when(F.col("y") == 1, 4.0).otherwise(1.0))
    base = models.train_gbt(weighted, weight="weight", **QUICK)
    scored = models.positive_probability(rows, base)
    sigmoid = models.platt_calibrate(scored)
    assert sigmoid.a < 0
    both = scored.withColumn("p", sigmoid.apply(F.col("p_raw")))
    b = evaluate.brier_scores(both).first()
    assert b.brier_calibrated <= b.brier_raw
    assert evaluate.roc_auc(both).first()[0] == pytest.approx(evaluate.roc_auc(both, p="p_raw").first()[0])


def test_drawn_params_stay_in_range():
    drawn = models.draw_params(40)
    assert drawn == models.draw_params(40)
    for one in drawn:
        for name, (_, low, high) in models.SEARCH_SPACE.items():
            assert low <= float(one[name]) <= high


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    return training.train_risk_model(star.raw_history(spark, sf_dir), QUICK)


def test_no_patient_in_two_parts(spark, sf_dir):
    raw = star.raw_history(spark, sf_dir, "UNIQUE_ID", "APPT")
    parts = training.three_way_by_patient(raw, "UNIQUE_ID")
    assert parts.count() == raw.count()
    assert parts.select("UNIQUE_ID", "part").distinct().groupBy("UNIQUE_ID").count().filter("count > 1").count() == 0
    assert {r.part for r in parts.select("part").distinct().collect()} == {"train", "calibration", "test"}


def test_tuning_picks_the_highest_auc(trained):
    narrow = {**models.SEARCH_SPACE, "maxIter": ("int", 1, 3), "maxDepth": ("int", 1, 3)}
    best, trials = training.tune(trained.table, 2, space=narrow)
    rows = trials.orderBy(F.desc("mean_auc")).collect()
    assert rows[0].best == 1 and rows[0].params == str(best)


def test_saved_model_scores_alike(spark, sf_dir, trained):
    path = shared_dir(spark, "saved")
    artifacts.save_artifacts(spark, path, trained.model, trained.encoders, {"metrics": trained.metrics()})
    model, encoders = artifacts.load_artifacts(spark, path)
    assert model.features == tuple(FEATURES) and model.sigmoid == trained.model.sigmoid
    again = model.score(trained.table.filter("part = 'test'")).select("id", "p")
    assert again.exceptAll(trained.test_scores.select("id", "p")).count() == 0
    assert encoders.count() == trained.encoders.count()
    assert artifacts.load_table(spark, path, "metrics").count() > 5


def test_batch_and_stream_agree(spark, sf_dir, trained):
    a = star.appointments(spark, sf_dir)
    past, new = a.filter("status <> 'Scheduled'"), a.filter("status = 'Scheduled'").select(*BOOKING_COLUMNS).limit(200)
    arriving, sink, checkpoint = (shared_dir(spark, n) for n in ("arriving", "sink", "checkpoint"))
    new.write.parquet(arriving)
    new = spark.read.parquet(arriving)
    stream = spark.readStream.schema(new.schema).parquet(arriving)
    run = streaming.start_scoring(stream, sink, checkpoint, lambda: past, trained.model, trained.encoders, availableNow=True)
    run.awaitTermination(120)
    stored = streaming.read_scored(spark, sink)
    want = scoring.score_bookings(new, past, trained.model, trained.encoders)
    columns = ["patient_id", "appointment_date", "predicted_risk_prob", "risk_level", "status"]
    assert stored.count() == 200 and stored.select("id").distinct().count() == 200
    assert stored.select(*columns).exceptAll(want.select(*columns)).count() == 0


def test_features_are_complete_and_ordered(spark, sf_dir, trained):
    a = star.appointments(spark, sf_dir)
    rows = build_features(a, a, trained.encoders)
    assert rows.columns == ["id", *FEATURES]
    assert rows.count() == a.count()
    sample = splits.background_sample(rows, "id", 100)
    assert sample.count() == 100


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_need_no_shuffle_and_are_whole_groups(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.format_string("P%04d", F.col("id") % 700)).alias("patient"), "id")
    parts = training.three_way_by_patient(rows, "patient")
    assert "Exchange" not in _plan(parts)
    outer = splits.split_by_group(rows, "patient", test=0.20)
    test = {r.patient for r in outer.filter("side = 'test'").collect()}
    inner = splits.split_by_group(outer.filter("side = 'train'"), "patient", splits.hash_order("patient", seed=7), 0.20)
    calibration = {r.patient for r in inner.filter("side = 'test'").collect()}
    assert test and calibration
    for r in parts.collect():
        assert r.part == ("test" if r.patient in test else "calibration" if r.patient in calibration else "train")


def test_small_code_tables_are_sent_to_the_rows(spark):
    rows = materialize(spark.range(500).select("id", F.format_string("v%03d", F.col("id") % 90).alias("c"), (F.col("id") % 3).cast("string").alias("d")), "rows")
    encoders = materialize(encode.label_encode_fit(rows.filter("id % 90 > 4"), ["c", "d"]), "encoders")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "16"}):
        coded = encode.label_encode_apply(rows, encoders, ["c", "d"])
        plan = _plan(coded)
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert coded.filter("c <> greatest(0, id % 90 - 5) OR d <> id % 3").count() == 0


def test_packed_codes_come_back(spark):
    names = [f"c{i}" for i in range(6)]
    wide = spark.range(64).select("id", *[(F.col("id") * 33_554_431 % (1 << (5 * i + 1))).cast("int").alias(n) for i, n in enumerate(names)])
    encoders = wide.unpivot("id", names, "column", "code").selectExpr("column", "cast(code as string) AS value", "code")
    packed, codes = encode.pack_codes(wide, encoders, names)
    assert len(packed.columns) < len(wide.columns)
    assert packed.withColumns(codes).select("id", *names).exceptAll(wide).count() == 0


def test_stored_frames_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = shuffled()
    kept = spark.range(10_000).groupBy(F.pmod(F.xxhash64("id"), F.lit(97)).alias("k")).count()
    assert materialize(kept, "kept").count() == 97
    for _ in range(50):
        if not (left := {n for n in shuffled() - before if n.endswith(".data")}):
            break
        time.sleep(0.1)
    # What counting the stored rows shuffled is a row per file and goes with its frame.
    assert len(left) <= 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_the_registered_search_is_whole(spark, sf_dir, trained, monkeypatch):
    seen = []
    monkeypatch.setattr(modeling, "fitted", lambda *_: trained)
    monkeypatch.setattr(models, "tune_params", lambda rows, trials, **options: seen.append((rows.count(), trials)) or (trials[0], rows.limit(1)))
    QUERIES["tune_params"](spark, sf_dir)
    (n, trials), = seen
    train = trained.table.filter("part = 'train'").count()
    assert n == min(train, training.TUNING_ROWS) and trials == models.draw_params(50)
    assert min(t["maxIter"] for t in trials) >= 100 and max(t["maxDepth"] for t in trials) > 4
