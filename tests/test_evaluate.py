"""Evaluation against brute force and Spark's own evaluator."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from apptlens.operators import evaluate


def _scored(spark, rows):
    data = [(i, y, float(p), float(p) ** 0.5) for i, (y, p) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, y int, p double, p_raw double")


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < p), p) for p in (round(rng.random(), 2) for _ in range(400))]
    return rows, _scored(spark, rows)


@pytest.mark.parametrize("rows_per_range", [15, 10_000])
def test_auc_is_the_share_of_ordered_pairs(sample, rows_per_range):
    rows, df = sample
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df, rows_per_range=rows_per_range).first()[0] == pytest.approx(want, abs=1e-12)
    vectors = df.withColumn("v", array_to_vector(F.array("p")))
    spark_auc = BinaryClassificationEvaluator(rawPredictionCol="v", labelCol="y", numBins=0).evaluate(
        vectors.withColumn("v", array_to_vector(F.array(1 - F.col("p"), "p")))
    )
    assert spark_auc == pytest.approx(want, abs=1e-9)


def test_degenerate_scores(spark):
    assert evaluate.roc_auc(_scored(spark, [(0, 0.5), (1, 0.5), (1, 0.5)])).first()[0] == 0.5
    assert evaluate.roc_auc(_scored(spark, [(1, 0.2), (1, 0.5)])).first()[0] is None


def test_average_precision_is_stepwise(sample):
    rows, df = sample
    want, tp, seen, total = 0.0, 0, 0, sum(y for y, _ in rows)
    for score in sorted({p for _, p in rows}, reverse=True):
        hits = sum(y for y, p in rows if p == score)
        tp += hits
        seen += sum(p == score for _, p in rows)
        want += hits / total * tp / seen
    assert evaluate.average_precision(df).first()[0] == pytest.approx(want, abs=1e-12)


def test_curves(sample):
    _, df = sample
    roc = evaluate.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert (roc[0].fpr, roc[0].tpr) == (0.0, 0.0) and (roc[-1].fpr, roc[-1].tpr) == (1.0, 1.0)
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(roc, roc[1:]))
    pr = evaluate.pr_curve(df).collect()
    assert [(r.precision, r.recall) for r in pr if r.threshold is None] == [(1.0, 0.0)]


def test_best_threshold_is_the_lowest(spark):
    points = spark.createDataFrame([(0.2, 0.5), (0.4, 0.9), (0.7, 0.9)], "threshold double, f1 double")
    best = evaluate.best_threshold(points, "f1").first()
    assert (best.threshold, best.value) == (0.4, 0.9)


def test_thresholds_are_inclusive(spark):
    df = _scored(spark, [(1, 0.15), (0, 0.10), (1, 1.0), (0, 0.0)])
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.threshold_counts(df, [0.10, 0.15, 1.0]).collect()}
    assert got == {0.10: (2, 1, 0, 1), 0.15: (2, 0, 0, 2), 1.0: (1, 0, 1, 2)}


def test_bands_keep_empty_tiers_and_score_one(spark):
    df = _scored(spark, [(1, 1.0), (0, 0.05), (1, 0.6)])
    assert [r.n for r in evaluate.band_analysis(df).orderBy("tier_order").collect()] == [1, 0, 0, 0, 2]
    assert [r.n for r in evaluate.band_recommendation(df).orderBy("tier_order").collect()] == [1, 0, 0, 0, 1]
    pr = evaluate.band_precision_recall(df).orderBy("tier_order").collect()
    assert pr[1].precision is None and pr[1].recall is None


def test_report_counts(spark):
    df = _scored(spark, [(1, 0.9), (1, 0.1), (0, 0.8), (0, 0.2), (0, 0.3)])
    rows = {r.label: r for r in evaluate.classification_report(df).collect()}
    assert (rows["1"].precision, rows["1"].recall, rows["1"].support) == (0.5, 0.5, 2)
    assert rows["accuracy"].f1 == 0.6
    cells = {(r.actual, r.predicted): r.n for r in evaluate.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}


def test_calibration_bins_collapse_on_ties(spark):
    df = _scored(spark, [(i % 2, 0.5) for i in range(30)])
    curve = evaluate.calibration_curve(df, 15).collect()
    assert [(r.n, r.mean_predicted, r.fraction_positive) for r in curve] == [(30, 0.5, 0.5)]
