"""Exact model evaluation over a scored table (y = 0/1 outcome, p = score).

Curves start from counts per distinct score (combined before the shuffle) and
running totals over those counts; see ``prefix`` for how they are split. Every
result is exact, with ties in the score treated as one step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apptlens.functions.cleaning import round_n, safe_ratio
from apptlens.functions.text import as_multiple, as_percent, as_range
from apptlens.functions.tiers import EARLY_EDGES, STUDY_EDGES, Band, bands
from apptlens.operators.prefix import ROWS_PER_RANGE, percentiles, running_totals, scalars
from apptlens.session import materialize

# Thresholds of the capture table.
CAPTURE_THRESHOLDS = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50, 0.55, 0.60, 0.70)
F1_GUARD = 1e-10


def score_totals(
    scored: DataFrame, by: Sequence[str] = (), p: str = "p", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Per distinct score, from high to low: pos, neg, and tp, fp at p >= score."""
    counts = scored.groupBy(*by, F.col(p).alias("score")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    # Ranking reads the counts more than once; stored, the rows are scanned once.
    counts = materialize(counts, "scores")
    out = running_totals(
        counts, by, [-F.col("score")], {"__tp": F.col("pos"), "__fp": F.col("neg")}, rows_per_range
    )
    return out.select(
        *by, "score", "pos", "neg", (F.col("__tp") + F.col("pos")).alias("tp"), (F.col("__fp") + F.col("neg")).alias("fp")
    )


def _with_class_sizes(totals: DataFrame) -> DataFrame:
    """Positives and negatives in all: the last point of the running counts."""
    return scalars(totals, totals.agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n")))


def _auc() -> Column:
    """Chance that a positive outranks a negative, ties half, from score totals."""
    outranked = F.sum(F.col("pos").cast("double") * (F.col("fp") - F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return F.when(pairs > 0, 1 - outranked / pairs)


def roc_auc(scored: DataFrame, by: Sequence[str] = (), p: str = "p", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Area under the ROC curve; null when only one class is present."""
    return score_totals(scored, by, p, rows_per_range).groupBy(*by).agg(_auc().alias("roc_auc"))


def roc_curve(scored: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """False and true positive rate at every distinct score, from (0, 0)."""
    points = _with_class_sizes(score_totals(scored, rows_per_range=rows_per_range))
    points = points.select(
        F.col("score").alias("threshold"),
        safe_ratio(F.col("fp"), F.col("__n"), None).alias("fpr"),
        safe_ratio(F.col("tp"), F.col("__p"), None).alias("tpr"),
    )
    start = scored.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], points.schema)
    return start.unionByName(points)


def average_precision(scored: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Step-wise area under the precision-recall curve."""
    gain = F.col("pos") * safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    totals = score_totals(scored, rows_per_range=rows_per_range)
    return totals.agg(safe_ratio(F.sum(gain), F.sum("pos"), None).alias("average_precision"))


def pr_points(scored: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Precision, recall and F1 at every distinct score."""
    points = _with_class_sizes(score_totals(scored, rows_per_range=rows_per_range))
    points = points.select(
        F.col("score").alias("threshold"),
        safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("__p")).alias("recall"),
    )
    return points.withColumn("f1", _guarded_f1())


def _guarded_f1() -> Column:
    """F1 with a small constant below the line instead of a zero test."""
    return 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F1_GUARD)


def pr_curve(scored: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Precision and recall per threshold, closed by the point (recall 0, precision 1)."""
    points = pr_points(scored, rows_per_range).drop("f1")
    end = scored.sparkSession.createDataFrame([(None, 1.0, 0.0)], points.schema)
    return points.unionByName(end)


def best_threshold(points: DataFrame, *measures: str) -> DataFrame:
    """Per measure, its highest value and the lowest threshold reaching it."""
    picks = [
        F.max(F.struct(F.col(m).alias("value"), (-F.col("threshold")).alias("minus_t"))).alias(m) for m in measures
    ]
    best = points.agg(*picks)
    rows = [
        F.struct(
            F.lit(m).alias("measure"), (-F.col(f"{m}.minus_t")).alias("threshold"), F.col(f"{m}.value").alias("value")
        )
        for m in measures
    ]
    return best.select(F.explode(F.array(*rows)).alias("b")).select("b.*")


def gain_curve(scored: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Rows from highest score down with cumulative positives and shares."""
    out = running_totals(
        scored.select("id", "y", "p"),
        [],
        [-F.col("p"), "id"],
        {"__hits": F.col("y"), "__rows": F.lit(1)},
        rows_per_range,
    )
    out = scalars(out, scored.agg(F.sum("y").alias("__p"), F.count("*").alias("__all")))
    hits = F.col("__hits") + F.col("y")
    return out.select(
        "id",
        "p",
        "y",
        hits.alias("cum_actual"),
        safe_ratio(hits, F.col("__p"), None).alias("cum_share_actual"),
        ((F.col("__rows") + 1) / F.col("__all")).alias("cum_share_records"),
    )


def brier_scores(scored: DataFrame) -> DataFrame:
    """Brier score raw and calibrated, of the base-rate forecast, and skills."""
    one = scored.agg(
        F.avg("y").alias("base_rate"),
        F.avg(F.pow(F.col("p_raw") - F.col("y"), 2)).alias("brier_raw"),
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier_calibrated"),
    )
    one = one.withColumn("brier_naive", F.col("base_rate") * (1 - F.col("base_rate")))
    return one.withColumns({f"skill_{k}": _skill(F.col(f"brier_{k}")) for k in ("raw", "calibrated")})


def _skill(brier: Column) -> Column:
    return F.when(F.col("brier_naive") > 0, 1 - brier / F.col("brier_naive"))


def calibration_comparison(scored: DataFrame) -> DataFrame:
    """Before and after calibration: Brier score, skill and a verdict."""
    one = brier_scores(scored)
    rows = []
    for stage, suffix in (("before", "raw"), ("after", "calibrated")):
        skill = F.col(f"skill_{suffix}")
        verdict = F.when(skill < 0, "Overconfident, worse than the base rate").otherwise("Better than the base rate")
        rows.append(
            F.struct(
                F.lit(stage).alias("stage"),
                F.col(f"brier_{suffix}").alias("brier"),
                skill.alias("skill"),
                verdict.alias("assessment"),
            )
        )
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def confusion_matrix(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The four (actual, predicted) counts, zero where empty."""
    hit = F.col("p") >= threshold
    actual = F.col("y") == 1
    one = scored.agg(
        F.count_if(~actual & ~hit).alias("c00"),
        F.count_if(~actual & hit).alias("c01"),
        F.count_if(actual & ~hit).alias("c10"),
        F.count_if(actual & hit).alias("c11"),
    )
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("n"))
        for a in (0, 1)
        for b in (0, 1)
    ]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _f1(precision: Column, recall: Column) -> Column:
    return safe_ratio(2 * precision * recall, precision + recall)


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, with averages and accuracy."""
    hit = F.col("p") >= threshold
    actual = F.col("y") == 1
    c = scored.agg(
        F.count_if(~actual & ~hit).alias("tn"),
        F.count_if(~actual & hit).alias("fp"),
        F.count_if(actual & ~hit).alias("fn"),
        F.count_if(actual & hit).alias("tp"),
    )
    for name, right, also_claimed, missed in (("1", "tp", "fp", "fn"), ("0", "tn", "fn", "fp")):
        c = c.withColumns(
            {
                f"p{name}": safe_ratio(F.col(right), F.col(right) + F.col(also_claimed)),
                f"r{name}": safe_ratio(F.col(right), F.col(right) + F.col(missed)),
                f"s{name}": F.col(right) + F.col(missed),
            }
        ).withColumn(f"f{name}", _f1(F.col(f"p{name}"), F.col(f"r{name}")))
    n = F.col("s0") + F.col("s1")

    def row(label: str, parts: Sequence[Column], support: Column) -> Column:
        names = ("precision", "recall", "f1")
        return F.struct(F.lit(label).alias("label"), *[x.alias(k) for x, k in zip(parts, names)], support.alias("support"))

    accuracy = safe_ratio(F.col("tp") + F.col("tn"), n)
    rows = [row(k, [F.col(f"{m}{k}") for m in "prf"], F.col(f"s{k}")) for k in ("0", "1")]
    rows.append(row("accuracy", [accuracy] * 3, n))
    rows.append(row("macro avg", [(F.col(f"{m}0") + F.col(f"{m}1")) / 2 for m in "prf"], n))
    weighted = [safe_ratio(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), n) for m in "prf"]
    rows.append(row("weighted avg", weighted, n))
    return c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def model_comparison(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("model", "split")) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC per (model, split), 4 digits.

    Works on score totals, so one aggregation serves all five measures.
    """
    hit = F.col("score") >= threshold
    stats = score_totals(scored, by).groupBy(*by).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("__p"),
        F.sum("neg").alias("__n"),
        _auc().alias("roc_auc"),
    )
    precision = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_ratio(F.col("tp"), F.col("__p"))
    accuracy = safe_ratio(F.col("tp") + F.col("__n") - F.col("fp"), F.col("__p") + F.col("__n"))
    measures = {"accuracy": accuracy, "precision": precision, "recall": recall, "f1_score": _f1(precision, recall)}
    return stats.select(
        *by, *[round_n(x, 4).alias(k) for k, x in measures.items()], round_n(F.col("roc_auc"), 4).alias("roc_auc")
    )


def calibration_curve(scored: DataFrame, bins: int = 15, p: str = "p") -> DataFrame:
    """Mean score and positive share per quantile bin; empty bins are absent."""
    points = {f"e{i}": i / bins for i in range(1, bins)}
    edges = percentiles(scored, [], p, points).select(F.array(*points).alias("__edges"))
    rows = scalars(scored.select("y", F.col(p).alias("__x")), edges)
    rows = rows.withColumn("bin", F.size(F.filter("__edges", lambda e: e < F.col("__x"))))
    return rows.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("__x").alias("mean_predicted"), F.avg("y").alias("fraction_positive")
    )


def threshold_counts(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """tp, fp, fn, tn at each threshold, without pairing rows and thresholds.

    Each row is counted once, under the number of thresholds it reaches; the
    counts of a threshold are those of its own slot and all higher ones.
    """
    cuts = sorted(thresholds)
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts]), lambda t: t <= F.col("p")))
    slots = scored.groupBy(reached.alias("slot")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    skeleton = [(i, float(t)) for i, t in enumerate([float("-inf"), *cuts])]
    frame = scored.sparkSession.createDataFrame(skeleton, "slot int, threshold double")
    frame = frame.join(slots, "slot", "left").fillna(0, subset=["pos", "neg"])
    # As many rows as thresholds, plus one.
    up = Window.orderBy(F.desc("slot"))
    every = Window.partitionBy()
    frame = frame.select(
        "slot",
        "threshold",
        F.sum("pos").over(up).alias("tp"),
        F.sum("neg").over(up).alias("fp"),
        F.sum("pos").over(every).alias("__p"),
        F.sum("neg").over(every).alias("__n"),
    )
    return frame.filter(F.col("slot") > 0).select(
        "threshold", "tp", "fp", (F.col("__p") - F.col("tp")).alias("fn"), (F.col("__n") - F.col("fp")).alias("tn")
    )


def threshold_sweep_grid(scored: DataFrame, steps: int = 20) -> DataFrame:
    """Accuracy, precision, recall and F1 at 0, 1/steps, ..., 1."""
    t = threshold_counts(scored, [i / steps for i in range(steps + 1)])
    precision = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return t.select(
        "threshold",
        safe_ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1_score"),
    )


def threshold_capture(scored: DataFrame, thresholds: Sequence[float] = CAPTURE_THRESHOLDS) -> DataFrame:
    """Precision, recall, F1 and flagged share at each threshold."""
    t = threshold_counts(scored, thresholds)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    t = t.select(
        "threshold",
        safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        safe_ratio(F.col("tp") + F.col("fp"), n).alias("flagged"),
    )
    return t.withColumn("f1", _guarded_f1())


def _band_number(p: Column, items: Sequence[Band]) -> Column:
    chain = F.lit(None).cast("int")
    for b in reversed(items):
        chain = F.when((p >= b.lo) & (p < b.hi), b.tier_order).otherwise(chain)
    return chain


def band_counts(scored: DataFrame, items: Sequence[Band]) -> DataFrame:
    """Rows and positives per band, empty bands included, with table totals."""
    counts = scored.groupBy(_band_number(F.col("p"), items).alias("tier_order")).agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos")
    )
    rows = [(b.tier_order, b.risk_level, b.lo, b.hi, b.action) for b in items]
    skeleton = scored.sparkSession.createDataFrame(
        rows, "tier_order int, risk_level string, lo double, hi double, action string"
    )
    out = skeleton.join(counts, "tier_order", "left").fillna(0, subset=["n", "pos"])
    return scalars(out, counts.agg(F.sum("n").alias("__all"), F.sum("pos").alias("__p")))


def band_analysis(scored: DataFrame, edges: Sequence[float] = STUDY_EDGES, top: float = 1.001) -> DataFrame:
    """Size, share, actual rate and lift of each tier, as numbers and as text."""
    b = band_counts(scored, bands(edges, top))
    rate = safe_ratio(F.col("pos"), F.col("n"))
    base = safe_ratio(F.col("__p"), F.col("__all"))
    b = b.withColumns({"share": safe_ratio(F.col("n"), F.col("__all")), "rate": rate, "lift": safe_ratio(rate, base)})
    return b.select(
        "risk_level",
        "tier_order",
        as_range(F.col("lo"), F.col("hi")).alias("prob_range"),
        "n",
        "share",
        "rate",
        "lift",
        as_percent(F.col("share")).alias("share_text"),
        as_percent(F.col("rate"), 2).alias("rate_text"),
        as_multiple(F.col("lift")).alias("lift_text"),
        "action",
    )


def band_recommendation(scored: DataFrame, edges: Sequence[float] = STUDY_EDGES) -> DataFrame:
    """Band table with the recommended action; the last band excludes 1.0."""
    table = band_analysis(scored, edges, top=1.0)
    return table.select("risk_level", "tier_order", "prob_range", "n", "share", "rate", "lift", "action")


def band_precision_recall(scored: DataFrame, edges: Sequence[float] = EARLY_EDGES) -> DataFrame:
    """Per tier: size, share (%), precision, and share of all positives."""
    b = band_counts(scored, bands(edges, float("inf")))
    return b.select(
        "risk_level",
        "tier_order",
        "n",
        round_n(safe_ratio(F.col("n"), F.col("__all")) * 100, 2).alias("percent"),
        round_n(safe_ratio(F.col("pos"), F.col("n"), None), 4).alias("precision"),
        F.when(F.col("n") > 0, round_n(safe_ratio(F.col("pos"), F.col("__p"), None), 4)).alias("recall"),
    )
