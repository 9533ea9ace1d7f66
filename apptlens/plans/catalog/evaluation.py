"""Exact evaluation of scores against outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from apptlens.operators import evaluate
from apptlens.plans.registry import query, r10
from apptlens.sources import star

_TOTALS = """c AS (SELECT p AS score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM scored GROUP BY p),
  t AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM c)"""


@query(
    "roc_auc",
    f"WITH {_TOTALS} SELECT round(1 - sum(pos * (fp - neg / 2.0e0)) / (sum(pos) * 1.0e0 * sum(neg)), 10) AS roc_auc FROM t",
)
def _(spark, d):
    return evaluate.roc_auc(star.scored(spark, d), rows_per_range=200).select(r10("roc_auc").alias("roc_auc"))


@query(
    "roc_curve",
    f"""WITH {_TOTALS} SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0e0 AS fpr, 0.0e0 AS tpr UNION ALL
        SELECT score, round(fp * 1.0e0 / nn, 10), round(tp * 1.0e0 / np, 10) FROM t""",
)
def _(spark, d):
    return evaluate.roc_curve(star.scored(spark, d)).withColumns({c: r10(c) for c in ("fpr", "tpr")})


@query("average_precision", f"WITH {_TOTALS} SELECT round(sum(pos * tp * 1.0e0 / (tp + fp)) / sum(pos), 10) AS average_precision FROM t")
def _(spark, d):
    return evaluate.average_precision(star.scored(spark, d)).select(r10("average_precision").alias("average_precision"))


@query(
    "pr_curve",
    f"""WITH {_TOTALS} SELECT NULL AS threshold, 1.0e0 AS precision, 0.0e0 AS recall UNION ALL
        SELECT score, round(tp * 1.0e0 / (tp + fp), 10), round(tp * 1.0e0 / np, 10) FROM t""",
)
def _(spark, d):
    return evaluate.pr_curve(star.scored(spark, d)).withColumns({c: r10(c) for c in ("precision", "recall")})


_F1 = f"""{_TOTALS}, f AS (SELECT score AS threshold, tp * 1.0e0 / (tp + fp) AS precision, tp * 1.0e0 / np AS recall,
  2 * (tp * 1.0e0 / (tp + fp)) * (tp * 1.0e0 / np) / (tp * 1.0e0 / (tp + fp) + tp * 1.0e0 / np + 1e-10) AS f1 FROM t)"""


@query("f1_by_score", f"WITH {_F1} SELECT threshold, round(f1, 10) AS f1 FROM f")
def _(spark, d):
    return evaluate.pr_points(star.scored(spark, d)).select("threshold", r10("f1").alias("f1"))


@query(
    "argmax_threshold",
    f"""WITH {_F1} SELECT measure, min(threshold) AS threshold, round(max(v), 10) AS value FROM (
          SELECT 'f1' AS measure, threshold, round(f1, 10) AS v FROM f UNION ALL SELECT 'precision', threshold, round(precision, 10) FROM f
          UNION ALL SELECT 'recall', threshold, round(recall, 10) FROM f) m
        WHERE v = (SELECT CASE m.measure WHEN 'f1' THEN max(round(f1, 10)) WHEN 'precision' THEN max(round(precision, 10)) ELSE max(round(recall, 10)) END FROM f)
        GROUP BY measure""",
)
def _(spark, d):
    points = evaluate.pr_points(star.scored(spark, d))
    return evaluate.best_threshold(points, "f1", "precision", "recall").withColumn("value", r10("value"))


_BRIER = """b AS (SELECT avg(y) AS base_rate, avg(pow(p_raw - y, 2)) AS brier_raw, avg(pow(p - y, 2)) AS brier_calibrated FROM scored),
  s AS (SELECT *, base_rate * (1 - base_rate) AS brier_naive, 1 - brier_raw / (base_rate * (1 - base_rate)) AS skill_raw,
        1 - brier_calibrated / (base_rate * (1 - base_rate)) AS skill_calibrated FROM b)"""


@query(
    "brier_scores",
    f"""WITH {_BRIER} SELECT round(base_rate, 10) AS base_rate, round(brier_raw, 10) AS brier_raw, round(brier_calibrated, 10) AS brier_calibrated,
        round(brier_naive, 10) AS brier_naive, round(skill_raw, 10) AS skill_raw, round(skill_calibrated, 10) AS skill_calibrated FROM s""",
)
def _(spark, d):
    b = evaluate.brier_scores(star.scored(spark, d))
    return b.select(*[r10(c).alias(c) for c in b.columns])


@query(
    "calibration_comparison",
    f"""WITH {_BRIER}, r AS (SELECT 'before' AS stage, brier_raw AS brier, skill_raw AS skill FROM s UNION ALL SELECT 'after', brier_calibrated, skill_calibrated FROM s)
        SELECT stage, round(brier, 10) AS brier, round(skill, 10) AS skill,
        CASE WHEN skill < 0 THEN 'Overconfident, worse than the base rate' ELSE 'Better than the base rate' END AS assessment FROM r""",
)
def _(spark, d):
    return evaluate.calibration_comparison(star.scored(spark, d)).withColumns({c: r10(c) for c in ("brier", "skill")})


@query(
    "confusion_matrix",
    """SELECT a AS actual, b AS predicted, (SELECT count(*) FROM scored WHERE y = a AND CAST(p >= 0.5e0 AS INTEGER) = b) AS n
       FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, b)""",
)
def _(spark, d):
    return evaluate.confusion_matrix(star.scored(spark, d))


@query("predict_class", "SELECT id, CAST(p >= 0.5e0 AS INTEGER) AS predicted FROM scored")
def _(spark, d):
    from apptlens.operators.filters import predict_class

    return predict_class(star.scored(spark, d)).select("id", "predicted")


@query(
    "classification_report",
    """WITH c AS (SELECT count(*) FILTER (WHERE y = 1 AND p >= 0.5e0) * 1.0e0 AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5e0) * 1.0e0 AS fp,
         count(*) FILTER (WHERE y = 1 AND p < 0.5e0) * 1.0e0 AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5e0) * 1.0e0 AS tn FROM scored),
       k AS (SELECT '0' AS label, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, tn + fp AS support, (tp + tn) / (tp + tn + fp + fn) AS acc FROM c UNION ALL
         SELECT '1', tp / (tp + fp), tp / (tp + fn), tp + fn, (tp + tn) / (tp + tn + fp + fn) FROM c),
       f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM k),
       r AS (SELECT label, precision, recall, f1, support FROM f UNION ALL SELECT 'accuracy', max(acc), max(acc), max(acc), sum(support) FROM f UNION ALL
         SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f UNION ALL
         SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
       SELECT label, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1, CAST(support AS BIGINT) AS support FROM r""",
)
def _(spark, d):
    return evaluate.classification_report(star.scored(spark, d)).withColumns({c: r10(c) for c in ("precision", "recall", "f1")})


@query(
    "model_comparison",
    """WITH s AS (SELECT id, y, p AS score, 'calibrated' AS model FROM scored UNION ALL SELECT id, y, p_raw, 'raw' FROM scored),
       k AS (SELECT model, CASE WHEN id % 4 = 0 THEN 'Test' ELSE 'Train' END AS split, y, score FROM s),
       c AS (SELECT model, split, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM k GROUP BY ALL),
       t AS (SELECT *, sum(neg) OVER (PARTITION BY model, split ORDER BY score DESC) AS fpc FROM c),
       m AS (SELECT model, split, coalesce(sum(pos) FILTER (WHERE score >= 0.5e0), 0) * 1.0e0 AS tp, coalesce(sum(neg) FILTER (WHERE score >= 0.5e0), 0) * 1.0e0 AS fp,
         sum(pos) * 1.0e0 AS np, sum(neg) * 1.0e0 AS nn, 1 - sum(pos * (fpc - neg / 2.0e0)) / (sum(pos) * 1.0e0 * sum(neg)) AS auc FROM t GROUP BY ALL)
       SELECT model, split, round_even((tp + nn - fp) / (np + nn), 4) AS accuracy, round_even(tp / (tp + fp), 4) AS precision, round_even(tp / np, 4) AS recall,
       round_even(2 * (tp / (tp + fp)) * (tp / np) / (tp / (tp + fp) + tp / np), 4) AS f1_score, round_even(auc, 4) AS roc_auc FROM m""",
)
def _(spark, d):
    s = star.scored(spark, d)
    variants = F.array(
        F.struct(F.lit("calibrated").alias("model"), F.col("p").alias("p")), F.struct(F.lit("raw").alias("model"), F.col("p_raw").alias("p"))
    )
    split = F.when(F.pmod("id", F.lit(4)) == 0, "Test").otherwise("Train").alias("split")
    rows = s.select("y", split, F.explode(variants).alias("v")).select("y", "split", "v.model", "v.p")
    return evaluate.model_comparison(rows)


@query(
    "calibration_curve",
    """WITH e AS (SELECT quantile_cont(p, [1/15.0e0, 2/15.0e0, 3/15.0e0, 4/15.0e0, 5/15.0e0, 6/15.0e0, 7/15.0e0, 8/15.0e0, 9/15.0e0, 10/15.0e0, 11/15.0e0, 12/15.0e0,
         13/15.0e0, 14/15.0e0]) AS q FROM scored), b AS (SELECT p, y, CAST(len(list_filter(q, lambda z: z < p)) AS INTEGER) AS bin FROM scored, e)
       SELECT bin, count(*) AS n, round(avg(p), 10) AS mean_predicted, round(avg(y), 10) AS fraction_positive FROM b GROUP BY bin""",
)
def _(spark, d):
    c = evaluate.calibration_curve(star.scored(spark, d))
    return c.withColumns({k: r10(k) for k in ("mean_predicted", "fraction_positive")})


def _sweep(thresholds: str, columns: str) -> str:
    return f"""WITH t AS (SELECT t.threshold, count(*) FILTER (WHERE y = 1 AND p >= threshold) * 1.0e0 AS tp, count(*) FILTER (WHERE y = 0 AND p >= threshold) * 1.0e0 AS fp,
      count(*) FILTER (WHERE y = 1 AND p < threshold) * 1.0e0 AS fn, count(*) FILTER (WHERE y = 0 AND p < threshold) * 1.0e0 AS tn
      FROM scored, ({thresholds}) t GROUP BY t.threshold),
      m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0e0 END AS precision, tp / (tp + fn) AS recall, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
        (tp + fp) / (tp + fp + fn + tn) AS flagged FROM t)
      SELECT threshold, round(precision, 10) AS precision, round(recall, 10) AS recall, {columns} FROM m"""


@query(
    "threshold_sweep_grid",
    _sweep(
        "SELECT k / 20.0e0 AS threshold FROM range(21) r(k)",
        "round(accuracy, 10) AS accuracy, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0e0 END, 10) AS f1_score",
    ),
)
def _(spark, d):
    g = evaluate.threshold_sweep_grid(star.scored(spark, d))
    return g.withColumns({c: r10(c) for c in ("accuracy", "precision", "recall", "f1_score")})


@query(
    "threshold_capture",
    _sweep(
        "SELECT unnest([0.10e0, 0.15e0, 0.20e0, 0.25e0, 0.30e0, 0.35e0, 0.40e0, 0.50e0, 0.55e0, 0.60e0, 0.70e0]) AS threshold",
        "round(flagged, 10) AS flagged, round(2 * precision * recall / (precision + recall + 1e-10), 10) AS f1",
    ),
)
def _(spark, d):
    g = evaluate.threshold_capture(star.scored(spark, d))
    return g.withColumns({c: r10(c) for c in ("precision", "recall", "flagged", "f1")})


def _band_sql(values: str) -> str:
    return f"""bands AS (SELECT * FROM (VALUES {values}) v(risk_level, tier_order, lo, hi)),
      b AS (SELECT risk_level, CAST(tier_order AS INTEGER) AS tier_order, lo, hi, count(id) AS n, coalesce(sum(y), 0) AS pos FROM bands LEFT JOIN scored ON p >= lo AND p < hi GROUP BY ALL),
      k AS (SELECT *, (SELECT count(*) FROM scored) AS total, (SELECT sum(y) FROM scored) AS np FROM b),
      r AS (SELECT *, n * 1.0e0 / total AS share, CASE WHEN n > 0 THEN pos * 1.0e0 / n ELSE 0.0e0 END AS rate, np * 1.0e0 / total AS base,
        CASE risk_level WHEN 'Moderate' THEN 'Automated SMS/email reminder' WHEN 'High' THEN 'Manual phone call + reminder'
        WHEN 'Very High' THEN 'Double-book slot + personal outreach' ELSE 'No action' END AS action FROM k)"""


_STUDY = "('Very Low', 1, 0.0e0, 0.10e0), ('Low', 2, 0.10e0, 0.20e0), ('Moderate', 3, 0.20e0, 0.35e0), ('High', 4, 0.35e0, 0.55e0), ('Very High', 5, 0.55e0, {top})"


@query(
    "band_analysis",
    f"""WITH {_band_sql(_STUDY.format(top='1.001e0'))} SELECT risk_level, tier_order, printf('%.2f – %.2f', lo, hi) AS prob_range, n, round(share, 10) AS share,
        round(rate, 10) AS rate, round(rate / base, 10) AS lift, printf('%.1f%%', share * 100) AS share_text, printf('%.2f%%', rate * 100) AS rate_text,
        printf('%.2fx', rate / base) AS lift_text, action FROM r""",
)
def _(spark, d):
    return evaluate.band_analysis(star.scored(spark, d)).withColumns({c: r10(c) for c in ("share", "rate", "lift")})


@query(
    "band_recommendation",
    f"""WITH {_band_sql(_STUDY.format(top='1.0e0'))} SELECT risk_level, tier_order, printf('%.2f – %.2f', lo, hi) AS prob_range, n, round(share, 10) AS share,
        round(rate, 10) AS rate, round(rate / base, 10) AS lift, action FROM r""",
)
def _(spark, d):
    return evaluate.band_recommendation(star.scored(spark, d)).withColumns({c: r10(c) for c in ("share", "rate", "lift")})


@query(
    "band_precision_recall",
    f"""WITH {_band_sql("('Very Low', 1, 0.0e0, 0.15e0), ('Low', 2, 0.15e0, 0.25e0), ('Moderate', 3, 0.25e0, 0.50e0), ('High', 4, 0.50e0, 0.70e0), ('Very High', 5, 0.70e0, 9.0e0)")}
        SELECT risk_level, tier_order, n, round_even(share * 100, 2) AS percent, CASE WHEN n > 0 THEN round_even(rate, 4) END AS precision,
        CASE WHEN n > 0 THEN round_even(pos * 1.0e0 / np, 4) END AS recall FROM r""",
)
def _(spark, d):
    return evaluate.band_precision_recall(star.scored(spark, d))
