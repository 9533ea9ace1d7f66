"""Headline numbers and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptlens.functions.cleaning import safe_ratio
from apptlens.functions.tiers import TIERS, is_high, tier_dimension, tier_rank
from apptlens.operators.prefix import scalars


def kpi_overview(df: DataFrame) -> DataFrame:
    """One row: totals, high-risk share, mean score, observed no-show rate."""
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(is_high(F.col("risk_level"))).alias("high_risk"),
        F.avg("predicted_risk_prob").alias("avg_risk"),
        F.count_if(F.col("status") == "No-Show").alias("no_show"),
        F.count_if(F.col("status") == "Completed").alias("completed"),
    )
    return counts.withColumns(
        {
            "high_risk_share": safe_ratio(F.col("high_risk"), F.col("total")),
            "no_show_rate": safe_ratio(F.col("no_show"), F.col("no_show") + F.col("completed")),
        }
    )


def kpi_range(df: DataFrame) -> DataFrame:
    """One row for an already filtered set: totals, mean score, outcomes."""
    return kpi_overview(df).select("total", "high_risk", "avg_risk", "completed", "no_show")


def tier_distribution(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Rows and share per tier, in tier order; empty tiers only on request."""
    counts = df.filter(F.col("risk_level").isin(*TIERS)).groupBy("risk_level").agg(F.count("*").alias("n"))
    rows = reindex_to_tiers(counts, keep_empty).fillna(0, subset=["n"])
    rows = scalars(rows, counts.agg(F.sum("n").alias("__all")))
    return rows.select("risk_level", "tier_order", "n", safe_ratio(F.col("n"), F.col("__all")).alias("share")).orderBy(
        "tier_order"
    )


def reindex_to_tiers(per_tier: DataFrame, keep_empty: bool) -> DataFrame:
    """Put per-tier rows on the five-tier skeleton, keeping or dropping gaps."""
    skeleton = tier_dimension(per_tier.sparkSession).select("risk_level", "tier_order")
    return skeleton.join(per_tier, "risk_level", "left" if keep_empty else "inner").orderBy("tier_order")


def status_by_tier(df: DataFrame) -> DataFrame:
    """Rows per (status, tier)."""
    rows = df.filter(F.col("status").isNotNull() & F.col("risk_level").isNotNull())
    return rows.groupBy("status", "risk_level").agg(F.count("*").alias("n"))


def status_breakdown(df: DataFrame) -> DataFrame:
    """Rows per status, null included."""
    return df.groupBy("status").agg(F.count("*").alias("n"))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Rows per key and their share of all rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return scalars(counts, counts.agg(F.sum("n").alias("__all"))).select(
        key, "n", safe_ratio(F.col("n"), F.col("__all")).alias("share")
    )


def order_by_tier(df: DataFrame, *then: str) -> DataFrame:
    """Sort rows by the risk order of their tier."""
    return df.orderBy(tier_rank(F.col("risk_level")), *then)
