"""Provider ranking and quadrants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptlens.functions.cleaning import round_n, safe_ratio
from apptlens.functions.tiers import is_high
from apptlens.operators.prefix import percentiles, scalars


def provider_stats(df: DataFrame) -> DataFrame:
    """Volume, mean score, high-risk count and rate (%) per provider."""
    stats = (
        df.filter(F.col("attending_physician").isNotNull())
        .groupBy("attending_physician")
        .agg(
            F.count("id").alias("total_patients"),
            F.avg("predicted_risk_prob").alias("avg_risk_score"),
            F.count_if(is_high(F.col("risk_level"))).alias("high_risk_count"),
        )
    )
    rate = safe_ratio(F.col("high_risk_count"), F.col("total_patients"), None) * 100
    return stats.withColumn("high_risk_rate", round_n(rate, 1))


def rank_providers(stats: DataFrame) -> DataFrame:
    """Highest rate first, provider name breaking ties."""
    return stats.orderBy(F.desc("high_risk_rate"), "attending_physician")


def provider_medians(stats: DataFrame) -> DataFrame:
    """One row: median volume and median rate over providers."""
    long = stats.select(
        F.explode(
            F.array(
                F.struct(F.lit("volume").alias("metric"), F.col("total_patients").cast("double").alias("value")),
                F.struct(F.lit("rate").alias("metric"), F.col("high_risk_rate").alias("value")),
            )
        ).alias("m")
    ).select("m.metric", "m.value")
    medians = percentiles(long, ["metric"], "value", {"median": 0.5})
    return medians.agg(
        F.max(F.when(F.col("metric") == "volume", F.col("median"))).alias("median_volume"),
        F.max(F.when(F.col("metric") == "rate", F.col("median"))).alias("median_rate"),
    )


def quadrant_flags(stats: DataFrame) -> DataFrame:
    """Mark providers at or above both medians and name every quadrant."""
    out = scalars(stats, provider_medians(stats))
    busy = F.col("total_patients") >= F.col("median_volume")
    risky = F.col("high_risk_rate") >= F.col("median_rate")
    quadrant = F.concat_ws(
        ", ", F.when(busy, "High Volume").otherwise("Low Volume"), F.when(risky, "High Risk").otherwise("Low Risk")
    )
    return out.withColumns({"flagged": (busy & risky).cast("int"), "quadrant": quadrant})
