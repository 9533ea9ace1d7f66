"""Risk tiers: edges, labels, order, actions, expected rates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tier labels in rising order of risk.
TIERS = ("Very Low", "Low", "Moderate", "High", "Very High")
HIGH_TIERS = ("High", "Very High")

# Tier edges. Serving, threshold study, first study.
SERVING_EDGES = (0.10, 0.15, 0.25, 0.40)
STUDY_EDGES = (0.10, 0.20, 0.35, 0.55)
EARLY_EDGES = (0.15, 0.25, 0.50, 0.70)

# What staff do per tier, and the calibrated outcome rate.
TIER_ACTIONS = (
    "No action",
    "No action",
    "Automated SMS/email reminder",
    "Manual phone call + reminder",
    "Double-book slot + personal outreach",
)
TIER_RATES = (0.07, 0.13, 0.19, 0.30, 0.51)


def risk_tier(p: Column, edges: Sequence[float] = SERVING_EDGES, labels: Sequence[str] = TIERS) -> Column:
    """Tier of a score over half-open bands ``[lo, hi)``; no score, no tier."""
    chain = F.when(p.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        chain = chain.when(p < edge, label)
    return chain.otherwise(labels[-1])


def tier_rank(tier: Column, labels: Sequence[str] = TIERS) -> Column:
    """1-based place of a tier in the risk order; null for anything else."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), tier)
    return F.when(place > 0, place)


def is_high(tier: Column) -> Column:
    """True for the two top tiers, false otherwise, also for a missing tier."""
    return F.coalesce(tier.isin(*HIGH_TIERS), F.lit(False))


@dataclass(frozen=True)
class Band:
    """One row of the tier dimension."""

    risk_level: str
    tier_order: int
    lo: float
    hi: float
    action: str
    expected_rate: float


def bands(edges: Sequence[float] = SERVING_EDGES, top: float = 1.001) -> list[Band]:
    """The five bands for a set of edges; ``top`` closes the last one."""
    bounds = (0.0, *edges, top)
    return [
        Band(label, i + 1, bounds[i], bounds[i + 1], TIER_ACTIONS[i], TIER_RATES[i])
        for i, label in enumerate(TIERS)
    ]


def tier_dimension(spark: SparkSession, edges: Sequence[float] = SERVING_EDGES, top: float = 1.001) -> DataFrame:
    """The five bands as a frame: five rows, always safe to broadcast."""
    rows = [(b.risk_level, b.tier_order, b.lo, b.hi, b.action, b.expected_rate) for b in bands(edges, top)]
    return spark.createDataFrame(
        rows, "risk_level string, tier_order int, lo double, hi double, action string, expected_rate double"
    )


def with_tier_details(df: DataFrame, columns: Sequence[str] = ("action",)) -> DataFrame:
    """Attach tier attributes to rows that carry ``risk_level``."""
    dim = tier_dimension(df.sparkSession).select("risk_level", *columns)
    return df.join(F.broadcast(dim), "risk_level", "left")
