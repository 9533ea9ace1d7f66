"""The scoring job: bookings in, scored table rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apptlens.operators.models import RiskModel
from apptlens.plans.features import build_features
from apptlens.session import materialize
from apptlens.sources.appointments_table import append_scored_bookings
from apptlens.sources.batches import append_batch
from apptlens.sources.history_state import HistoryState


def score_bookings(
    bookings: DataFrame,
    history: DataFrame | HistoryState,
    model: RiskModel,
    encoders: DataFrame,
    before: str | None = None,
    resolved_only: bool = False,
) -> DataFrame:
    """Bookings with predicted_risk_prob and risk_level.

    The booking travels with its model inputs as one column, so nothing has to
    be joined back afterwards. With ``before`` (a column of the bookings) rates
    are those known at the booking's own moment, as in training.
    """
    kept = [c for c in bookings.columns if c not in ("predicted_risk_prob", "risk_level")]
    rows = bookings.withColumn("__booking", F.struct(*kept))
    inputs = build_features(rows, history, encoders, model.features, keep=["__booking"], before=before, resolved_only=resolved_only)
    scored = model.score(inputs)
    return scored.select("__booking.*", F.col("p").alias("predicted_risk_prob"), "risk_level")


def book(
    spark: SparkSession,
    table_path: str,
    bookings: DataFrame,
    history: DataFrame | HistoryState,
    model: RiskModel,
    encoders: DataFrame,
    batch: str | None = None,
) -> None:
    """Score bookings and add them to the appointments table; with a ``batch`` key, to a table of batches, once."""
    # Numbering reads the bookings several times; stored, they are scored once.
    scored = materialize(score_bookings(bookings, history, model, encoders), "scored")
    if batch is None:
        append_scored_bookings(spark, table_path, scored)
    else:
        append_batch(spark, table_path, scored, batch)
