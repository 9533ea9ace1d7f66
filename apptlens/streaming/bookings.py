"""Score arriving bookings and store them.

Every micro-batch is scored like any batch of bookings: history rates are
looked up as of the batch start. A batch owns one folder of the sink and
overwrites it, so a batch that is retried after a failure is stored once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from apptlens.operators.models import RiskModel
from apptlens.plans.scoring import score_bookings
from apptlens.schemas import APPOINTMENTS_SCHEMA
from apptlens.sources.appointments_table import complete_bookings

# Ids of a batch start at its number times this.
IDS_PER_BATCH = 1 << 40


def start_scoring(
    bookings: DataFrame,
    sink: str,
    checkpoint: str,
    history: Callable[[], DataFrame],
    model: RiskModel,
    encoders: DataFrame,
    **trigger,
) -> StreamingQuery:
    """Start scoring a stream of bookings; ``history`` reads the current table."""

    def store(batch: DataFrame, batch_id: int) -> None:
        scored = score_bookings(batch, history(), model, encoders)
        rows = complete_bookings(scored, F.lit(batch_id * IDS_PER_BATCH))
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = bookings.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start() if trigger else writer.start()


def read_scored(spark, sink: str) -> DataFrame:
    """All stored bookings."""
    return spark.read.schema(APPOINTMENTS_SCHEMA).parquet(sink).select(*APPOINTMENTS_SCHEMA.fieldNames())
