"""Kept counts of the history: what lookups read instead of the history itself.

The state has two parts. ``base`` holds one row per patient and per provider,
with all rows up to a day; ``days`` holds the same counts per day after it, one
folder per day. New days are counted from those days' rows alone and replace
only their own folders, so a refresh that is repeated changes nothing. Counts
add up, so days are merged into a later base at any time. A reader takes the
latest base and the days after it; folders it no longer needs are left for the
owner to remove.

Rows without a key count for nobody. Rows without a time are not in the state.
One writer at a time; readers may run beside it, as a folder is swapped when
its job commits.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apptlens.functions.cleaning import safe_ratio
from apptlens.operators.history import with_facts_before, with_history_counts
from apptlens.operators.prefix import ROWS_PER_RANGE

KINDS = {"patient": "patient_id", "provider": "attending_physician"}
_COUNTS = ("total", "resolved", "no_shows")
_BASE = "key string, total long, resolved long, no_shows long, upto date, kind string"
_DAYS = "key string, total long, resolved long, no_shows long, day date, kind string"


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in _COUNTS]


def _counted(history: DataFrame, event: str, *by: str) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("key")) for kind, column in KINDS.items()])
    rows = history.select(F.to_date(event).alias("day"), "status", F.inline(keys))
    rows = rows.filter(F.col("key").isNotNull() & F.col("day").isNotNull())
    return rows.groupBy("kind", "key", *by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") != "Scheduled").alias("resolved"),
        F.count_if(F.col("status") == "No-Show").alias("no_shows"),
    )


def day_counts(history: DataFrame, event: str = "appointment_date") -> DataFrame:
    """Rows, resolved rows and no-shows per kind of key, key and day."""
    return _counted(history, event, "day")


def _between(event: str, first: date | None, last: date | None) -> Column:
    """Days first to last, as a condition that a scan can use."""
    at = F.col(event)
    start = lambda d: F.lit(datetime(d.year, d.month, d.day).isoformat(sep=" ")).cast("timestamp_ntz")
    inside = at.isNotNull()
    if first is not None:
        inside = inside & (at >= start(first))
    if last is not None:
        inside = inside & (at < start(last + timedelta(days=1)))
    return inside


class HistoryState:
    """The kept counts under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rebuild(self, history: DataFrame, upto: date, event: str = "appointment_date") -> None:
        """Count all rows up to a day anew. The day must be settled: later changes to its rows are not seen."""
        # Without the days, which the base does not keep.
        self._write_base(_counted(history.filter(_between(event, None, upto)), event), upto)
        # The folder of days, with no day in it yet.
        none = self.spark.createDataFrame([], _DAYS)
        none.write.mode("append").partitionBy("day", "kind").parquet(f"{self.path}/days")

    def refresh(self, history: DataFrame, event: str = "appointment_date", days: Sequence[date] | None = None) -> None:
        """Count the days after the last stored one, and that one again; or only the given days, where rows changed."""
        upto = self.upto()
        if days is not None:
            if not days:
                return
            if min(days) <= upto:
                raise ValueError(f"days up to {upto} are merged; rebuild to count them again")
            rows = history.filter(_between(event, min(days), max(days))).filter(F.to_date(event).isin(list(days)))
        else:
            last = self.last_day()
            rows = history.filter(_between(event, last if last > upto else upto + timedelta(days=1), None))
        counts = day_counts(rows, event).select("key", *_COUNTS, "day", "kind")
        # Even parts, few files per day; a day with very many rows is split again.
        counts = counts.hint("rebalance", "day", "kind")
        writer = counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "kind").parquet(f"{self.path}/days")

    def compact(self, upto: date) -> None:
        """Merge days up to one that is settled into a new base."""
        if upto <= self.upto():
            raise ValueError(f"days up to {self.upto()} are merged already")
        merged = self._base().unionByName(self._days().filter(F.col("day") <= F.lit(upto)).drop("day"))
        self._write_base(merged.groupBy("kind", "key").agg(*_sums()), upto)

    def upto(self) -> date:
        """The last day of the base; a scan of folder names and row counts only."""
        base = self.spark.read.schema(_BASE).parquet(f"{self.path}/base")
        return base.agg(F.max("upto")).first()[0]

    def last_day(self) -> date:
        """The last day that is counted."""
        last = self.spark.read.schema(_DAYS).parquet(f"{self.path}/days").agg(F.max("day")).first()[0]
        return max(self.upto(), last) if last else self.upto()

    def counts(self, kind: str) -> DataFrame:
        """``key``, the counts, and ``day`` (null for the base) of one kind of key."""
        base = self._base().withColumn("day", F.lit(None).cast("date"))
        return base.unionByName(self._days()).filter(F.col("kind") == kind).select("key", "day", *_COUNTS)

    def totals(self, kind: str, resolved_only: bool = False) -> DataFrame:
        """Rows, no-shows and no-show rate per key, under the key's own name."""
        per_key = self.counts(kind).groupBy(F.col("key").alias(KINDS[kind])).agg(*_sums())
        total = F.col("resolved" if resolved_only else "total")
        rates = per_key.select(KINDS[kind], total.alias("total"), "no_shows").filter("total > 0")
        return rates.withColumn("rate", safe_ratio(F.col("no_shows"), F.col("total")))

    def enrich(
        self,
        bookings: DataFrame,
        resolved_only: bool = False,
        hot_rows: int = 1_000_000,
        before: str | None = None,
        rows_per_range: int = ROWS_PER_RANGE,
    ) -> DataFrame:
        """Visit count, patient rate and provider rate for each booking, from the state alone.

        With ``before``, over whole days earlier than the booking's own day in
        that column. A booking made on a day of the base or before raises an
        error: its past is no longer told apart.
        """
        keys = list(KINDS.values())
        if before is None:
            totals = [self.totals(kind, resolved_only) for kind in KINDS]
            return with_history_counts(bookings, *totals, *keys, hot_rows)
        upto = self.upto()
        day = F.to_date(before)
        message = F.lit(f"days up to {upto} are merged")
        # In the moment itself, not in a column that a plan may leave out.
        moment = F.when(day <= F.lit(upto), F.raise_error(message)).otherwise(day).cast("timestamp_ntz")
        facts = [self._facts(kind, upto, resolved_only) for kind in KINDS]
        rows = bookings.withColumn("__day", moment)
        return with_facts_before(rows, *facts, *keys, "__day", rows_per_range).drop("__day")

    def _facts(self, kind: str, upto: date, resolved_only: bool) -> DataFrame:
        """Counts at the day's begin; a row of a later day comes after it."""
        return self.counts(kind).select(
            F.col("key").alias(KINDS[kind]),
            F.coalesce("day", F.lit(upto)).cast("timestamp_ntz").alias("at"),
            F.col("resolved" if resolved_only else "total").alias("seen"),
            F.col("no_shows").alias("hits"),
        )

    def _base(self) -> DataFrame:
        base = self.spark.read.schema(_BASE).parquet(f"{self.path}/base")
        return base.filter(F.col("upto") == F.lit(self.upto())).drop("upto")

    def _days(self) -> DataFrame:
        days = self.spark.read.schema(_DAYS).parquet(f"{self.path}/days")
        return days.filter(F.col("day") > F.lit(self.upto()))

    def _write_base(self, counts: DataFrame, upto: date) -> None:
        base = counts.select("key", *_COUNTS, "kind")
        base.write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/base/upto={upto.isoformat()}")
