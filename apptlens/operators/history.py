"""Patient and provider history: leakage-free running rates and serving lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptlens.functions.cleaning import safe_ratio
from apptlens.operators.prefix import ROWS_PER_RANGE, lookup, running_totals, scalars
from apptlens.session import materialize

# Fixed value: provider rate assumed when a provider has no rows yet.
POPULATION_BASE_RATE = 0.211
# Bookings whose keys are sent to the history, to leave out all other keys.
FEW_ROWS = 100_000
_TIES = 4096


def prior_visit_count(
    df: DataFrame, patient: str, order: Sequence[Column | str], name: str = "prior_visits", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """How many earlier rows the patient has: 0, 1, 2, ..."""
    return running_totals(df, [patient], order, {name: F.lit(1)}, rows_per_range)


def prior_rate(
    df: DataFrame,
    key: str,
    target: str,
    order: Sequence[Column | str],
    name: str,
    default: Column | float = 0.0,
    count_name: str | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    n_rows: int | None = None,
) -> DataFrame:
    """Mean outcome of the key's earlier rows; ``default`` for its first row.

    The row's own outcome is never part of its rate. ``count_name`` also keeps
    the number of earlier rows.
    """
    out = running_totals(
        df, [key], order, {"__hits": F.col(target), "__seen": F.lit(1)}, rows_per_range, n_rows
    )
    fallback = F.lit(default) if isinstance(default, (int, float)) else default
    out = out.withColumn(name, F.when(F.col("__seen") > 0, F.col("__hits") / F.col("__seen")).otherwise(fallback))
    if count_name:
        out = out.withColumn(count_name, F.col("__seen"))
    return out.drop("__hits", "__seen")


def prior_patient_rate(df: DataFrame, patient: str, target: str, order: Sequence[Column | str], **options) -> DataFrame:
    """Running outcome rate of the patient; 0 for a first visit."""
    return prior_rate(df, patient, target, order, options.pop("name", "patient_rate"), 0.0, **options)


def prior_provider_rate(
    df: DataFrame, provider: str, target: str, order: Sequence[Column | str], base_rate: float | None = None, **options
) -> DataFrame:
    """Running outcome rate of the provider; the base rate for its first row.

    The base rate is the table's own mean unless one is given (a training
    job passes the rate of its training part).
    """
    name = options.pop("name", "provider_rate")
    if base_rate is not None:
        return prior_rate(df, provider, target, order, name, float(base_rate), **options)
    columns = df.columns
    with_base = scalars(df, df.agg(F.avg(target).alias("__base")))
    out = prior_rate(with_base, provider, target, order, name, F.col("__base"), **options)
    return out.select(*columns, *[c for c in out.columns if c not in columns and c != "__base"])


def history_rate(history: DataFrame, key: str, resolved_only: bool = False) -> DataFrame:
    """Rows, no-shows and no-show rate per key, over rows of any status."""
    rows = history.filter(F.col(key).isNotNull())
    if resolved_only:
        rows = rows.filter(F.col("status") != "Scheduled")
    stats = rows.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "No-Show").alias("no_shows")
    )
    return stats.withColumn("rate", safe_ratio(F.col("no_shows"), F.col("total")))


def with_history_counts(
    bookings: DataFrame, by_patient: DataFrame, by_provider: DataFrame, patient: str, provider: str, hot_rows: int = 1_000_000
) -> DataFrame:
    """Visit count, patient rate and provider rate from counts per key (``total``, ``rate``)."""
    by_patient = by_patient.select(patient, F.col("total").alias("__visits"), F.col("rate").alias("__patient_rate"))
    by_provider = by_provider.select(provider, F.col("total").alias("__rows"), F.col("rate").alias("__provider_rate"))
    out = lookup(bookings, by_patient, [patient], "__visits", hot_rows)
    out = lookup(out, by_provider, [provider], "__rows", hot_rows)
    return out.select(
        *bookings.columns,
        F.coalesce("__visits", F.lit(0)).alias("patient_visits"),
        F.coalesce("__patient_rate", F.lit(0.0)).alias("patient_rate"),
        F.coalesce("__provider_rate", F.lit(POPULATION_BASE_RATE)).alias("provider_rate"),
    )


def known_before(
    rows: DataFrame, facts: DataFrame, key: str, before: str, seen: str, hits: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Rows with the sums of their key's ``seen`` and ``hits`` over facts earlier than the row's moment.

    ``facts`` has the columns key, ``at``, ``seen`` and ``hits``. Both sides
    are merged into one timeline per key, over which running totals are taken,
    so a key with very many facts is split like any hot key. A fact at the
    very moment of a row is not earlier. Rows without key or moment get 0.
    """
    facts = facts.filter(F.col(key).isNotNull() & F.col("at").isNotNull())
    keys = rows.select(key).filter(F.col(key).isNotNull())
    # For few rows only their keys' facts are worth a shuffle; the count bounds the broadcast.
    if keys.count() <= FEW_ROWS:
        facts = facts.join(F.broadcast(keys.distinct()), key, "left_semi")
    # The key and the moment are shuffled once, as such, where both sides have them in one type.
    twins = {c: t for c, t, told_as in ((before, "__at", "at"), (key, "__key", key)) if rows.schema[c].dataType == facts.schema[told_as].dataType}
    inside = [c for c in rows.columns if c not in twins]
    # The tie only lets equal moments be cut into ranges, so a short one will do.
    tie = F.pmod(F.xxhash64(*rows.columns), F.lit(_TIES)).cast("int")
    asked = rows.select(
        F.struct(F.lit(True).alias("__asked"), *inside).alias("__row"), F.col(key).alias("__key"), F.col(before).alias("__at"),
        F.lit(0).alias("__kind"), tie.alias("__tie"), F.lit(0).cast("long").alias("__s"), F.lit(0).cast("long").alias("__h"),
    )
    told = facts.select(
        F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"), F.col(key).alias("__key"), F.col("at").alias("__at"),
        F.lit(1).alias("__kind"), F.lit(0).alias("__tie"), F.col("seen").cast("long").alias("__s"), F.col("hits").cast("long").alias("__h"),
    )
    totals = {seen: F.col("__s"), hits: F.col("__h")}
    line = running_totals(asked.unionByName(told), ["__key"], ["__at", "__kind", "__tie"], totals, rows_per_range)
    columns = [F.col(twins[c]).alias(c) if c in twins else F.col("__row")[c].alias(c) for c in rows.columns]
    return line.filter("__kind = 0").select(*columns, seen, hits)


def _facts(history: DataFrame, key: str, event: str, resolved_only: bool) -> DataFrame:
    rows = history.filter(F.col("status") != "Scheduled") if resolved_only else history
    no_show = F.coalesce(F.col("status") == "No-Show", F.lit(False)).cast("long")
    return rows.select(key, F.col(event).alias("at"), F.lit(1).alias("seen"), no_show.alias("hits"))


def with_facts_before(
    bookings: DataFrame, by_patient: DataFrame, by_provider: DataFrame, patient: str, provider: str, before: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Visit count, patient rate and provider rate from facts earlier than the booking's moment."""
    # Stored, one sort is done with before the other begins, and its files are gone.
    out = materialize(known_before(bookings, by_patient, patient, before, "__visits", "__missed", rows_per_range), "known")
    out = known_before(out, by_provider, provider, before, "__rows", "__lost", rows_per_range)
    return out.select(
        *bookings.columns,
        F.col("__visits").alias("patient_visits"),
        F.when(F.col("__visits") > 0, F.col("__missed") / F.col("__visits")).otherwise(F.lit(0.0)).alias("patient_rate"),
        F.when(F.col("__rows") > 0, F.col("__lost") / F.col("__rows")).otherwise(F.lit(POPULATION_BASE_RATE)).alias("provider_rate"),
    )


def enrich_history(
    bookings: DataFrame,
    history: DataFrame,
    patient: str = "patient_id",
    provider: str = "attending_physician",
    resolved_only: bool = False,
    hot_rows: int = 1_000_000,
    before: str | None = None,
    event: str = "appointment_date",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Visit count, patient rate and provider rate for each booking.

    Without ``before``, over all of history. With it, over the history rows
    whose ``event`` is earlier than the booking's own moment in that column, as
    a model is trained: nothing later than the booking is looked at.
    """
    if before is not None:
        facts = [_facts(history, key, event, resolved_only) for key in (patient, provider)]
        return with_facts_before(bookings, *facts, patient, provider, before, rows_per_range)
    counts = [history_rate(history, key, resolved_only) for key in (patient, provider)]
    return with_history_counts(bookings, *counts, patient, provider, hot_rows)


def total_visit_count(df: DataFrame, patient: str, counted: str, name: str = "total_visits", hot_rows: int = 1_000_000) -> DataFrame:
    """Non-null count of a column per patient on every row (includes later rows)."""
    size = df.filter(F.col(patient).isNotNull()).groupBy(patient)
    size = size.agg(F.count("*").alias("__rows"), F.count(counted).alias(name))
    return lookup(df, size, [patient], "__rows", hot_rows).drop("__rows")
