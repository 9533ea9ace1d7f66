"""Data profiling: rates by group, bins, histograms, column summaries.

Column profiles unpivot the table once and aggregate all columns together;
no job per column, and no group is held in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apptlens.functions.cleaning import round_n, safe_ratio
from apptlens.operators.prefix import lookup, percentiles, scalars
from apptlens.session import materialize


def rate_by_category(df: DataFrame, category: str, target: str, k: int = 15) -> DataFrame:
    """Outcome rate per category, highest first, top k."""
    rates = df.filter(F.col(category).isNotNull()).groupBy(category)
    rates = rates.agg(F.count("*").alias("n"), F.avg(target).alias("rate"))
    return rates.orderBy(F.desc("rate"), category).limit(k)


def rate_by_quantile_bin(df: DataFrame, value: str, target: str, bins: int = 10) -> DataFrame:
    """Outcome rate per quantile bin ``(lo, hi]``; equal edges are merged.

    The smallest value belongs to the first bin.
    """
    # Stored, the frame is computed once for the edges and the counts.
    rows = materialize(df.select(F.col(value).cast("double").alias("__x"), F.col(target).alias("__y")).dropna(), "binned-values")
    points = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = percentiles(rows, [], "__x", points)
    edges = edges.select(F.array_distinct(F.array(*points)).alias("edges"))
    rows = scalars(rows, edges)
    below = F.size(F.filter("edges", lambda e: e < F.col("__x")))
    rows = rows.withColumn("bin", F.greatest(F.lit(1), below))
    return rows.groupBy("bin").agg(
        F.max(F.get("edges", F.col("bin") - 1)).alias("lo"),
        F.max(F.get("edges", F.col("bin"))).alias("hi"),
        F.count("*").alias("n"),
        F.avg("__y").alias("rate"),
    )


def encounter_type_rates(df: DataFrame, category: str = "ENCNTR_TYPE", flag: str = "QUALIFYING_FLAG") -> DataFrame:
    """Failures per category from a 1 = success flag, highest rate first."""
    stats = df.filter(F.col(category).isNotNull()).groupBy(category)
    stats = stats.agg(F.count(flag).alias("total_appointments"), F.sum(F.col(flag).cast("long")).alias("success_count"))
    stats = stats.withColumn("not_success_count", F.col("total_appointments") - F.col("success_count"))
    rate = safe_ratio(F.col("not_success_count"), F.col("total_appointments"), None) * 100
    return stats.withColumn("not_success_rate", round_n(rate, 2)).orderBy(F.desc("not_success_rate"), category)


def crosstab_margins(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of row by column value, with an ``All`` row and an ``All`` column."""
    known = df.filter(F.col(row).isNotNull() & F.col(column).isin(*values))
    cells = [F.count_if(F.col(column) == v).alias(str(v)) for v in values]
    table = known.rollup(row).agg(*cells, F.count("*").alias("All"), F.grouping(row).alias("__g"))
    label = F.when(F.col("__g") == 1, "All").otherwise(F.col(row).cast("string"))
    return table.select(label.alias(row), *[str(v) for v in values], "All")


def value_counts(df: DataFrame, column: str, by_key: bool = False) -> DataFrame:
    """Frequency of each non-null value, by count (descending) or by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(column) if by_key else counts.orderBy(F.desc("n"), column)


def _long(df: DataFrame, columns: Sequence[str], as_type: str) -> DataFrame:
    return df.select(*[F.col(c).cast(as_type) for c in columns]).unpivot([], list(columns), "column", "value")


def profile_categorical(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """Per text column: distinct values, nulls, most frequent values.

    Ties in frequency go to the smaller value.
    """
    types = dict(df.dtypes)
    counts = _long(df, columns, "string").groupBy("column", "value").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.count("value").alias("unique_count"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
    )
    # The rank filter keeps at most `top` rows per column and task before the
    # shuffle, so a column with very many values is no burden.
    by_count = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    leaders = counts.filter(F.col("value").isNotNull()).withColumn("place", F.row_number().over(by_count))
    leaders = leaders.filter(F.col("place") <= top).groupBy("column")
    leaders = leaders.agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("best"))
    first = F.get("best", F.lit(0))
    kinds = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    return sizes.join(leaders, "column", "left").select(
        "column",
        F.element_at(kinds, F.col("column")).alias("data_type"),
        "unique_count",
        "null_count",
        round_n(safe_ratio(F.col("null_count"), F.col("rows")) * 100, 2).alias("null_pct"),
        first["value"].alias("mode"),
        F.coalesce(first["n"], F.lit(0)).alias("mode_frequency"),
        F.array_join(F.transform("best", lambda b: b["value"]), ", ").alias("top_values"),
    )


def corrected_skewness(g1: Column, n: Column) -> Column:
    """Sample skewness with bias correction; null below three rows."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis with bias correction; null below four rows."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: size, moments, quartiles, distinct values."""
    # Stored, the frame is computed once for the moments, the quartiles and the distinct values.
    long = _long(materialize(df.select(*columns), "profiled"), columns, "double")
    n = F.count("value").cast("double")
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.count_if(F.col("value").isNull()).alias("null_count"),
        round_n(safe_ratio(F.count_if(F.col("value").isNull()), F.count("*")) * 100, 2).alias("null_pct"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.max("value") - F.min("value")).alias("range"),
        corrected_skewness(F.skewness("value"), n).alias("skewness"),
        corrected_kurtosis(F.kurtosis("value"), n).alias("kurtosis"),
    )
    quartiles = percentiles(long, ["column"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    distinct = long.filter(F.col("value").isNotNull()).distinct().groupBy("column").agg(F.count("*").alias("unique_count"))
    # One row per profiled column on every side.
    return moments.join(quartiles, "column", "left").join(distinct, "column", "left").fillna(0, subset=["unique_count"])


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that have nulls, with their number, plus a total row."""
    columns = list(columns or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns]
    pairs.append(F.struct(F.lit("(total)").alias("column"), total.alias("nulls")))
    long = one.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.nulls")
    return long.filter((F.col("nulls") > 0) | (F.col("column") == "(total)"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values: the options of a filter."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def min_max_date(df: DataFrame, column: str = "appointment_date") -> DataFrame:
    """First and last day."""
    return df.agg(F.to_date(F.min(column)).alias("min_date"), F.to_date(F.max(column)).alias("max_date"))


def base_rate(df: DataFrame, target: str) -> DataFrame:
    """Outcome rate, its complement, and negatives per positive."""
    counts = df.agg(F.count_if(F.col(target) == 1).alias("positives"), F.count_if(F.col(target) == 0).alias("negatives"))
    return counts.select(
        "positives",
        "negatives",
        safe_ratio(F.col("positives"), F.col("positives") + F.col("negatives"), None).alias("base_rate"),
        safe_ratio(F.col("negatives"), F.col("positives") + F.col("negatives"), None).alias("show_rate"),
        round_n(safe_ratio(F.col("negatives"), F.col("positives"), None), 4).alias("pos_weight"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, 0-based."""
    rows = df.select(F.col(value).cast("double").alias("__x")).dropna()
    rows = scalars(rows, rows.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi")))
    return _binned(rows, [], bins).select("bin", "lo", "hi", "n")


def histogram_steps(df: DataFrame, value: str, steps: int = 20) -> DataFrame:
    """Bins of width 1/steps over [0, 1]; the last one includes 1. 0-based."""
    edges = F.array(*[F.lit(i / steps) for i in range(1, steps)])
    x = F.col(value)
    rows = df.filter(x.between(0.0, 1.0)).select(F.size(F.filter(edges, lambda e: e <= x)).alias("bin"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"))


def _binned(rows: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.floor((F.col("__x") - F.col("__lo")) / F.when(width > 0, width))
    slot = F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = rows.withColumn("bin", slot).groupBy(*keys, "bin")
    counts = counts.agg(F.count("*").alias("n"), F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    lo = F.col("__lo") + F.col("bin") * width
    return counts.withColumns({"lo": lo, "hi": F.col("__lo") + (F.col("bin") + 1) * width, "width": width})


def histogram_density(df: DataFrame, group: str, value: str, bins: int = 60, cap: float = 180) -> DataFrame:
    """Per group: equal-width bins over the group's own range, area 1."""
    rows = df.filter(F.col(group).isNotNull()).select(group, F.col(value).cast("double").alias("__x")).dropna()
    rows = rows.filter(F.col("__x") <= cap)
    spans = rows.groupBy(group).agg(
        F.count("*").alias("__size"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")
    )
    rows = lookup(rows, spans, [group], "__size")
    counts = _binned(rows, [group, "__size"], bins)
    density = safe_ratio(F.col("n"), F.col("__size") * F.col("width"), None)
    return counts.select(group, "bin", "lo", "hi", "n", density.alias("density"))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Five-number summary per group and the last values within 1.5 IQR."""
    rows = df.filter(F.col(group).isNotNull()).select(group, F.col(value).cast("double").alias("__x")).dropna()
    quartiles = percentiles(rows, [group], "__x", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    rows = lookup(rows, quartiles, [group], "n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    within = F.col("__x").between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(group).agg(
        F.max("n").alias("n"),
        F.min("__x").alias("min"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.max("__x").alias("max"),
        F.min(F.when(within, F.col("__x"))).alias("lower_fence"),
        F.max(F.when(within, F.col("__x"))).alias("upper_fence"),
    )


def schema_listing(df: DataFrame) -> DataFrame:
    """Column names, types and the row count, one row per column."""
    columns = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    listing = df.sparkSession.createDataFrame(columns, "position int, column string, data_type string")
    return scalars(listing, df.agg(F.count("*").alias("rows")))
