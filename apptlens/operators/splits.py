"""Splits and samples: repeatable, exact in size, spread over all tasks.

The order of a split is a hash of the row key, so a row's part does not depend
on file layout or partitioning. Ranks come from ``row_numbers``, which splits
large classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptlens.operators.prefix import ROWS_PER_RANGE, lookup, row_numbers, scalars


def hash_order(*keys: str, seed: int = 42) -> Column:
    """Default shuffling order of rows."""
    return F.xxhash64(*keys, F.lit(seed))


def _portion(share: float, n: Column) -> Column:
    return F.floor(n * share + 0.5)


def _ranked(df: DataFrame, label: str, order: Column, key: str, rows_per_range: int) -> DataFrame:
    ranked = row_numbers(df, [label], [order, key], "__rank", rows_per_range)
    sizes = df.groupBy(label).agg(F.count("*").alias("__size"))
    return lookup(ranked, sizes, [label], "__size")


def split_stratified_3way(
    df: DataFrame,
    label: str,
    key: str,
    order: Column | None = None,
    test: float = 0.20,
    calibration: float = 0.20,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``part``: test, then calibration from the rest, then train; per class."""
    order = hash_order(key) if order is None else order
    ranked = _ranked(df, label, order, key, rows_per_range)
    n_test = _portion(test, F.col("__size"))
    n_cal = _portion(calibration, F.col("__size") - n_test)
    part = F.when(F.col("__rank") <= n_test, "test").when(F.col("__rank") <= n_test + n_cal, "calibration").otherwise("train")
    return ranked.select(*df.columns, part.alias("part"))


def split_by_group(
    df: DataFrame, group: str, order: Column | None = None, test: float = 0.25, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Group keys with their side (train / test); a group is never divided."""
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct()
    order = hash_order(group) if order is None else order
    ranked = row_numbers(groups, [], [order, group], "__rank", rows_per_range)
    ranked = scalars(ranked, groups.agg(F.count("*").alias("__size")))
    side = F.when(F.col("__rank") <= F.ceil(F.col("__size") * test), "test").otherwise("train")
    return ranked.select(group, side.alias("side"))


def semi_join_groups(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the group list."""
    return df.join(groups.select(key).distinct(), key, "left_semi")


def overlap_count(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys two sets share: zero for a clean split."""
    return left.select(key).intersect(right.select(key)).agg(F.count("*").alias("overlap"))


def stratified_sample(
    df: DataFrame, label: str, key: str, n: int, order: Column | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """About n rows with the class shares of the table (each class rounded)."""
    order = hash_order(key) if order is None else order
    ranked = scalars(_ranked(df, label, order, key, rows_per_range), df.agg(F.count("*").alias("__all")))
    quota = F.floor(F.col("__size") * F.least(F.lit(n), F.col("__all")) / F.col("__all") + 0.5)
    return ranked.filter(F.col("__rank") <= quota).select(*df.columns)


def kfold_stratified(
    df: DataFrame, label: str, key: str, k: int = 3, order: Column | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add ``fold`` 0..k-1, each with the class shares of the table."""
    order = hash_order(key) if order is None else order
    ranked = row_numbers(df, [label], [order, key], "__rank", rows_per_range)
    return ranked.select(*df.columns, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int").alias("fold"))


def background_sample(df: DataFrame, key: str, n: int = 100, order: Column | None = None) -> DataFrame:
    """The n rows that come first in hash order."""
    order = hash_order(key) if order is None else order
    return df.orderBy(order, key).limit(n)
