"""Label encoding and feature alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptlens.functions.cleaning import round_n, safe_ratio
from apptlens.operators.prefix import ROWS_PER_RANGE, row_numbers, scalars
from apptlens.session import materialize

# What code tables may take in every executor's memory, and a code besides its text.
BROADCAST_BYTES = 48 << 20
BYTES_PER_CODE = 64


def label_encode_fit(df: DataFrame, columns: Sequence[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(column, value, code): per column, values in text order to 0..n-1.

    All columns are fitted in one pass over the table.
    """
    values = df.select(*[F.col(c).cast("string") for c in columns]).unpivot([], list(columns), "column", "value")
    # Stored, the table is scanned once for ranking and fitting together.
    values = materialize(values.filter(F.col("value").isNotNull()).distinct(), "labels")
    ranked = row_numbers(values, ["column"], ["value"], "code", rows_per_range)
    return ranked.select("column", "value", (F.col("code") - 1).cast("int").alias("code"))


def label_encode_apply(df: DataFrame, encoders: DataFrame, columns: Sequence[str], default: int | None = 0) -> DataFrame:
    """Replace each column by its code; unseen values take the first class.

    Code tables that are small by count and length are broadcast: a join that
    adaptive execution finds small has shuffled the rows already. The others
    are joined without a hint.
    """
    small = _small_tables(encoders, columns)
    out = df
    for c in columns:
        codes = encoders.filter(F.col("column") == c).select(
            F.col("value").alias("__value"), F.col("code").alias("__code")
        )
        codes = F.broadcast(codes) if c in small else codes
        code = F.col("__code") if default is None else F.coalesce("__code", F.lit(default))
        out = out.join(codes, F.col(c).cast("string") == F.col("__value"), "left")
        out = out.withColumn(c, code).drop("__value", "__code")
    return out.select(*df.columns)


def pack_codes(df: DataFrame, encoders: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with their codes (none missing) in as few longs as hold them, and the columns that give them back."""
    largest = {r["column"]: r["most"] for r in encoders.groupBy("column").agg(F.max("code").alias("most")).collect()}
    packs: list[Column] = []
    codes, used = {}, 63
    for c in columns:
        bits = max(1, largest.get(c, 0).bit_length())
        if used + bits > 63:
            packs.append(F.lit(0).cast("long"))
            used = 0
        packs[-1] = packs[-1].bitwiseOR(F.shiftleft(F.col(c).cast("long"), used))
        pack = F.col(f"__codes{len(packs) - 1}")
        codes[c] = F.shiftright(pack, used).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
        used += bits
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *[p.alias(f"__codes{i}") for i, p in enumerate(packs)]), codes


def _small_tables(encoders: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns whose code tables together take at most ``BROADCAST_BYTES``, smallest first."""
    of = encoders.filter(F.col("column").isin(*columns)).groupBy("column")
    sizes = of.agg(F.sum(F.octet_length("value") + BYTES_PER_CODE).alias("bytes")).collect()
    small, total = set(columns) - {r["column"] for r in sizes}, 0
    for r in sorted(sizes, key=lambda r: r["bytes"]):
        total += r["bytes"]
        if total <= BROADCAST_BYTES:
            small.add(r["column"])
    return small


def label_decode(df: DataFrame, encoders: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace codes by the original text."""
    out = df
    for c in columns:
        codes = encoders.filter(F.col("column") == c).select(
            F.col("value").alias("__value"), F.col("code").alias("__code")
        )
        out = out.join(codes, F.col(c) == F.col("__code"), "left")
        out = out.withColumn(c, F.col("__value")).drop("__value", "__code")
    return out.select(*df.columns)


def encoding_map(encoders: DataFrame, column: str) -> DataFrame:
    """The value-to-code list of one column."""
    return encoders.filter(F.col("column") == column).select("value", "code").orderBy("code")


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The features in order, absent ones as 0; other columns dropped."""
    present = set(df.columns)
    return df.select(*keep, *[F.col(f) if f in present else F.lit(0).alias(f) for f in features])


def select_by_type(df: DataFrame) -> dict[str, list[str]]:
    """Column names by kind: text or numeric."""
    fields = df.schema.fields
    return {
        "text": [f.name for f in fields if isinstance(f.dataType, T.StringType)],
        "numeric": [f.name for f in fields if isinstance(f.dataType, T.NumericType)],
    }


def except_columns(columns: Sequence[str], excluded: Sequence[str]) -> list[str]:
    """Columns that are not excluded, order kept."""
    return [c for c in columns if c not in set(excluded)]


def class_weight(df: DataFrame, label: str, balanced: bool = False) -> DataFrame:
    """Row weights against imbalance.

    Positives weigh negatives/positives (4 digits) and negatives 1; or, when
    ``balanced``, every class n / (2 * class size).
    """
    sizes = df.agg(
        F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) == 0).alias("__n")
    )
    out = scalars(df, sizes)
    if balanced:
        n = F.col("__p") + F.col("__n")
        mine = F.when(F.col(label) == 1, F.col("__p")).otherwise(F.col("__n"))
        weight = safe_ratio(n, 2 * mine, 1.0)
    else:
        ratio = round_n(safe_ratio(F.col("__n"), F.col("__p"), 1.0), 4)
        weight = F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0))
    return out.select(*df.columns, weight.alias("weight"))
