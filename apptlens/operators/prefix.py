"""Running totals, ranks and percentiles that survive hot keys.

A window function sorts one key's rows inside one task. That fails when a key
holds a large part of the table, or when there is no key at all. Here keys are
split where needed: a small deterministic sample finds keys with more rows
than one task should sort and cuts each into order ranges of about equal size.
Totals inside a range come from a window over (key, range); the totals of the
earlier ranges of the same key are added through a broadcast join of at most
``MAX_RANGES`` rows. Keys below the limit are one range and pay only a
broadcast lookup. Rows are shuffled once.

The cut points are collected once and used as data, so a recomputed task
(executor loss, speculation) sees the same ranges. They affect speed only:
any cut points give the same totals.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apptlens.session import materialize

# Rows one task should sort at most, and how finely hot keys may be cut.
ROWS_PER_RANGE = 2_000_000
MAX_RANGES = 16_384
SAMPLE_PER_RANGE = 20
# Rank error of quantile sketches is rows / ACCURACY; keys that get a sketch each, at most.
ACCURACY = 10_000
MAX_SKETCHES = 1_000
# Inputs below this many bytes per value that one task may sort are counted without a look at their values.
BYTES_PER_VALUE = 64

_HASH_SPACE = 1 << 40


def _sampled_cuts(work: DataFrame, n_keys: int, n_order: int, n_rows: int, rows_per_range: int) -> dict:
    """Cut points per hot key, from a hash sample of bounded expected size."""
    ranges = min(MAX_RANGES, ceil(n_rows / rows_per_range))
    share = min(1.0, SAMPLE_PER_RANGE * ranges / n_rows)
    order_cols = [f"__o{i}" for i in range(n_order)]
    key_cols = [f"__k{i}" for i in range(n_keys)]
    picked = work.select(*key_cols, *order_cols).dropna(subset=order_cols)
    if share < 1.0:
        picked = picked.filter(F.pmod(F.xxhash64(*key_cols, *order_cols), F.lit(_HASH_SPACE)) < int(share * _HASH_SPACE))
    # Equal points come as one row with a weight, so the sample stays small
    # even when very many rows tie.
    per_key = defaultdict(list)
    for row in picked.groupBy(*key_cols, *order_cols).count().collect():
        per_key[tuple(row[:n_keys])].append((tuple(row[n_keys:-1]), row[-1]))
    # Every so many sampled rows of a key is a cut. With a full sample (tiny
    # tables in tests) a range is rows_per_range rows.
    step = SAMPLE_PER_RANGE if share < 1.0 else rows_per_range
    cuts = {}
    for key, points in per_key.items():
        points.sort()
        chosen, passed = [], 0
        for point, weight in points:
            if passed >= step:
                chosen.append(point)
                passed = 0
            passed += weight
        if chosen:
            cuts[key] = chosen
    return cuts


def _range_number(point: Column, steps: Sequence[int]) -> Column:
    """How many cut points lie at or before the row: a binary search."""
    cuts = F.col("__cuts")
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda found, s: found + F.when(F.get(cuts, found + s - 1) <= point, s).otherwise(0),
    )


def _attach_ranges(work: DataFrame, n_keys: int, n_order: int, cuts: dict) -> DataFrame:
    """Add ``__cuts`` (null for cold keys) and the range number ``__r``."""
    spark = work.sparkSession
    key_fields = [T.StructField(f"__k{i}", work.schema[f"__k{i}"].dataType) for i in range(n_keys)]
    point_type = T.StructType([T.StructField(f"__o{i}", work.schema[f"__o{i}"].dataType) for i in range(n_order)])
    cut_field = T.StructField("__cuts", T.ArrayType(point_type))
    rows = [(*key, points) for key, points in cuts.items()]
    table = spark.createDataFrame(rows, T.StructType([*key_fields, cut_field]))
    if n_keys:
        # At most MAX_RANGES cut points in all: bounded, whatever the table size.
        right = table.select(*[F.col(f"__k{i}").alias(f"__h{i}") for i in range(n_keys)], "__cuts")
        match = [F.col(f"__k{i}").eqNullSafe(F.col(f"__h{i}")) for i in range(n_keys)]
        work = work.join(F.broadcast(right), match, "left").drop(*[f"__h{i}" for i in range(n_keys)])
    else:
        work = work.withColumn("__cuts", table.select("__cuts").scalar())
    longest = max(len(points) for points in cuts.values())
    steps = [1 << b for b in reversed(range(longest.bit_length()))]
    point = F.struct(*[F.col(f"__o{i}") for i in range(n_order)])
    number = F.when(F.col("__cuts").isNull(), 0).otherwise(_range_number(point, steps))
    return work.withColumn("__r", number)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    measures: Mapping[str, Column],
    rows_per_range: int = ROWS_PER_RANGE,
    n_rows: int | None = None,
) -> DataFrame:
    """Add, per measure, its total over the *earlier* rows of the same key.

    ``order`` is ascending and must identify rows for a repeatable result
    (rows that tie on it also stay in one task); negate a number to run from
    high to low. The first row of a key gets 0.
    ``n_rows`` (an upper estimate will do) saves the counting job.
    """
    # Columns that are a key or the order themselves are shuffled once, as that.
    names = [*keys, *order]
    twins = [*(f"__k{i}" for i in range(len(keys))), *(f"__o{i}" for i in range(len(order)))]
    carried = {n: t for n, t in zip(names, twins) if isinstance(n, str) and n in df.columns}
    columns = [F.col(carried[c]).alias(c) if c in carried else F.col(c) for c in df.columns]
    rest = [c for c in df.columns if c not in carried]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    n_keys, n_order = len(keys), len(order)
    if n_rows is None:
        n_rows = df.count()
    work = df.select(
        *rest,
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        *[o.alias(f"__o{i}") for i, o in enumerate(order)],
        *[m.alias(f"__m{i}") for i, m in enumerate(measures.values())],
    )
    key_cols = [f"__k{i}" for i in range(n_keys)]
    order_cols = [f"__o{i}" for i in range(n_order)]
    cuts = _sampled_cuts(work, n_keys, n_order, n_rows, rows_per_range) if n_rows > rows_per_range else {}
    if cuts:
        work = _attach_ranges(work, n_keys, n_order, cuts)
        frame = Window.partitionBy(*key_cols, "__r")
    else:
        frame = Window.partitionBy(*key_cols)
    frame = frame.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    inside = [F.coalesce(F.sum(f"__m{i}").over(frame), F.lit(0)) for i in range(len(measures))]
    ranged = work
    # In two steps, else the names would be given back before the shuffle.
    work = work.select("*", *[x.alias(f"__in{i}") for i, x in enumerate(inside)])
    if not cuts:
        return work.select(*columns, *[F.col(f"__in{i}").alias(name) for i, name in enumerate(measures)])

    totals = (
        ranged.filter(F.col("__cuts").isNotNull())
        .groupBy(*key_cols, "__r")
        .agg(*[F.sum(f"__m{i}").alias(f"__s{i}") for i in range(len(measures))])
    )
    # One row per range of a hot key: at most MAX_RANGES plus the hot keys.
    earlier = Window.partitionBy(*key_cols).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(f"__k{i}").alias(f"__h{i}") for i in range(n_keys)],
        F.col("__r").alias("__hr"),
        *[F.sum(f"__s{i}").over(earlier).alias(f"__before{i}") for i in range(len(measures))],
    )
    match = [F.col("__r") == F.col("__hr")]
    match += [F.col(f"__k{i}").eqNullSafe(F.col(f"__h{i}")) for i in range(n_keys)]
    work = work.join(F.broadcast(offsets), match, "left")
    return work.select(
        *columns,
        *[
            (F.col(f"__in{i}") + F.coalesce(F.col(f"__before{i}"), F.lit(0))).alias(name)
            for i, name in enumerate(measures)
        ],
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str,
    rows_per_range: int = ROWS_PER_RANGE,
    n_rows: int | None = None,
) -> DataFrame:
    """Add a 1-based row number per key without sorting a key in one task."""
    out = running_totals(df, keys, order, {name: F.lit(1)}, rows_per_range, n_rows)
    return out.withColumn(name, F.col(name) + 1)


def lookup(
    df: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    size: str,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Left join of per-key values to rows, safe when a key is very frequent.

    ``groups`` has one row per key and a column ``size`` with the key's row
    count. Keys with at least ``hot_rows`` rows number at most
    rows / hot_rows, so they are broadcast; their rows are spread over all
    tasks of the shuffle join instead of meeting in one. Null keys match
    nothing, as in any equi-join.
    """
    values = [c for c in groups.columns if c not in keys]
    hot = groups.filter(F.col(size) >= hot_rows)
    hot = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.struct(*values).alias("__hot"))
    rest = groups.filter(F.col(size) < hot_rows)
    # Always 0, but not a literal: the optimizer would turn a comparison with a
    # literal into a filter, and the salt would no longer spread the shuffle.
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).alias("__salt_c")
    rest = rest.select(*[F.col(k).alias(f"__c_{k}") for k in keys], zero, F.struct(*values).alias("__cold"))
    out = df.join(F.broadcast(hot), [F.col(k) == F.col(f"__h_{k}") for k in keys], "left")
    idle = F.col("__hot").isNotNull()
    for k in keys:
        idle = idle | F.col(k).isNull()
    # Rows already answered (or without a key) get a spread-out salt, and so
    # find no partner and no crowded task.
    out = out.withColumn("__salt", F.when(idle, 1 + F.pmod(F.xxhash64(*df.columns), F.lit(4096))).otherwise(0))
    match = [F.col(k) == F.col(f"__c_{k}") for k in keys] + [F.col("__salt") == F.col("__salt_c")]
    out = out.join(rest, match, "left")
    return out.select(*df.columns, *[F.coalesce(f"__hot.{v}", f"__cold.{v}").alias(v) for v in values])


def scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row as scalar subqueries."""
    names = one_row.columns
    attached = df.select("*", one_row.select(F.struct(*names).alias("s")).scalar().alias("__one"))
    return attached.select(*df.columns, *[F.col(f"__one.{n}").alias(n) for n in names])


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Mapping[str, float],
    rows_per_range: int = ROWS_PER_RANGE,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key.

    A column of few distinct values is reduced to counts per value (combined
    before the shuffle), over which running totals give the ranks; so is any
    small input. Where there are more than ``rows_per_range`` distinct values
    and at most ``MAX_SKETCHES`` keys, a quantile sketch per key first brackets every percentile, and one
    pass counts the rows below each bracket and the values inside it: about
    8 / ``accuracy`` of the rows per point are shuffled, however many values
    are distinct (of a key with fewer rows than ``accuracy``, all). Ranks are checked, so a bracket that misses its percentile
    leads back to the counts. No group is ever held in one task. Adds ``n``,
    the non-null row count.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    if _input_bytes(df) > BYTES_PER_VALUE * rows_per_range:
        kinds = F.approx_count_distinct(F.struct(*keys) if keys else F.lit(1)).alias("keys")
        shape = rows.agg(F.approx_count_distinct(F.struct(*keys, "__v")).alias("values"), kinds).first()
        if shape["values"] > rows_per_range and shape["keys"] <= MAX_SKETCHES:
            found = _bracketed_percentiles(rows, keys, points, rows_per_range, accuracy)
            if found is not None:
                return found
    return _counted_percentiles(rows, keys, points, rows_per_range)


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the tables a frame is made from, as the plan knows them; no job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _bracketed_percentiles(
    rows: DataFrame, keys: Sequence[str], points: Mapping[str, float], rows_per_range: int, accuracy: int
) -> DataFrame | None:
    """Percentiles from the values near them; None where a bracket holds no such rank."""
    spark = rows.sparkSession
    # The sketch's own error twice over, and a few ranks for interpolation.
    margin = 4 / accuracy
    edges = [min(1.0, max(0.0, q + side)) for q in points.values() for side in (-margin, margin)]
    sketch = F.percentile_approx("__v", edges, accuracy).alias("e")
    ends = [F.min("__v").alias("least"), F.max("__v").alias("most")]
    brackets = rows.groupBy(*keys).agg(F.count("*").alias("n"), sketch, *ends)
    # At most MAX_SKETCHES rows, a few more where the estimate was low.
    found = brackets.collect()
    told = []
    for r in found:
        marks = [
            (i, r["least"] if lo <= 0 or r["n"] < accuracy else r["e"][2 * i], r["most"] if hi >= 1 or r["n"] < accuracy else r["e"][2 * i + 1])
            for i, (lo, hi) in enumerate(zip(edges[::2], edges[1::2]))
        ]
        told.append((*[r[k] for k in keys], r["n"], marks))
    key_types = [rows.schema[k] for k in keys]
    mark = T.StructType([T.StructField("__i", T.IntegerType()), T.StructField("__lo", T.DoubleType()), T.StructField("__hi", T.DoubleType())])
    schema = T.StructType(
        [*[T.StructField(f"__h_{f.name}", f.dataType) for f in key_types], T.StructField("n", T.LongType()), T.StructField("__marks", T.ArrayType(mark))]
    )
    table = F.broadcast(spark.createDataFrame(told, schema))
    same = [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys] or [F.lit(True)]
    sides = rows.join(table, same) if keys else scalars(rows, table)
    # Rows below a bracket are only counted; of those inside, the value matters.
    near = F.filter("__marks", lambda m: F.col("__v") <= m["__hi"])
    near = F.transform(near, lambda m: F.struct(m["__i"].alias("__i"), F.when(F.col("__v") >= m["__lo"], F.col("__v")).alias("__v")))
    counts = sides.select(*keys, "n", F.inline(near)).groupBy(*keys, "n", "__i", "__v").agg(F.count("*").alias("__n"))
    counts = materialize(counts, "bracketed")
    below = counts.filter(F.col("__v").isNull()).select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col("__i").alias("__j"), F.col("__n").alias("__below"))
    inside = running_totals(counts.filter(F.col("__v").isNotNull()), [*keys, "__i"], ["__v"], {"__run": F.col("__n")}, rows_per_range)
    # One row per key and point.
    match = [F.col("__i") == F.col("__j"), *[F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys]]
    ranked = inside.join(F.broadcast(below), match, "left").withColumn("__before", F.col("__run") + F.coalesce("__below", F.lit(0)))
    share = F.get(F.array(*[F.lit(float(q)) for q in points.values()]), F.col("__i"))
    place = (F.col("n") - 1) * share

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n")), F.col("__v")))

    picked = ranked.groupBy(*keys, "n", "__i").agg(
        at(F.floor(place)).alias("__lo"), at(F.ceil(place)).alias("__hi"), F.max(place - F.floor(place)).alias("__f")
    )
    mixed = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")
    result = picked.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("__i") == i, mixed)).alias(name) for i, name in enumerate(points)])
    result = materialize(result, "percentiles").select(*keys, "n", *points)
    missing = F.lit(False)
    for name in points:
        missing = missing | F.col(name).isNull()
    whole = result.agg(F.count("*").alias("n"), F.count_if(missing).alias("missing")).first()
    return result if whole["n"] == len(found) and whole["missing"] == 0 else None


def _counted_percentiles(rows: DataFrame, keys: Sequence[str], points: Mapping[str, float], rows_per_range: int) -> DataFrame:
    """Percentiles from counts per distinct value."""
    # Several steps read the counts; stored, they are computed once.
    counts = materialize(rows.groupBy(*keys, "__v").agg(F.count("*").alias("__n")), "counts")
    n_rows = counts.count()
    if n_rows <= rows_per_range:
        all_of_key = Window.partitionBy(*keys)
        earlier = all_of_key.orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("__n").over(earlier), F.lit(0))
        ranked = counts.select("*", before.alias("__before"), F.sum("__n").over(all_of_key).alias("n"))
    else:
        ranked = running_totals(counts, keys, ["__v"], {"__before": F.col("__n")}, rows_per_range, n_rows)
        size = counts.groupBy(*keys).agg(F.sum("__n").alias("n"), F.count("*").alias("__distinct"))
        if keys:
            # As one struct, so that a null key finds its group.
            by = F.struct(*keys).alias("__key")
            ranked = lookup(ranked.select("*", by), size.select(by, "n", "__distinct"), ["__key"], "__distinct")
        else:
            ranked = scalars(ranked, size)
    picks = []
    for i, q in enumerate(points.values()):
        place = (F.col("n") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))
            picks.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{side}{i}"))
        picks.append(F.max(place - F.floor(place)).alias(f"__f{i}"))
    picked = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    result = [
        (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(name)
        for i, name in enumerate(points)
    ]
    return picked.select(*keys, "n", *result)
