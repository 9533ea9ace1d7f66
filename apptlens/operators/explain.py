"""Per-feature contributions: exact tree attribution and the tables built on it.

A row carries its contributions as ``array<struct<feature, value>>``. Ranking
and running sums work inside that array, so none of them shuffles rows; only
the global ranking aggregates, and it combines before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apptlens.functions.text import as_signed, decode_feature_value
from apptlens.session import shared_dir


def zip_names_values(df: DataFrame, names: Sequence[str], values: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (feature, value), pairing names and an array by position."""
    return df.select(*keep, F.explode(named_values(names, F.col(values))).alias("p")).select(*keep, "p.feature", "p.value")


def named_values(names: Sequence[str], values: Column) -> Column:
    """An array of numbers as an array of (feature, value)."""
    return F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), values.alias("value"))


def _by_strength(contribs: Column, strongest_first: bool) -> Column:
    sign = -1 if strongest_first else 1
    return F.array_sort(
        F.transform(
            contribs,
            lambda c: F.struct((F.abs(c["value"]) * sign).alias("key"), c["feature"].alias("feature"), c["value"].alias("value")),
        )
    )


def contrib_global(df: DataFrame, contribs: str = "contribs") -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    long = df.select(F.explode(contribs).alias("c"))
    means = long.groupBy(F.col("c.feature").alias("feature")).agg(F.avg(F.abs("c.value")).alias("mean_abs"))
    return means.orderBy(F.desc("mean_abs"), "feature")


def rank_abs_contrib(df: DataFrame, keep: Sequence[str] = ("id",), k: int | None = None, contribs: str = "contribs") -> DataFrame:
    """The features of each row by absolute contribution, strongest first."""
    ordered = _by_strength(F.col(contribs), strongest_first=True)
    if k is not None:
        ordered = F.slice(ordered, 1, k)
    long = df.select(*keep, F.posexplode(ordered).alias("pos", "c"))
    return long.select(*keep, F.col("c.feature").alias("feature"), F.col("c.value").alias("value"), (F.col("pos") + 1).alias("place"))


def topk_contrib(df: DataFrame, k: int = 5, keep: Sequence[str] = ("id",)) -> DataFrame:
    """The k strongest features per row with the direction in words."""
    direction = F.when(F.col("value") > 0, "Increases Risk").otherwise("Decreases Risk")
    return rank_abs_contrib(df, keep, k).withColumns({"direction": direction, "value_text": as_signed(F.col("value"))})


def contrib_waterfall(df: DataFrame, keep: Sequence[str] = ("id",), contribs: str = "contribs") -> DataFrame:
    """Running sum of contributions per row, weakest feature first."""
    start = F.array().cast("array<struct<feature:string,value:double,end:double>>")

    def add(done: Column, c: Column) -> Column:
        total = F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0.0)) + c["value"]
        return F.array_append(done, F.struct(c["feature"].alias("feature"), c["value"].alias("value"), total.alias("end")))

    steps = F.aggregate(_by_strength(F.col(contribs), strongest_first=False), start, add)
    long = df.select(*keep, F.posexplode(steps).alias("pos", "c"))
    end, value = F.col("c.end"), F.col("c.value")
    return long.select(
        *keep,
        F.col("c.feature").alias("feature"),
        value.alias("value"),
        (F.col("pos") + 1).alias("step"),
        (end - value).alias("start"),
        end.alias("end"),
        as_signed(value).alias("value_text"),
    )


def contrib_with_values(
    df: DataFrame, numbers: Sequence[str], categories: dict[str, str], keep: Sequence[str] = ("id",), contribs: str = "contribs"
) -> DataFrame:
    """Contributions next to the model input and its readable value.

    ``numbers`` are the model input columns; ``categories`` maps encoded
    inputs to the columns with the original text.
    """
    inputs = F.create_map(*[x for n in numbers for x in (F.lit(n), F.col(n).cast("double"))])
    texts = F.create_map(
        *[x for n in numbers for x in (F.lit(n), F.col(categories[n]) if n in categories else F.lit(None).cast("string"))]
    )
    long = df.select(*keep, inputs.alias("__in"), texts.alias("__text"), F.explode(contribs).alias("c"))
    feature = F.col("c.feature")
    raw, category = F.element_at("__in", feature), F.element_at("__text", feature)
    return long.select(
        *keep,
        feature.alias("feature"),
        F.col("c.value").alias("value"),
        raw.alias("raw_value"),
        decode_feature_value(feature, raw, category).alias("display"),
    )


def contrib_top5(
    df: DataFrame, numbers: Sequence[str], categories: dict[str, str], keep: Sequence[str] = ("id",), k: int = 5
) -> DataFrame:
    """The k strongest features per row with direction and readable value."""
    best = F.transform(
        F.slice(_by_strength(F.col("contribs"), strongest_first=True), 1, k),
        lambda c: F.struct(c["feature"].alias("feature"), c["value"].alias("value")),
    )
    out = contrib_with_values(df.withColumn("contribs", best), numbers, categories, keep)
    direction = F.when(F.col("value") > 0, "Increases Risk").otherwise("Decreases Risk")
    return out.withColumns({"direction": direction, "value_text": as_signed(F.col("value"))})


# --- tree attribution --------------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    """A leaf as a box: one interval per feature on its path.

    ``share`` is, per feature, the fraction of training weight that the path
    keeps at the splits on that feature.
    """

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def tree_leaves(model) -> list[Leaf]:
    """Leaves of a fitted boosted-tree model, values in log-odds.

    The trees are read from the model's saved form. Their number is a model
    size (trees times leaves), not a data size.
    """
    spark = SparkSession.getActiveSession()
    path = shared_dir(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    weights = model.treeWeights
    trees: dict[int, dict[int, object]] = {}
    for n in nodes:
        trees.setdefault(n.treeID, {})[n.id] = n
    leaves = []
    for tree_id, tree in trees.items():
        # The model's raw score m gives p = 1 / (1 + exp(-2m)).
        scale = 2.0 * weights[tree_id]
        open_paths = [(0, {})]
        while open_paths:
            node_id, box = open_paths.pop()
            node = tree[node_id]
            if node.leftChild < 0:
                used = sorted(box)
                parts = [np.array([box[f][i] for f in used], dtype=float) for i in range(3)]
                leaves.append(Leaf(scale * node.prediction, np.array(used, dtype=int), *parts))
                continue
            if node.split.numCategories >= 0:
                raise ValueError("categorical splits are not supported; pass codes as plain numbers")
            feature, cut = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
            weight = node.impurityStats[0]
            for child_id, is_left in ((node.leftChild, True), (node.rightChild, False)):
                low, high, share = box.get(feature, (-np.inf, np.inf, 1.0))
                low, high = (low, min(high, cut)) if is_left else (max(low, cut), high)
                kept = tree[child_id].impurityStats[0] / weight
                open_paths.append((child_id, {**box, feature: (low, high, share * kept)}))
    return leaves


def expected_margin(leaves: Sequence[Leaf]) -> float:
    """Model output with every feature unknown: the bias of the attribution."""
    return float(sum(leaf.value * leaf.share.prod() for leaf in leaves))


def attribute(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """Shapley values of the trees for a block of rows.

    With a feature known, a leaf's factor is 1 inside its interval and 0
    outside; unknown, it is the training share. The Shapley value is the
    integral over u in [0, 1] of the gain of one feature while each other one
    is known with probability u. The integrand is a polynomial in u, so
    Gauss-Legendre quadrature is exact with half as many nodes as features.
    """
    out = np.zeros(x.shape)
    for leaf in leaves:
        if not len(leaf.features):
            continue
        z = x[:, leaf.features]
        inside = ((z > leaf.low) & (z <= leaf.high)).astype(float)
        nodes, weights = np.polynomial.legendre.leggauss((len(leaf.features) + 1) // 2)
        others = np.zeros_like(inside)
        for u, w in zip((nodes + 1) / 2, weights / 2):
            factor = (1 - u) * leaf.share + u * inside
            others += w * factor.prod(axis=1, keepdims=True) / factor
        out[:, leaf.features] += leaf.value * (inside - leaf.share) * others
    return out


def contrib_batch(df: DataFrame, model, features: Sequence[str], keep: Sequence[str] = ("id",), vector: str = "features") -> DataFrame:
    """Exact additive contributions of every row in log-odds, plus the bias.

    The fitted leaves are broadcast; each task attributes Arrow batches of its
    own rows. Contributions plus bias equal the model's log-odds.
    """
    leaves = tree_leaves(model)
    shared = df.sparkSession.sparkContext.broadcast(leaves)
    bias = expected_margin(leaves)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block = batch.drop(columns="__x")
            values = attribute(shared.value, np.stack(batch["__x"])) if len(batch) else []
            yield block.assign(__c=list(values))

    rows = df.select(*keep, vector_to_array(vector).alias("__x"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    out = rows.mapInPandas(explain, f"{fields}, __c array<double>")
    return out.select(*keep, named_values(features, F.col("__c")).alias("contribs"), F.lit(bias).alias("bias"))
