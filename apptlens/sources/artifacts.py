"""Saving and loading everything a scoring job needs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession

from apptlens.operators.models import RiskModel, Sigmoid

_PARTS = "position int, feature string"


def save_artifacts(
    spark: SparkSession,
    path: str,
    model: RiskModel,
    encoders: DataFrame,
    tables: Mapping[str, DataFrame] | None = None,
) -> None:
    """Write model, calibration, encoders, feature order and extra tables
    (metrics, background sample) under one folder."""
    model.base.write().overwrite().save(f"{path}/base_model")
    sigmoid = spark.createDataFrame([(model.sigmoid.a, model.sigmoid.b)], "a double, b double")
    features = spark.createDataFrame(list(enumerate(model.features)), _PARTS)
    everything = {"sigmoid": sigmoid, "feature_columns": features, "encoders": encoders, **(tables or {})}
    for name, table in everything.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_artifacts(spark: SparkSession, path: str) -> tuple[RiskModel, DataFrame]:
    """Model and encoders as saved."""
    base = GBTClassificationModel.load(f"{path}/base_model")
    a, b = spark.read.parquet(f"{path}/sigmoid").select("a", "b").first()
    features = spark.read.parquet(f"{path}/feature_columns").orderBy("position").collect()
    return RiskModel(base, Sigmoid(a, b), tuple(r.feature for r in features)), spark.read.parquet(f"{path}/encoders")


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the extra tables."""
    return spark.read.parquet(f"{path}/{name}")
