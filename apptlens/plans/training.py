"""The training job: raw history to a calibrated, evaluated risk model."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptlens.operators import encode, evaluate, models, splits
from apptlens.operators.prefix import ROWS_PER_RANGE
from apptlens.plans.features import add_running_rates, clean_values, complete_history
from apptlens.schemas import CATEGORY_FEATURES, FEATURES
from apptlens.session import WIDE, materialize

# Fixed value: rows a tuning trial may use.
TUNING_ROWS = 100_000
PARTS = ["train", "calibration", "test"]
# Packed rows take less than half the bytes of the texts; as many of them make a file as before packing.
TRAIN_RUN = {**WIDE, "spark.sql.adaptive.coalescePartitions.minPartitionSize": "450k"}
# Model inputs that the job computes.
_COMPUTED = ("IS_WEEKEND", "APPT_COUNT_BY_PATIENT", "PATIENT_NOSHOW_RATE", "PHYSICIAN_NOSHOW_RATE")


@dataclass(frozen=True)
class Trained:
    """What a training job leaves behind."""

    model: models.RiskModel
    encoders: DataFrame
    table: DataFrame  # id, y, part, weight and the model inputs
    test_scores: DataFrame  # id, y, p_raw, p, risk_level

    def metrics(self) -> DataFrame:
        """Headline quality on the test part: (name, value)."""
        one = evaluate.brier_scores(self.test_scores)
        one = one.withColumn("roc_auc", evaluate.roc_auc(self.test_scores).scalar())
        one = one.withColumn("roc_auc_raw", evaluate.roc_auc(self.test_scores, p="p_raw").scalar())
        one = one.withColumn("average_precision", evaluate.average_precision(self.test_scores).scalar())
        pairs = [F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in one.columns]
        return one.select(F.explode(F.array(*pairs)).alias("m")).select("m.name", "m.value")


def three_way_by_patient(rows: DataFrame, patient: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``part`` (train / calibration / test) so that no patient is in two parts.

    A part of the patients is all up to a place in a fixed order, so two places
    say the part of every row, and no row is shuffled.
    """
    outer = materialize(splits.split_by_group(rows, patient, test=0.20, rows_per_range=rows_per_range), "sides")
    rest = outer.filter("side = 'train'").select(patient)
    order = splits.hash_order(patient, seed=7)
    inner = splits.split_by_group(rest, patient, order, 0.20, rows_per_range)
    test = _up_to_last(outer.filter("side = 'test'"), patient, splits.hash_order(patient))
    calibration = _up_to_last(inner.filter("side = 'test'"), patient, order)
    return rows.withColumn("part", F.when(test, "test").when(calibration, "calibration").otherwise("train"))


def _up_to_last(groups: DataFrame, key: str, order: Column) -> Column:
    """Whether a row's key is at or before the last of some groups in an order."""
    last = groups.agg(F.max(F.struct(order.alias("place"), F.col(key).alias("key"))).alias("last")).first()["last"]
    if last is None:
        return F.lit(False)
    return F.col(key).isNotNull() & ((order < last["place"]) | ((order == last["place"]) & (F.col(key) <= F.lit(last["key"]))))


def training_table(raw: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, DataFrame]:
    """Encoded model inputs with label, part and class weight; and the encoders.

    Base rate, encoders and class weight come from the training part only.
    Intermediate tables are written to the shared folder: each feeds several
    later jobs, and none has to be recomputed when an executor is lost. Rows
    are encoded before they are sorted for the running rates, so that codes
    are shuffled, not texts.
    """
    inputs = [c for c in raw.columns if c in FEATURES and c not in _COMPUTED]
    complete = materialize(complete_history(raw).select("APPT", "UNIQUE_ID", "EVENT_TIME", "APPT_STATUS", *inputs), "complete", WIDE)
    split = three_way_by_patient(clean_values(complete), "UNIQUE_ID", rows_per_range)
    train = split.filter("part = 'train'")
    base_rate = train.agg(F.avg("TARGET_ENCODED")).first()[0]
    encoders = materialize(encode.label_encode_fit(train, CATEGORY_FEATURES, rows_per_range), "encoders")
    texts = split.withColumns({"__provider": F.col("ATTENDING_PHYSICIAN"), "part": F.array_position(F.lit(PARTS), F.col("part")).cast("int")})
    encoded = encode.label_encode_apply(texts.drop("APPT_STATUS"), encoders, CATEGORY_FEATURES)
    packed, codes = encode.pack_codes(encoded, encoders, CATEGORY_FEATURES)
    rated = add_running_rates(packed, base_rate, rows_per_range, split.count(), "__provider").withColumns(codes)
    rows = rated.withColumns({"id": F.col("APPT"), "y": F.col("TARGET_ENCODED"), "part": F.get(F.lit(PARTS), F.col("part") - 1)})
    rows = rows.select("id", "y", "part", *FEATURES)
    counts = train.groupBy("TARGET_ENCODED").count().collect()
    by_class = {r["TARGET_ENCODED"]: r["count"] for r in counts}
    ratio = round(by_class.get(0, 0) / max(by_class.get(1, 0), 1), 4)
    weight = F.when(F.col("y") == 1, F.lit(float(ratio))).otherwise(1.0)
    return materialize(rows.withColumn("weight", weight), "training", TRAIN_RUN), encoders


def tune(table: DataFrame, trials: int, seed: int = 42, space: Mapping = models.SEARCH_SPACE) -> tuple[dict, DataFrame]:
    """Search settings on a stratified sample of the training part, 3 folds."""
    train = table.filter("part = 'train'")
    sample = splits.stratified_sample(train, "y", "id", TUNING_ROWS)
    folded = splits.kfold_stratified(sample, "y", "id", 3)
    folded = materialize(models.assemble(folded, FEATURES).select("y", "weight", "fold", "features"), "folds")
    # The sample is small: a core to each fit keeps them all busy.
    at_once = max(2, folded.sparkSession.sparkContext.defaultParallelism)
    return models.tune_params(folded, models.draw_params(trials, seed, space), weight="weight", parallelism=at_once)


def fit(table: DataFrame, encoders: DataFrame, params: Mapping) -> Trained:
    """Fit on train, calibrate on calibration, score test."""
    rows = models.assemble(table, FEATURES)
    base = models.train_gbt(rows.filter("part = 'train'").select("y", "weight", "features"), weight="weight", **params)
    held_out = models.positive_probability(rows.filter("part = 'calibration'"), base)
    model = models.RiskModel(base, models.platt_calibrate(held_out), tuple(FEATURES))
    scores = model.score(table.filter("part = 'test'")).select("id", "y", "p_raw", "p", "risk_level")
    return Trained(model, encoders, table, scores)


def train_risk_model(raw: DataFrame, params: Mapping | None = None, trials: int = 0) -> Trained:
    """The whole job. With ``trials`` the settings are searched, else given."""
    table, encoders = training_table(raw)
    chosen = dict(params or models.BOOSTED)
    if trials:
        chosen, _ = tune(table, trials)
    return fit(table, encoders, chosen)
