"""Plans: what must and must not appear in them."""

from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from apptlens.operators import filters, kpi, providers
from apptlens.schemas import APPOINTMENTS_SCHEMA
from apptlens.session import shared_dir
from apptlens.sources import star


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    path = shared_dir(spark, "plain")
    star.appointments(spark, sf_dir).select(*APPOINTMENTS_SCHEMA.fieldNames()).write.parquet(path)
    return spark.read.schema(APPOINTMENTS_SCHEMA).parquet(path)


def test_filters_reach_the_scan(table):
    chosen = filters.filter_date_range(filters.filter_tier_in(table), date(1999, 1, 1), date(1999, 2, 1)).select("id")
    plan = _plan(chosen)
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(appointment_da" in pushed and "In(risk_level" in pushed
    schema = plan[plan.index("ReadSchema") :]
    assert "patient_id" not in schema


def test_kpis_are_one_scan_of_three_columns(table):
    plan = _plan(kpi.kpi_overview(table))
    assert plan.count("FileScan") == 1 and "patient_id" not in plan


def test_unused_dimensions_are_not_read(spark, sf_dir):
    plan = _plan(providers.provider_stats(star.appointments(spark, sf_dir, "id", "attending_physician", "predicted_risk_prob", "risk_level")))
    assert "Join" not in plan and plan.count("FileScan") == 1


# The writers run jobs when they are built; their plans are plain scans.
_EAGER = {"persist_model_artifacts", "append_booking_batches", "resolve_overdue_months", "enrich_history_state", "scan_raw_parts", "append_scored_bookings", "ddl_appointments", "export_worklist_csv", "export_threshold_csv"}
_MODELS = {"train_gbt", "train_random_forest", "train_model_set", "tune_params", "platt_calibrate", "score_batch", "feature_importance", "topk_importance", "contrib_batch", "build_features"}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - _EAGER - _MODELS))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    plan = _plan(entry.queries()[name](spark, sf_dir))
    for unwanted in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan
