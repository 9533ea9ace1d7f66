"""Registered queries, one module per operator family. Importing registers."""

from apptlens.plans.catalog import (  # noqa: F401
    aggregates,
    evaluation,
    filters_joins,
    modeling,
    projections,
    storage,
    windows,
)
