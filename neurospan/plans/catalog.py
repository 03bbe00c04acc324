"""Registry of queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("trial_queries", "behaviour_queries", "signal_queries", "model_queries", "spectral_queries", "more_queries", "record_queries", "set_queries", "lineage_queries", "state_queries", "analysis_queries", "round_trip_queries", "spectra_queries")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found.update(import_module(f"neurospan.plans.{name}").QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(import_module(f"neurospan.plans.{name}").ORACLE)
    return found
