"""The registered queries of the geospatial operators and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["q_spatial", "q_aggregates", "q_catalogue", "q_rasters", "q_sources"]


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"tesserax.plans.{name}").query, what)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("queries")


def oracle_sql() -> dict[str, str]:
    return _all("sql")
