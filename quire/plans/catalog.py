"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that offer QUERIES: name -> (function of (spark, sf_dir), SQL or None).
MODULES = ("quire.plans.geometry", "quire.plans.joins", "quire.plans.text", "quire.plans.stats", "quire.plans.assembly", "quire.plans.documents", "quire.plans.reading", "quire.plans.linking", "quire.plans.ruling", "quire.plans.detection", "quire.plans.textlines", "quire.plans.grids", "quire.plans.streams")


def _all() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(name).QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
