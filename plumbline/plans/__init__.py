"""Registered queries, each with the inventory lines it covers and, where SQL can say it, the
equivalent SQL."""

from __future__ import annotations

from dataclasses import dataclass
from importlib import import_module
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.inputs import with_inputs

MODULES = ["profiles", "quality", "duplicates", "rules", "cleaning", "comparison", "selection", "storage"]


@dataclass
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def add(run):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(name, covers, run, with_inputs(sql) if sql else None)
        return run

    return add


def load() -> dict[str, Query]:
    for m in MODULES:
        import_module(f"plumbline.plans.{m}")
    return REGISTRY
