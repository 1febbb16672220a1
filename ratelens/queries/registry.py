"""Collects queries and their oracle SQL from the modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratelens.bindings import bind, binding_sql

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("scalars", "ingest", "frames", "ranking", "selecting", "planning", "reporting")


class Inputs:
    """Bound views for one run: ``t.trials`` is the DataFrame of that binding."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return bind(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, uses: str = "") -> Callable[[Callable[[Inputs], DataFrame]], Query]:
    """Register ``fn(inputs)``; ``uses`` names the bindings the oracle reads as CTEs."""

    def register(fn: Callable[[Inputs], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        _QUERIES[name] = run
        if sql is not None:
            ctes = [f"{view} AS ({binding_sql(view)})" for view in uses.split()]
            body = sql.strip()
            if ctes and body.upper().startswith("WITH RECURSIVE "):
                body = "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[15:]
            elif ctes and body.upper().startswith("WITH "):
                body = "WITH " + ", ".join(ctes) + ", " + body[5:]
            elif ctes:
                body = "WITH " + ", ".join(ctes) + " " + body
            _ORACLES[name] = body
        return run

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"ratelens.queries.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
