"""The registered queries and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusgauge.plans.views import table, view, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to tables and views: ``t.v_docs``, ``t.labels``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        read = view if name.startswith("v_") else table
        return read(self.spark, self.sf_dir, name)


def register(key: str, views: tuple[str, ...] = (), oracle: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``key``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise KeyError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = with_views(oracle, *views) if views else oracle.strip()
        return fn

    return wrap


def half_up_sql(expr: str, digits: int) -> str:
    """DuckDB text that rounds half up after snapping to ten digits."""
    return f"cast(round(cast({expr} AS decimal(28,10)), {digits}) AS double)"
