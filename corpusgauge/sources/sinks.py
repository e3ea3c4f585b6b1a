r"""Writing tables: CSV, nested averages, citation lists, JSON lines.

Spark's committer publishes a folder only when every task is done, which is
the atomic replace a single file would need a temporary copy for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).csv(path, header=True, escape='"')


def nested_averages(averages: DataFrame) -> DataFrame:
    """``{system: {model: {metric: value}}}`` as JSON, one row per category.

    Averages are already one row per system, model and metric, so a row is
    the size of the file it stands for.
    """
    models = averages.groupBy("category", "system", "model").agg(
        F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("cells")
    )
    systems = models.groupBy("category", "system").agg(
        F.array_sort(F.collect_list(F.struct("model", "cells"))).alias("models")
    )
    whole = systems.groupBy("category").agg(
        F.array_sort(F.collect_list(F.struct("system", "models"))).alias("systems")
    )
    per_model = lambda m: F.struct(m["model"], F.map_from_entries(m["cells"]))
    per_system = lambda s: F.struct(
        s["system"], F.map_from_entries(F.transform(s["models"], per_model))
    )
    nested = F.map_from_entries(F.transform("systems", per_system))
    return whole.select("category", F.to_json(nested).alias("value"))


def write_text(rows: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """One line per row from ``value``; partition columns become folders."""
    rows.select(*partition_by, "value").write.mode(mode).partitionBy(*partition_by).text(path)
