"""The first rows of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# up to this many rows per group Spark itself ranks before the exchange
DIRECT = 1000


def top_per_group(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, splits: int = 64, direct: int = DIRECT
) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``.

    Small ``n``: each task keeps its own first ``n`` before the exchange.
    Beyond that, parts of a group are ranked apart first, so a group with a
    large share of the rows is sorted by many tasks and the last one sees at
    most ``n`` rows of each part.
    """
    group = list(group)
    if n > direct:
        part = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(splits))
        place = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
        rows = rows.withColumn("_part", part).withColumn("_place", place).filter(F.col("_place") <= n)
        rows = rows.drop("_part", "_place")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)
