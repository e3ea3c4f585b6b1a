"""Column helpers for numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(col: Column, digits: int) -> Column:
    """Round half up; sums that differ in the last bits give the same result."""
    return F.round(F.round(col.cast("double"), 10), digits)


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """``num / den`` with ``empty`` where there is nothing to divide by."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(empty))


def average_over(total: Column, count: Column) -> Column:
    return F.when(count > 0, total / count)
