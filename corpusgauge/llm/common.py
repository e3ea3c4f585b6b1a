"""What the operators of this package share: reading, words, prefix sums over ranges of ids."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java class of the characters that stand between words.
GAPS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text; a null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS, -1), "")


def key_of(col: Column) -> Column:
    """A string key that joins nulls with nulls and with nothing else."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def range_bounds(df: DataFrame, col: str, rows_per_range: int, most: int = 4096) -> list:
    """Ascending upper bounds that cut ``col`` into ranges of about equal numbers of rows.

    One aggregation over the column; at most ``most`` numbers come to the driver.
    More rows only make the ranges longer; every row falls into one of them, and none is empty.
    """
    seen = df.agg(F.count(F.col(col)).alias("n"), F.max(F.col(col)).alias("last")).first()
    ranges = min(most, -(-seen["n"] // rows_per_range))
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(F.col(col), shares, 10 * ranges).alias("b")).first()["b"]
    return sorted(b for b in set(found) if b < seen["last"])


def range_no(col: Column, bounds: list) -> Column:
    """Number of bounds below ``col``: 0 for nulls and for values up to the first bound."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < col)), F.lit(0))


def gives_back(work):
    """``work`` (batches to batches, or a table to a table), after which its Python worker hands unused memory back.

    Workers live on between tasks and stages, and would keep what the largest of them took.
    """

    def release() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    @functools.wraps(work)
    def wrapped(given):
        found = work(given)
        if isinstance(found, pa.Table):
            release()
            return found
        return streamed(found)

    def streamed(batches):
        yield from batches
        release()

    return wrapped
