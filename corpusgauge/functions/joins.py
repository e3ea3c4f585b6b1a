"""Joins of a large table to a small-per-key one when keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = 16


def spread_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    how: str = "left",
    splits: int = SPLITS,
    spread_by: list[str] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Equi-join where one key may hold a third of ``rows``.

    ``per_key`` holds at most one row per key and is repeated ``splits``
    times; each row of ``rows`` picks one repeat by a hash of its own values (of
    ``spread_by``, when the others are long), so the rows of a hot key go to ``splits`` tasks.  When ``per_key`` turns
    out small, adaptive execution still replaces the join by a broadcast, on
    its measured size.

    That size leaves the repeats out, so the driver gets up to ``splits`` times what the session lets it broadcast.
    With ``bounded`` the repeats are never broadcast: a ``per_key`` that the session lets be broadcast is, once and
    without repeats, and any other is exchanged.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"cannot spread a {how} join")
    if bounded and _may_be_broadcast(per_key):
        return rows.join(F.broadcast(per_key), keys, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by or rows.columns]), F.lit(splits)).cast("int")
    salted = rows.withColumn("_split", salt)
    repeats = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    copies = per_key.withColumn("_split", repeats)
    if bounded:
        copies = copies.hint("shuffle_merge")
    return salted.join(copies, [*keys, "_split"], how).drop("_split")


def _may_be_broadcast(df: DataFrame) -> bool:
    """Whether the session's threshold lets a table of the size that the plan of ``df`` states be broadcast."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


#: Rows of one key that a single task may still join.
HOT_ROWS = 10_000


def left_join_hot_keys_apart(rows: DataFrame, per_key: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join where both sides are long and a few keys may hold a third of ``rows``.

    ``per_key`` holds at most one row per key.  Keys with more than ``hot_rows`` rows, as a count of the keys alone finds
    them, are at most one row in ``hot_rows``: they are joined by broadcast, all others by one exchange without copies.
    Null keys meet nothing and are not exchanged.
    """
    keyed = rows.where(F.col(key).isNotNull())
    counted = keyed.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows)
    hot = [r[0] for r in counted.select(key).collect()]
    added = [f for f in per_key.schema.fields if f.name != key]
    none = rows.where(F.col(key).isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    if not hot:
        return keyed.join(per_key, key, "left").unionByName(none)
    listed = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], rows.select(key).schema))
    cold = keyed.join(listed, key, "left_anti").join(per_key, key, "left")
    warm = keyed.join(listed, key, "left_semi").join(F.broadcast(per_key.join(listed, key, "left_semi")), key, "left")
    return cold.unionByName(warm).unionByName(none)


BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when a count finds at most ``rows`` short rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
