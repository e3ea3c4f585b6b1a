"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "corpusgauge", **extra: str) -> SparkSession:
    """A session with adaptive execution on; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master with the setting unset (tests, a laptop) gets a folder
    of its own; on a cluster an unset folder is an error, because a
    machine-local path would not outlive its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    own = os.path.join(tempfile.gettempdir(), f"corpusgauge-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, never one used before."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, **options) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read many times.

    The files outlive the executors that wrote them, and their sizes and
    columns are known to the plans that read them; ``options`` go to the writer.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


#: Bytes of a batch to Python; Spark's own bound holds a task's whole share of the texts.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def in_small_batches(work):
    """``work`` on a table, during which what it runs hands rows to Python in batches of ``BATCH_BYTES`` at most.

    An executor holds a batch twice or more, in its own memory and in the worker's, for each of its tasks.  A bound that the
    session has set is kept, and none is left behind.
    """

    @functools.wraps(work)
    def wrapped(df: DataFrame, *args, **options):
        conf = df.sparkSession.conf
        if conf.get(BATCH_SETTING, None) is not None:
            return work(df, *args, **options)
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
        try:
            return work(df, *args, **options)
        finally:
            conf.unset(BATCH_SETTING)

    return wrapped


def widened(df: DataFrame) -> DataFrame:
    """``df`` on as many tasks as there are cores when its files give fewer.

    Parsers work within a row and keep the partitioning of their input, so a
    corpus in a single small file would run on a single core.  A corpus with
    at least as many splits as cores is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
