"""Answers that outlive the run that asked for them.

A ledger is a folder of answers keyed by model and digest of the prompt.  Every task adds its answers when it
ends, not when the job does, so a run that dies leaves all finished tasks' answers behind, and the next
one asks only for the rest.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions.joins import left_join_hot_keys_apart
from corpusgauge.operators.judging import judge_apply
from corpusgauge.session import written_once

LEDGER = "digest string, raw string, model string"
#: Prompts asked by one task, whose answers are lost if it dies.
PROMPTS_PER_TASK = 200
#: Most tasks of a run; beyond, each asks more prompts, and one that dies loses a thousandth of the run.
MOST_TASKS = 1_000
#: Most prompts in a file; a task of a long run asks those of one file or more, and loses them if it dies.
PROMPTS_PER_FILE = 5_000


def _append(rows: DataFrame, path: str) -> None:
    """Adds rows task by task: a task's file is in place as soon as the task is committed."""
    writer = rows.write.mode("append").partitionBy("model")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def ledger_answers(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(digest, raw) of a model, one row per prompt; a ledger that does not exist yet has none."""
    _append(spark.createDataFrame([], LEDGER), path)  # makes the folder
    rows = spark.read.schema(LEDGER).parquet(path).where(F.col("model") == model)
    return rows.groupBy("digest").agg(F.min("raw").alias("raw"))


def with_digest(requests: DataFrame) -> DataFrame:
    """``requests`` with ``digest`` of the prompt; a null prompt has none."""
    return requests.withColumn("digest", F.sha2(F.encode("prompt", "UTF-8"), 256))


def judge_once(
    requests: DataFrame,
    scorer: Callable[[str], str],
    path: str,
    model: str = "default",
    prompts_per_task: int = PROMPTS_PER_TASK,
    **calls,
) -> DataFrame:
    """``requests`` with ``raw`` in place of ``prompt``, as :func:`judge_apply` gives it, through the ledger in ``path``.

    Only prompts without an answer of ``model`` are asked, equal ones once; ``calls`` go to
    :func:`judge_apply`.  Prompts without an answer stay out of the ledger and are asked again by the next run, null
    prompts are never asked.  Two runs at a time may both ask a prompt; the smaller answer then counts for all.
    A run has at most ``MOST_TASKS`` tasks; below, each asks ``prompts_per_task`` prompts.  Where that is not enough for
    all prompts, they are not exchanged but asked from the files they were written to, ``PROMPTS_PER_FILE`` in each.
    ``requests`` must not have a column ``digest``, ``raw``, ``_file`` or ``_row``.
    """
    spark = requests.sparkSession
    # prompts about one text stand together, and this codec writes a text that comes again within a page as a reference
    asked = written_once(with_digest(requests), compression="zstd", maxRecordsPerFile=PROMPTS_PER_FILE)
    known = ledger_answers(spark, path, model).select("digest")
    # equal prompts are asked once; only digests and places are exchanged to find which
    placed = asked.where("digest IS NOT NULL").selectExpr("digest", *PLACE)
    firsts = placed.groupBy("digest").agg(F.min(F.struct("_file", "_row")).alias("first"))
    firsts = written_once(firsts.join(known, "digest", "left_anti").select("first.*"))
    left = firsts.count()
    if left:
        tasks = _tasks(left, prompts_per_task)
        todo = _at(asked.selectExpr("digest", "prompt", *PLACE), firsts).select("digest", "prompt")
        dealt = todo.repartition(tasks, F.xxhash64("digest")) if left <= MOST_TASKS * prompts_per_task else todo.coalesce(tasks)
        with _a_task_each(spark, len(asked.inputFiles())):
            answers = judge_apply(dealt, scorer, **calls).where("raw IS NOT NULL")
            _append(answers.withColumn("model", F.lit(model)), path)
    # equal prompts may be a third of all
    rest = asked.drop("prompt")
    found = left_join_hot_keys_apart(rest, ledger_answers(spark, path, model), "digest")
    return found.select(*[c for c in rest.columns if c != "digest"], "raw")


#: Where a row of a written table stands.
PLACE = ("_metadata.file_name AS _file", "_metadata.row_index AS _row")


def _at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The ``rows`` at ``places`` (_file, _row), where they stand: a bit for every row of a file goes to all tasks."""
    bits = F.bit_or(F.expr("shiftleft(1L, cast(_row % 64 AS int))"))
    words = places.groupBy("_file", F.floor(F.col("_row") / 64).cast("int").alias("word")).agg(bits.alias("bits"))
    listed = words.groupBy("_file").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"), F.max("word").alias("last"))
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    marked = rows.join(F.broadcast(listed.select("_file", dense.alias("_bits"))), "_file")
    word = F.get("_bits", F.floor(F.col("_row") / 64).cast("int"))
    return marked.where(F.getbit(word, (F.col("_row") % 64).cast("int")) == 1)


@contextlib.contextmanager
def _a_task_each(spark: SparkSession, files: int):
    """So many files of about one size are read by a task each meanwhile, unless the session has a number of its own."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(files))
    try:
        yield
    finally:
        spark.conf.unset(name)


def _tasks(prompts: int, prompts_per_task: int) -> int:
    """Tasks for so many prompts: blocks of an exchange grow with its readers, so their number has a bound."""
    return min(-(-prompts // prompts_per_task), MOST_TASKS)
