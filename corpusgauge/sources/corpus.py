r"""Reading corpora, result files, task maps and JSON lists.

Each source has two parts: a reader over files, and the parser over
``(path, raw)`` rows that does the work, so rows from any store can be used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions.json import list_items
from corpusgauge.functions.joins import broadcast_if_small, spread_join
from corpusgauge.functions.text import strip
from corpusgauge.schema import BASELINE, DOC_KEYS

MD_GLOB = "*.[mM][dD]"
RESULTS_GLOB = "results_*.json"

_TREE = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)\z"


def _unquoted(path: Column) -> Column:
    """A file address without the escapes Spark's file source puts in."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _file_path() -> Column:
    return _unquoted(F.col("_metadata.file_path")).alias("path")


def _read_whole(spark: SparkSession, root: str, glob: str) -> DataFrame:
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(_file_path(), F.col("value").alias("raw"))


def with_tree_keys(files: DataFrame) -> DataFrame:
    """Add category, topic, system and file name from ``.../cat/topic/system/file``."""
    return files.withColumns(
        {
            name: F.regexp_extract("path", _TREE, n)
            for n, name in enumerate([*DOC_KEYS, "file"], 1)
        }
    ).filter(F.col("file") != "")


def documents_from_files(files: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """One markdown document per (category, topic, system): the first by name.

    Only the names decide which files lose, so the texts are not exchanged:
    the losers, few as a rule, are counted and broadcast, and only a long list
    of them makes this a shuffled anti-join.
    """
    is_md = F.lower("file").endswith(".md")
    names = with_tree_keys(files.select("path") if paths is None else paths).filter(is_md)
    chosen = names.groupBy(*DOC_KEYS).agg(F.min("file").alias("chosen"), F.count("*").alias("n"))
    losers = (
        names.join(chosen.filter(F.col("n") > 1), list(DOC_KEYS))
        .filter(F.col("file") != F.col("chosen")).select("path")
    )
    keyed = with_tree_keys(files).filter(is_md).join(broadcast_if_small(losers), "path", "left_anti")
    return keyed.select(*DOC_KEYS, "path", F.regexp_replace("raw", r"\r\n?", "\n").alias("md"))


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """The markdown corpus under ``root``; names are listed without reading the texts."""
    listing = spark.read.format("binaryFile").options(
        recursiveFileLookup="true", pathGlobFilter=MD_GLOB
    ).load(root)
    return documents_from_files(_read_whole(spark, root, MD_GLOB), listing.select(_file_path()))


def results_from_files(files: DataFrame) -> DataFrame:
    """Long scores from result files; the model is in the file name.

    Values that are not numbers are left out, as are files that do not parse.
    """
    keyed = with_tree_keys(files).withColumn(
        "model", F.regexp_extract("file", r"\Aresults_(.*)\.json\z", 1)
    )
    values = F.from_json("raw", "map<string,string>")
    cells = keyed.select(*DOC_KEYS, "model", F.explode(values).alias("metric", "text"))
    return cells.select(
        *DOC_KEYS, "model", "metric", F.col("text").try_cast("double").alias("value")
    ).filter(F.col("value").isNotNull())


def scan_results(spark: SparkSession, root: str) -> DataFrame:
    return results_from_files(_read_whole(spark, root, RESULTS_GLOB))


def scan_tasks(maps: DataFrame, systems: Sequence[str] | None = None, raw: str = "raw") -> DataFrame:
    """``{system: [{topic: path}]}`` as rows; systems not asked for are skipped."""
    keep = [c for c in maps.columns if c != raw]
    parsed = F.from_json(raw, "map<string,array<map<string,string>>>")
    rows = maps.select(*keep, F.explode(parsed).alias("system", "topics"))
    if systems is not None:
        rows = rows.filter(F.col("system").isin(list(systems)))
    return rows.select(*keep, "system", F.explode("topics").alias("entry")).select(
        *keep, "system", F.explode("entry").alias("topic", "path")
    )


def build_tasks(topics: DataFrame, systems: Sequence[str]) -> DataFrame:
    """A task for every topic and system; ``topics`` has category and topic."""
    named = F.array(*[F.lit(s) for s in systems])
    return topics.select("category", "topic").distinct().withColumn("system", F.explode(named)).withColumn(
        "path", F.concat_ws("/", "category", "topic", "system")
    )


def task_maps(tasks: DataFrame) -> DataFrame:
    """Tasks as text, one JSON line ``{topic: path}`` per task.

    ``system`` stays a column, so the sink can put each system in a folder of
    its own and no system's list has to fit one row.
    """
    entry = F.to_json(F.create_map("topic", "path"))
    return tasks.select("system", "category", "topic", entry.alias("value"))


def scan_outline_json(docs: DataFrame, keys: Sequence[str] = DOC_KEYS, raw: str = "raw") -> DataFrame:
    """A JSON list of ``[level, title]`` pairs as outline rows."""
    pairs = F.from_json(raw, "array<array<string>>")
    return docs.select(*keys, F.posexplode(pairs).alias("pos", "pair")).select(
        *keys, "pos",
        F.get("pair", F.lit(0)).try_cast("int").alias("level"),
        F.get("pair", F.lit(1)).alias("title"),
    )


def scan_refs_json(docs: DataFrame, keys: Sequence[str] = DOC_KEYS, raw: str = "raw") -> DataFrame:
    """A JSON list of references as trimmed, non-empty rows; bad text, no rows."""
    items = F.filter(F.transform(list_items(F.col(raw)), strip), lambda r: r != "")
    return docs.select(*keys, F.posexplode(items).alias("ref_pos", "entry"))


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and a schema given, never inferred."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=False, escape='"')


def corpus_counts(docs: DataFrame) -> DataFrame:
    """Documents per system."""
    return docs.groupBy("system").agg(F.count("*").alias("docs"))


def corpus_gaps(tasks: DataFrame, docs: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Per task: is there a document, and a baseline document on the topic?

    One aggregation by topic and system finds the documents; the topics that
    have a baseline are then looked up.
    """
    key = ["category", "topic", "system"]
    both = tasks.select(*key, F.lit(True).alias("wanted"), F.lit(False).alias("found")).unionByName(
        docs.select(*key, F.lit(False).alias("wanted"), F.lit(True).alias("found"))
    )
    known = both.groupBy(*key).agg(F.max("wanted").alias("wanted"), F.max("found").alias("has_document"))
    truth = known.filter((F.col("system") == baseline) & F.col("has_document")).select(
        "category", "topic", F.lit(True).alias("has_baseline")
    )
    return spread_join(known.filter("wanted"), truth, ["category", "topic"]).select(
        *key, "has_document", F.coalesce("has_baseline", F.lit(False)).alias("has_baseline")
    )


def gap_totals(gaps: DataFrame) -> DataFrame:
    """Tasks per system: with a document, without, without a baseline."""
    return gaps.groupBy("system").agg(
        F.count("*").alias("tasks"),
        F.count_if("has_document").alias("present"),
        F.count_if(~F.col("has_document")).alias("missing"),
        F.count_if(~F.col("has_baseline")).alias("no_baseline"),
    )
