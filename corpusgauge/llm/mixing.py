"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets the key ``-ln(u) / quality`` with ``u`` a hash of its id (Efraimidis
and Spirakis): taking documents by ascending key draws them without replacement with chances in
proportion to their quality.  A source whose target is several times its size is taken
whole as often as it fits; what is left is filled by the documents of smallest key.

All of it is DataFrame code.  A source may hold most rows: its documents are dealt into key
ranges, whose totals are summed up first, so no window ever holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.functions.joins import broadcast_if_small, spread_join
from corpusgauge.llm.common import key_of, table, words_of
from corpusgauge.session import written_once

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SYMBOLS = "[#*$%&|<>]"
#: Documents of a source in one key range; the number of ranges grows with the source.
ROWS_PER_RANGE = 4_000


def quality_weight(text: Column, size: Column) -> Column:
    """In (0, 1]: the share of words among words and symbols; 1 for an empty text."""
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS))
    return (size + 1).cast("double") / (size + symbols + 1).cast("double")


def sampling_key(doc_id: Column, quality: Column, seed: str = "mix") -> Column:
    """Exponential variate over the quality; the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double")
    return -F.log((draw + 0.5) / F.lit(float(2**52))) / quality


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets per row of ``sources`` (source, source_size): shares of the total by weight.

    Weights repeat over the sources in code point order, null last.  A target stops at
    ``most`` times the size and the excess goes to the others by weight until none is above; the
    fixed point is one level ``l`` with ``target = min(cap, l * weight)``, found by sorting the sources
    by the level at which they are full.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_no") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sources.withColumn("_no", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("_cap", F.col("source_size") * most)
    )
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy(F.col("_full"), F.col("_no")).rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("_full", F.col("_cap").cast("double") / F.col("weight"))
        .withColumn("_rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", F.col("_rest").cast("double") / F.col("_open"))
    )
    first = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_no", "_level"))).over(everything)
    return levels.withColumn("_l", first["_level"]).select(
        "source", "source_size", "weight",
        F.least(F.col("_cap").cast("double"), F.col("_l") * F.col("weight")).alias("target"),
    )


def measured(docs: DataFrame, quality: Column | None = None) -> DataFrame:
    """One short row per document: doc_id, source, size, key and the quality behind it."""
    sized = docs.select("doc_id", "source", "text", F.size(words_of(F.col("text"))).cast("long").alias("size"))
    weight = quality if quality is not None else quality_weight(F.col("text"), F.col("size"))
    return sized.select("doc_id", "source", "size", weight.alias("quality")).withColumn(
        "key", sampling_key(F.col("doc_id"), F.col("quality"))
    )


def mixture(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``rows`` (doc_id, source, size, key, quality) with source_size, target and taken.

    ``taken`` is the words the mix takes of the document: its size times the whole epochs
    of its source, once more when the document is drawn for the rest.  Drawn are, by ascending key, the
    documents up to the one that the rest reaches at least half.  Rows with the same id have the same
    key and follow one another.  An empty table gives an empty table; sources of size 0 get target 0.
    """
    rows = rows.withColumn("_k", key_of(F.col("source")))
    per_source = rows.groupBy("_k", "source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"), F.avg("quality").alias("_mean")
    )
    per_source = written_once(per_source)
    epochs = F.floor(F.col("target") / F.col("source_size"))
    plan = (
        source_targets(per_source.select("source", "source_size"), weights, most)
        .withColumn("_k", key_of(F.col("source")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, epochs).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .drop("source", "weight")
        .join(
            per_source.select("_k", F.ceil(F.col("_n") / F.lit(ROWS_PER_RANGE)).alias("_ranges"), "_mean"), "_k"
        )
    )
    share = 1 - F.exp(-F.col("key") * F.col("_mean"))
    dealt = spread_join(rows, plan, ["_k"], "inner", spread_by=["doc_id", "key"]).withColumn(
        "_range", F.least(F.col("_ranges") - 1, F.floor(share * F.col("_ranges")))
    )
    so_far = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        dealt.groupBy("_k", "_range").agg(F.sum("size").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)))
        .drop("_sum")
    )
    by_key = (
        Window.partitionBy("_k", "_range").orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = F.col("_before") + F.coalesce(F.sum("size").over(by_key), F.lit(0)) + F.col("size") / 2
    return (
        dealt.join(totals, ["_k", "_range"])
        .withColumn("drawn", reached <= F.col("rest"))
        .withColumn("copies", F.col("epochs") + F.col("drawn").cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop("_k", "_range", "_ranges", "_mean", "_before")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``docs`` with every document repeated as often as the mix takes it.

    Whether a document is drawn depends on its key and its source's last drawn key alone, so
    texts are never exchanged: the short table of sources comes to them.
    """
    mix = mixture(written_once(measured(docs)), weights, most)
    last = F.max(F.when(F.col("drawn") & (F.col("size") > 0), F.col("key")))
    cuts = (
        mix.groupBy(key_of(F.col("source")).alias("_k")).agg(F.max("epochs").alias("_epochs"), last.alias("_cut"))
    )
    quality = quality_weight(F.col("text"), F.size(words_of(F.col("text"))).cast("long"))
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), key_of(F.col("source")).alias("_k"),
        sampling_key(F.col("doc_id"), quality).alias("_key"),
    )
    copies = F.col("_epochs") + F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(False)).cast("long")
    return (
        rows.join(broadcast_if_small(written_once(cuts)), "_k")
        .withColumn("_copies", copies.cast("int"))
        .where("_copies > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("_row.*")
    )


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to the default weights."""
    rows = written_once(measured(table(spark, sf_dir, "documents")))
    return mixture(rows).select("doc_id", "size", "source_size", "target", "taken")


def mixing_sql(docs: str = "documents", text: str = "text") -> str:
    """DuckDB text of the same rule over a relation with doc_id, source and text."""
    return rf"""
    WITH sized AS (
      SELECT doc_id, source, cast(coalesce(len(regexp_extract_all({text}, '[^\x20\x09-\x0D]+')), 0) AS bigint) AS size,
        cast(coalesce(len(regexp_extract_all({text}, '[#*$%&|<>]')), 0) AS bigint) AS symbols FROM {docs}
    ), keyed AS (
      SELECT doc_id, source, size, -ln((cast(cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id AS varchar), '')), 1, 13) AS bigint) AS double) + 0.5)
        / 4503599627370496.0) / (cast(size + 1 AS double) / cast(size + symbols + 1 AS double)) AS key FROM sized
    ), sources AS (
      SELECT source, cast(sum(size) AS bigint) AS source_size FROM keyed GROUP BY source
    ), ranked AS (
      SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sources
    ), weighed AS (
      SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM ranked
    ), filled AS (
      SELECT *, cast(cap AS double) / weight AS full_at FROM weighed
    ), levels AS (
      SELECT *, cast(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS double)
        / cast(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS double) AS level FROM filled
      WINDOW before AS (ORDER BY full_at, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), targets AS (
      SELECT source, source_size, least(cast(cap AS double), weight *
        (SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, no LIMIT 1)) AS target FROM levels
    ), planned AS (
      SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS bigint) ELSE 0 END AS epochs FROM targets
    ), reached AS (
      SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + k.size / 2 AS mid
      FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source
    )
    SELECT doc_id, size, source_size, target, cast(size * (epochs + CASE WHEN mid <= rest THEN 1 ELSE 0 END) AS bigint) AS taken
    FROM reached
    """
