"""Quality rules of hosts: failures counted by domain, shrunk, and joined back to documents.

A document is measured inside its row (words, symbols, repeated lines and word windows).
Each rule compares one measure with a bar.  Per host the share of documents that fail any rule is
shrunk towards the rate of all hosts with a beta prior fitted to the hosts by their moments.
A host whose shrunk rate is above ``HOST_BAR`` is held to the bars themselves; on other hosts a
document is rejected only beyond ``TOLERANCE`` times a bar.  So no document goes that fails no rule.

DataFrame functions only.  Texts are read once and never exchanged: what follows works on one short
row per document, and hosts are aggregated before anything is joined, hot or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.joins import broadcast_if_small, spread_join
from corpusgauge.functions.text import settled
from corpusgauge.llm.common import GAPS, key_of, table, words_of
from corpusgauge.session import written_once

LEAST_WORDS = 50
MOST_REPEATED = 50
SYMBOLS = "[#*$%&|<>]"
#: Per cent: symbols to words, repeated lines to lines with words, words in repeated windows to words.
BARS = {"n_symbols": ("n_words", 15), "n_dup_lines": ("n_lines", 25), "n_repeat_words": ("n_words", 12)}
TOLERANCE = 2
#: Shrunk failure rate above which a host is held to the bars themselves.
HOST_BAR = 0.3


def repeated_windows(words: Column) -> Column:
    """Hashes of the 3-word windows with their places, ordered by hash."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")
        ),
    )
    return F.when(F.size(words) > 3, F.sort_array(windows))


def measured(docs: DataFrame, whole: bool = False) -> DataFrame:
    """One short row per document with its measures (all long); null texts measure 0.

    ``n_repeat_words`` is the number of words inside 3-word windows that occur twice or more: windows
    are sorted by a 64-bit hash, those with an equal neighbour kept, and the words they cover counted
    by the gaps between their places.  Columns beyond doc_id, text and source are not read, or with
    ``whole`` carried along in a column ``_row``.
    """
    row = ["_row"] if whole else []
    docs = docs.select("doc_id", "source", "text", *([F.struct(*docs.columns).alias("_row")] if whole else []))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = settled(
        docs, ["doc_id", "source", *row],
        w=words_of(F.col("text")),
        lines=lines,
        n_symbols=F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        word_chars=F.length(F.regexp_replace(text, GAPS, "")).cast("long"),
    )
    second = settled(
        first, ["doc_id", "source", "n_symbols", "word_chars", *row],
        n_words=F.size("w").cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        s=repeated_windows(F.col("w")),
    )
    s = F.col("s")
    twice = F.filter(
        s,
        lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
    )
    third = settled(
        second, ["doc_id", "source", "n_symbols", "word_chars", "n_words", "n_lines", "n_dup_lines", *row],
        p=F.sort_array(F.transform(twice, lambda x: x["p"])),
    )
    p = F.col("p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))),
        F.lit(0), lambda total, gap: total + gap,
    )
    return third.select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), *row,
    )


def beyond(tolerance: int) -> Column:
    """Whether any measure is more than ``tolerance`` times its bar."""
    found = F.lit(False)
    for measure, (base, bar) in BARS.items():
        found = found | (F.col(measure) * 100 > F.col(base) * (bar * tolerance))
    return found


def shrunk_rates(counts: DataFrame) -> DataFrame:
    """``counts`` (failed, n per host) with ``rate``: (failed + a) / (n + a + b).

    The prior's mean and strength match the mean and variance of the hosts' own rates; hosts that
    do not differ beyond chance give a prior as strong as all documents together.  Two numbers
    come to the driver.
    """
    own = F.col("failed") / F.col("n")
    moments = counts.agg(
        (F.sum("failed") / F.sum("n")).alias("_mean"), F.var_pop(own).alias("_var"),
        F.avg(1 / F.col("n")).alias("_inverse"), F.sum("n").alias("_all"),
    )
    spread = F.col("_mean") * (1 - F.col("_mean"))
    between = F.col("_var") - spread * F.col("_inverse")
    strength = F.when(between * F.col("_all") > spread, spread / between - 1).otherwise(F.col("_all").cast("double"))
    prior = moments.select("_mean", F.greatest(strength, F.lit(1.0)).alias("_strength")).first()
    mean, weight = prior["_mean"] or 0.0, prior["_strength"] or 1.0
    return counts.withColumn("rate", (F.col("failed") + mean * weight) / (F.col("n") + weight))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def kept() -> Column:
    return ~(base_failed() | F.when(F.col("host_rate") > HOST_BAR, beyond(1)).otherwise(beyond(TOLERANCE)))


def verdicts(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`measured` with base_failed, the host's shrunk rate and kept.

    Documents without a host share one; a table without rows gives none.
    """
    rows = rows.withColumn("_host", key_of(F.col("source")))
    hosts = rows.groupBy("_host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(beyond(1).cast("long")).alias("failed")
    )
    rates = shrunk_rates(written_once(hosts)).select("_host", F.round("rate", 9).alias("host_rate"))
    return (
        spread_join(rows, rates, ["_host"], "inner", spread_by=["doc_id"])
        .withColumn("base_failed", base_failed())
        .withColumn("kept", kept())
        .drop("_host")
    )


def op4_host_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all documents; their source is the host."""
    rows = written_once(measured(table(spark, sf_dir, "documents")))
    return verdicts(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, rows and columns as they came.

    The documents are written once with their measures beside them, and only the short table of
    hosts is joined to them: no text is exchanged, and rows with repeated or null ids stay apart.
    """
    rows = written_once(measured(docs, whole=True))
    verdict = verdicts(rows.drop("_row"))
    hosts = verdict.groupBy(key_of(F.col("source")).alias("_host")).agg(F.max("host_rate").alias("host_rate"))
    judged = rows.withColumn("_host", key_of(F.col("source"))).join(broadcast_if_small(written_once(hosts)), "_host")
    return judged.where(kept()).select("_row.*")


def host_rules_sql(docs: str = "documents", text: str = "text") -> str:
    """DuckDB text of the same rules over a relation with doc_id, source and text."""
    return rf"""
    WITH split AS (
      SELECT row_number() OVER () AS rid, doc_id, source, coalesce({text}, '') AS t,
        regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce({text}, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {docs}
    ), windows AS (
      SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM split WHERE len(w) > 3
    ), keyed AS (
      SELECT rid, p, [w[p], w[p + 1], w[p + 2]] AS k FROM windows
    ), twice AS (
      SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM keyed
    ), covered AS (
      SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM twice WHERE c > 1) GROUP BY rid
    ), m AS (
      SELECT s.rid, doc_id, source, cast(len(w) AS bigint) AS n_words,
        cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS bigint) AS word_chars,
        cast(len(regexp_extract_all(t, '{SYMBOLS}')) AS bigint) AS n_symbols, cast(len(l) AS bigint) AS n_lines,
        cast(len(l) - len(list_distinct(l)) AS bigint) AS n_dup_lines, cast(coalesce(c.n, 0) AS bigint) AS n_repeat_words
      FROM split s LEFT JOIN covered c USING (rid)
    ), f AS (
      SELECT *, {_sql_beyond(1)} AS f1, {_sql_beyond(TOLERANCE)} AS f2 FROM m
    ), hosts AS (
      SELECT source, count(*) AS n, sum(CASE WHEN f1 THEN 1 ELSE 0 END) AS failed FROM f GROUP BY source
    ), moments AS (
      SELECT sum(failed) / sum(n) AS mean, var_pop(failed / n) AS v, avg(1 / n) AS inverse, sum(n) AS everything FROM hosts
    ), prior AS (
      SELECT mean, greatest(1.0, CASE WHEN (v - mean * (1 - mean) * inverse) * everything > mean * (1 - mean)
        THEN mean * (1 - mean) / (v - mean * (1 - mean) * inverse) - 1 ELSE everything END) AS strength FROM moments
    ), rates AS (
      SELECT source, (failed + mean * strength) / (n + strength) AS rate FROM hosts, prior
    ), judged AS (
      SELECT f.*, n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED} AS base_failed, round(rate, 9) > {HOST_BAR} AS strict
      FROM f JOIN rates r ON f.source IS NOT DISTINCT FROM r.source
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR CASE WHEN strict THEN f1 ELSE f2 END) AS kept FROM judged
    """


def _sql_beyond(tolerance: int) -> str:
    return " OR ".join(f"{m} * 100 > {base} * {bar * tolerance}" for m, (base, bar) in BARS.items())
