r"""Reference lists: entries, ids, batches and runs of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgauge.functions.text import (
    LEFT_EDGE,
    RIGHT_EDGE,
    WS,
    lines,
    settled,
    strip,
    stripped_parts,
)
from corpusgauge.schema import DOC_KEYS

# Fixed values: "1." "1)" and "1 A" at the head of a line; a year with letter.
# (a line after an empty one belongs to the match tried at the empty one)
LEADING_NUMBER = rf"(?dm)^(?<!\n[ \t]{{0,4}}\n){WS}*(\d+)(?:[.)]{WS}+|{WS}+(?=[A-Z]))"
YEAR = rf"{LEFT_EDGE}(20\d{{2}}[a-z]?|19\d{{2}}[a-z]?){RIGHT_EDGE}"
BRACKETED = rf"(?s)\A\[(.+?)\]{WS}*(.*)\z"


def author_year_key(entry: Column) -> Column:
    """``A, y``, ``A and B, y``, ``A et al., y`` or ``Unknown, y``.

    Names are what precedes the year (without a year: the first sentence),
    separated by commas or "and"; the last word of a name is the surname.
    """
    dated = entry.rlike(YEAR)
    year = F.when(dated, F.regexp_extract(entry, YEAR, 1)).otherwise(F.lit("????"))
    head = F.when(dated, strip(F.regexp_extract(entry, rf"(?s)\A(.*?){YEAR}", 1))).otherwise(
        strip(F.split_part(entry, F.lit("."), F.lit(1)))
    )
    names = stripped_parts(F.split(F.replace(head, F.lit(" and "), F.lit(", ")), ","))
    surnames = F.transform(
        names, lambda n: F.btrim(F.element_at(F.split(n, f"{WS}+"), -1), F.lit("."))
    )
    who = (
        F.when(F.size(surnames) >= 3, F.concat(F.get(surnames, F.lit(0)), F.lit(" et al.")))
        .when(F.size(surnames) == 2, F.concat(F.get(surnames, F.lit(0)), F.lit(" and "), F.get(surnames, F.lit(1))))
        .when(F.size(surnames) == 1, F.get(surnames, F.lit(0)))
        .otherwise(F.lit("Unknown"))
    )
    return strip(F.btrim(F.concat(who, F.lit(", "), year), F.lit("[]")))


def entry_array(block: Column) -> Column:
    """Entries of a reference block as trimmed strings.

    Numbers at line heads become ``[n]``.  When at least half of the lines
    (rounded down) start with a bracket, entries begin at such lines;
    otherwise every line is an entry.
    """
    numbered = F.regexp_replace(block, LEADING_NUMBER, "[$1] ")
    rows = stripped_parts(lines(numbered))
    bracketed = F.size(F.filter(rows, lambda r: r.startswith("[")))
    by_bracket = stripped_parts(F.split(numbered, r"(?dm)(?=^\[.*?\])", -1))
    return F.when(
        (numbered != "") & (bracketed >= F.floor(F.size(rows) / 2)), by_bracket
    ).otherwise(rows)


def entry_struct(entry: Column) -> Column:
    """(ref_id, ref_text, entry) of one entry."""
    bracketed = entry.rlike(BRACKETED)
    return F.struct(
        F.when(bracketed, strip(F.regexp_extract(entry, BRACKETED, 1))).otherwise(author_year_key(entry)).alias("ref_id"),
        F.when(bracketed, strip(F.regexp_extract(entry, BRACKETED, 2))).otherwise(entry).alias("ref_text"),
        entry.alias("entry"),
    )


def reference_entries(
    contents: DataFrame, block: str = "ref_block", keys: Sequence[str] = DOC_KEYS
) -> DataFrame:
    """One row per entry: position, id, text and the entry as written."""
    found = settled(contents, list(keys), entries=entry_array(F.col(block)))
    parsed = F.transform("entries", entry_struct)
    return found.select(*keys, F.posexplode(parsed).alias("ref_pos", "ref")).select(
        *keys, "ref_pos", "ref.ref_id", "ref.ref_text", "ref.entry"
    )


def ref_batches(
    contents: DataFrame, size: int = 20, block: str = "ref_block", keys: Sequence[str] = DOC_KEYS
) -> DataFrame:
    """Entries of each document in batches of ``size``, one text per batch."""
    found = settled(contents, list(keys), entries=entry_array(F.col(block)))
    starts = F.when(
        F.size("entries") > 0, F.sequence(F.lit(0), F.size("entries") - 1, F.lit(size))
    ).otherwise(F.array().cast("array<int>"))
    return found.select(*keys, "entries", F.posexplode(starts).alias("batch_no", "start")).select(
        *keys, "batch_no",
        F.least(F.lit(size), F.size("entries") - F.col("start")).alias("entries"),
        F.array_join(F.slice("entries", F.col("start") + 1, F.lit(size)), "\n").alias("batch"),
    )


def ref_number_runs(refs: DataFrame, keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """Unbroken runs of reference numbers; the one from 1 is marked.

    Numbers have up to 37 digits besides leading zeros.
    """
    keys = list(keys)
    numbers = refs.filter(F.col("ref_id").rlike(r"\A0*[0-9]{1,37}\z")).select(
        *keys, F.col("ref_id").cast("decimal(38,0)").alias("n")
    )
    # equal numbers share a rank, and the groups below keep the exchange of the window
    island = F.col("n") - F.dense_rank().over(Window.partitionBy(*keys).orderBy("n"))
    return (
        numbers.withColumn("island", island)
        .groupBy(*keys, "island")
        .agg(F.min("n").alias("first"), F.max("n").alias("last"))
        .select(*keys, "first", "last", (F.col("first") == 1).alias("from_one"))
    )
