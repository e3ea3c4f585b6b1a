r"""Claims: parsing, duplicates, density, grounding of numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.functions.numbers import half_up, ratio
from corpusgauge.functions.text import LEFT_EDGE, RIGHT_EDGE, WS, bound, find_all, settled, strip, stripped_parts
from corpusgauge.session import written_once

NUMBERED_CLAIM = rf"\d+\.{WS}*([^\n]+)"
CLAIM_LABEL = r"\AClaim \d+: "
#: Claims in one band that meet the same member in one task.
MEETINGS = 1_000
PUNCTUATION = r"""[!-/:-@\[-`{-~]"""
WHOLE_NUMBER = rf"{LEFT_EDGE}\d+{RIGHT_EDGE}"


def claims_parse(responses: DataFrame, keys: Sequence[str], raw: str = "raw") -> DataFrame:
    """``n. text`` lines of a response as claims; the last one ends in a period."""
    found = settled(responses, list(keys), found=find_all(F.col(raw), NUMBERED_CLAIM, 1))
    ended = F.transform(
        "found",
        lambda c, i: F.when((i == F.size("found") - 1) & ~c.endswith("."), F.concat(c, F.lit("."))).otherwise(c),
    )
    clean = F.transform(ended, lambda c: F.regexp_replace(c, CLAIM_LABEL, ""))
    return found.select(*keys, F.posexplode(clean).alias("claim_no", "claim"))


def normalized(claim: Column) -> Column:
    """Lower case without ASCII punctuation, articles and extra spaces."""
    plain = F.regexp_replace(F.lower(claim), PUNCTUATION, "")
    bare = F.regexp_replace(plain, rf"{LEFT_EDGE}(?:a|an|the){RIGHT_EDGE}", " ")
    return F.array_join(stripped_parts(F.split(bare, f"{WS}+")), " ")


def claims_dedup(claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first claim of every normalised text in a document."""
    return (
        claims.groupBy(*keys, normalized(F.col("claim")).alias("norm"))
        .agg(F.min("claim_no").alias("claim_no"), F.min_by("claim", "claim_no").alias("claim"), F.count("*").alias("copies"))
        .select(*keys, "claim_no", "claim", "copies")
    )


def word_signature(words: Column, bands: int, rows: int) -> Column:
    """MinHash of a set of words: one hash per band, over the least hashes of ``rows`` functions."""

    def least(hashes: Column, number: Column) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, number)))

    def band(hashes: Column, j: Column) -> Column:
        return F.xxhash64(j, *[least(hashes, j * rows + r) for r in range(rows)])

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return bound(hashed, lambda hashes: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: band(hashes, j)))


def claims_near_dedup(
    claims: DataFrame, keys: Sequence[str], percent: int = 80, bands: int = 20, rows: int = 3
) -> DataFrame:
    """Keys, ``claim_no``, ``claim`` and ``copies`` of the claims that are no near copy of an earlier one in their document.

    Claims with one normalised text fold into their first (``copies``).  Of two folded claims whose word sets have a
    Jaccard similarity of at least ``percent``, the one with the larger (``claim_no``, text) goes, whether or not the other stays.
    Candidates share a band of a MinHash signature: a pair at 0.8 is missed with a chance of 0.488 to the power 20, 6e-7, one further
    apart is checked exactly before anything goes.

    A claim meets the first member of its bands, which the window over a band hands it, and then the members after it, 2, 4 ... at a
    time, until one of them is near; it then asks no more.  So of many near copies each meets a few, no pairs of a whole band are made,
    and rounds grow with the logarithm of the longest band.  Members whose numbers of words rule them out are not compared.
    """
    keys = list(keys)
    folded = claims.groupBy(*keys, normalized(F.col("claim")).alias("_norm")).agg(
        F.min("claim_no").alias("claim_no"), F.min_by("claim", "claim_no").alias("claim"), F.count("*").alias("copies")
    )
    words = F.filter(F.array_distinct(F.split("_norm", " ")), lambda w: w != "")
    # a claim's place in its document stands for (claim_no, text), so no text travels with its bands; a claim alone has no near copy
    in_doc = Window.partitionBy(*keys)
    placed = folded.withColumns({"_no": F.row_number().over(in_doc.orderBy("claim_no", "_norm")), "_claims": F.count("*").over(in_doc)})
    nodes = written_once(placed.withColumns({"_words": words, "_id": F.monotonically_increasing_id()}).drop("_norm"))
    # a band is known by a hash over the document as well; the check compares both again
    own = F.xxhash64("_band", F.struct(*keys))
    banded = nodes.where((F.size("_words") > 0) & (F.col("_claims") > 1)).select(
        *keys, "_id", "_no", F.size("_words").alias("_size"),
        F.explode(word_signature(F.col("_words"), bands, rows)).alias("_band"),
    ).select(own.alias("_band"), "_id", "_no", "_size")
    by_band = Window.partitionBy("_band").orderBy("_no", "_id")
    member = F.struct("_id", "_size")
    placed = banded.select(
        "_band", "_id", "_size", (F.row_number().over(by_band) - 1).alias("_at"),
        F.first(member).over(by_band).alias("_head"), F.lead("_id").over(by_band).alias("_next"),
    )
    placed = written_once(placed.where((F.col("_at") > 0) | F.col("_next").isNotNull()).drop("_next"))
    # those that meet one member stand in parts, so that a member whom many meet is in as many tasks
    asking = placed.where("_at > 0").withColumn("_part", F.floor(F.col("_at") / MEETINGS))
    met, found, low = asking, [], 1
    while True:
        able = 100 * F.least("_size", "_head._size") >= percent * F.greatest("_size", "_head._size")
        pairs = met.where(able).groupBy("_id", F.col("_head._id").alias("_first")).agg(F.min("_part").alias("_part"))
        near = written_once(_near(written_once(pairs), nodes, keys, percent))
        found.append(near)
        asking = written_once(asking.where(F.col("_at") > low).join(near, "_id", "left_anti").drop("_head"))
        if asking.isEmpty():
            break
        high = 2 * low + 1  # members from low up to this
        meets = F.explode(F.sequence(F.lit(low), F.least(F.lit(high - 1), F.col("_at") - 1)))
        members = placed.where(F.col("_at").between(low, high - 1)).select("_band", "_at", member.alias("_head"))
        met = _joined_in_parts(asking.select("_band", "_id", "_size", "_part", meets.alias("_at")), members, ["_band", "_at"])
        low = high
    kept = reduce(lambda left, near: left.join(near, "_id", "left_anti"), found, nodes)
    return kept.select(*keys, "claim_no", "claim", "copies")


def _joined_in_parts(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with the one row of their key; a copy of it goes to each ``_part`` in which ``rows`` has the key."""
    copies = rows.select(*keys, "_part").distinct().join(per_key, keys)
    return rows.join(copies, [*keys, "_part"])


def _near(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str], percent: int) -> DataFrame:
    """(_id) of the pairs whose sets of words are near; a set that many are compared with is joined in parts."""
    sets = nodes.select("_id", F.struct(*keys).alias("_doc"), "_words")
    first = sets.select(F.col("_id").alias("_first"), F.col("_doc").alias("_first_doc"), F.col("_words").alias("_first_words"))
    both = _joined_in_parts(pairs, first, ["_first"]).join(sets, "_id")
    shared = F.size(F.array_intersect("_words", "_first_words"))
    near = 100 * shared >= percent * (F.size("_words") + F.size("_first_words") - shared)
    return both.where(F.col("_doc").eqNullSafe(F.col("_first_doc")) & near).select("_id").distinct()


def removal_groups(claims: DataFrame, size: int = 300) -> DataFrame:
    """Group number and place in the group of every claim, from ``claim_no``."""
    return claims.withColumns(
        {
            "group_no": F.floor(F.col("claim_no") / size).cast("int"),
            "place": (F.col("claim_no") % size + 1).cast("int"),
        }
    )


def listed_places(raw: Column) -> Column:
    """The numbers in a list such as "2, 5"; parts that are not numbers are ignored."""
    parts = F.filter(stripped_parts(F.split(raw, ",")), lambda p: p.rlike(r"\A\d{1,9}\z"))
    return F.transform(parts, lambda p: p.cast("int"))


def apply_removals(
    claims: DataFrame, removals: DataFrame, keys: Sequence[str], size: int = 300
) -> DataFrame:
    """Drop the claims a judge listed ("2, 5") for each group of ``size``.

    ``removals`` holds keys, ``group_no`` and ``raw``.  Parts of the list that
    are not numbers are ignored.  One pass inside the groups; ``judging.claims_removed_by_judge``
    has the passes between them.
    """
    listed = removals.select(*keys, "group_no", F.explode(listed_places(F.col("raw"))).alias("place"))
    return (
        removal_groups(claims, size)
        .join(listed, [*keys, "group_no", "place"], "left_anti")
        .drop("group_no", "place")
    )


def claim_density(claims: DataFrame, sentences: DataFrame, keys: Sequence[str], kept: DataFrame | None = None) -> DataFrame:
    """Claims per sentence before and after removing duplicates, 4 digits.

    ``sentences`` has keys and ``sentences``.  ``kept`` holds the claims that a judge or another way has left; without it
    claims with one normalised text count once.  Claims are counted in a first
    aggregation, so copies never travel as rows.
    """
    keys = list(keys)
    if kept is None:
        folded = claims.groupBy(*keys, normalized(F.col("claim")).alias("norm")).agg(F.count("*").alias("n"))
        counts = folded.groupBy(*keys).agg(F.sum("n").alias("before"), F.count("*").alias("after"))
    else:
        marked = claims.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
            kept.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("a"))
        )
        counts = marked.groupBy(*keys).agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
    # a union and an aggregation, as keys may be null
    nothing = F.lit(None).cast("bigint")
    both = (
        sentences.select(*keys, F.col("sentences").cast("bigint").alias("n"), nothing.alias("before"), nothing.alias("after"))
        .unionByName(counts.select(*keys, nothing.alias("n"), "before", "after"))
        .groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "before", "after")])
    )
    n, before, after = F.col("n"), F.col("before"), F.col("after")
    return both.select(
        *keys, n.alias("sentences"), before.alias("claims_before"),
        half_up(ratio(before, n), 4).alias("density_before"),
        after.alias("claims_after"),
        half_up(ratio(after, n), 4).alias("density_after"),
        half_up(ratio(after, before), 4).alias("compression_ratio"),
    )


def _numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(find_all(text, WHOLE_NUMBER)))


def numeric_grounding(claims: DataFrame, keys: Sequence[str] = ("doc", "sent_no")) -> DataFrame:
    """Keep claims whose numbers occur in their sentence.

    A number that begins a number of the sentence is replaced by it (the
    smallest such, as text); a claim with any other foreign number goes.
    Exact repeats go.  Where the kept claims do not cover every number of a
    sentence, its claims stay as they were.
    """
    keys = list(keys)
    own = settled(
        claims, [*keys, "claim_no", "claim"],
        have=_numbers(F.col("sentence")), said=_numbers(F.col("claim")),
    )
    foreign = F.array_except("said", "have")
    swaps = F.transform(
        foreign,
        lambda n: F.struct(n.alias("from"), F.get(F.filter("have", lambda h: h.startswith(n)), F.lit(0)).alias("to")),
    )
    swapped = settled(own, [*keys, "claim_no", "claim", "have", "said"], swaps=swaps)
    grounded = ~F.exists("swaps", lambda s: s["to"].isNull())
    fixed = F.aggregate("swaps", F.col("claim"), lambda text, s: F.replace(text, s["from"], s["to"]))
    covered = F.array_union(F.array_intersect("said", "have"), F.filter(F.col("swaps.to"), lambda t: t.isNotNull()))
    checked = settled(
        swapped, [*keys, "claim_no", "claim", "have"],
        grounded=grounded, fixed=F.when(grounded, fixed), covered=covered,
    )
    # numbers of the sentence that some claim of it covers
    seen = (
        checked.select(*keys, F.size("have").alias("wanted"), F.explode_outer("covered").alias("number"))
        .groupBy(*keys).agg(F.max("wanted").alias("wanted"), F.count_distinct("number").alias("seen"))
        .select(*keys, (F.col("wanted") == F.col("seen")).alias("complete"))
    )
    judged = checked.join(seen, keys).filter("grounded OR NOT complete")
    # repeats fold among the changed claims only: the others keep a key of their own
    single = F.when(F.col("complete"), F.lit(-1)).otherwise(F.col("claim_no"))
    return (
        judged.withColumn("claim", F.when(F.col("complete"), F.col("fixed")).otherwise(F.col("claim")))
        .groupBy(*keys, "claim", "complete", single.alias("single"))
        .agg(F.min("claim_no").alias("claim_no"))
        .select(*keys, "claim_no", "claim", F.col("complete").alias("grounded"))
    )
