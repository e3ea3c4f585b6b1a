"""Order MinHash fingerprints, sensitive to the edit distance of texts.

A text's k-mers are runs of ``K`` words, numbered by occurrence, so a repeated k-mer counts as often as it
stands there.  The ``SLOTS`` hash functions are one hash turned around: function ``s`` counts from ``s`` parts of the
range of hashes on, past its end to its beginning.  For each the ``L`` numbered k-mers of smallest hash are
selected, put in the order in which they stand in the text, and hashed together, so every text of ``L`` k-mers has ``SLOTS`` whole
tuples, however short it is.  One sort per text serves all functions, and by it equal k-mers come to stand
together and get their numbers, too.  Two texts are as like as the share of their tuples that agree; moving
words around changes the order in a tuple and so the fingerprint, unlike with a plain MinHash.

A text and its edited text share what stands before the edit: its k-mers are made and sorted once, for both.

DataFrame functions only.  Each text is exchanged once, to the range of its id, where its neighbour is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.functions.text import settled
from corpusgauge.llm.common import GAPS, range_bounds, range_no, table, words_of

K, L = 2, 2
#: The functions differ by the leading bits of the hash from which they count.
SLOT_BITS = 6
SLOTS = 2**SLOT_BITS
#: Runs of more characters than this without a gap, as in texts without blanks, are cut.
LONG_WORD = 32
ROWS_PER_RANGE = 2_000


def cut_long(words: Column) -> Column:
    """Words of over ``LONG_WORD`` characters as several."""
    pieces = F.flatten(F.transform(words, lambda w: words_of(F.regexp_replace(w, "(.{%d})" % LONG_WORD, "$1 "))))
    return F.when(F.array_max(F.transform(words, F.length)) > LONG_WORD, pieces).otherwise(words)


def kmers(words: Column, first: Column | None = None) -> Column:
    """Hashes of the k-mers with their places, the first place being ``first``; a text of fewer words has one k-mer."""
    first = F.lit(0) if first is None else first
    n = F.when(F.size(words) >= K, F.size(words) - K + 1).when((F.size(words) > 0) & (first == 0), 1).otherwise(0)
    return F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(K)]).alias("v"), (i + first).alias("p")),
    )


def same_as_before(ordered: Column, x: Column, i: Column) -> Column:
    return (i > 0) & (F.get(ordered, i - 1)["v"] == x["v"])


def occurrence(ordered: Column, x: Column, i: Column) -> Column:
    """How many equal hashes stand before ``x`` in a sorted array: a search in halving steps."""
    return F.aggregate(
        F.array(*[F.lit(2**j) for j in range(30, -1, -1)]), F.lit(0),
        lambda t, step: F.when(
            (i - t >= step) & F.coalesce(F.get(ordered, i - t - step)["v"] == x["v"], F.lit(False)), t + step
        ).otherwise(t),
    )


def eligible(ordered: Column) -> Column:
    """All that can be selected: no k-mer with two different smaller ones in its slot, unless it is repeated."""
    v = lambda i: F.get(ordered, i)["v"]
    return F.filter(
        ordered,
        lambda x, i: (i < L)
        | (slot(F.get(ordered, i - 2)) != slot(x))
        | (v(i - 1) == x["v"])
        | F.coalesce(v(i + 1) == x["v"], F.lit(False))
        | (v(i - 1) == v(i - 2)),
    )


def first_ones(ordered: Column) -> Column:
    """K-mers at their first occurrence; they keep their hash and so their order."""
    return F.filter(ordered, lambda x, i: ~same_as_before(ordered, x, i))


def later_ones(ordered: Column, firsts: Column) -> Column:
    """K-mers at later occurrences, hashed with their number."""
    numbered = F.transform(ordered, lambda x, i: F.struct(
        F.when(same_as_before(ordered, x, i), F.xxhash64(x["v"], occurrence(ordered, x, i))).alias("v"), x["p"].alias("p")
    ))
    found = F.sort_array(F.filter(numbered, lambda y: y["v"].isNotNull()))
    return F.when(F.size(firsts) < F.size(ordered), found).otherwise(F.slice(ordered, 1, 0))


def slot(x: Column) -> Column:
    """The part of the range of hashes that ``x`` lies in, ascending as the hashes are sorted."""
    return F.shiftright(x["v"], 64 - SLOT_BITS)


def selected(ordered: Column) -> Column:
    """The first ``L`` entries of each slot."""
    return F.filter(ordered, lambda x, i: (i < L) | (slot(F.get(ordered, i - L)) != slot(x)))


def slots(chosen: Column) -> Column:
    """Per hash function the hash of its k-mers in text order, with the function's number in the leading bits.

    The functions that count from the part of an entry, or from one of the empty parts before it, select this entry and the next;
    after the last comes the first.
    """
    n = F.size(chosen)

    def entry(x, i):
        y = F.get(chosen, (i + 1) % n)
        both = F.when(y["p"] < x["p"], F.xxhash64(y["v"], x["v"])).otherwise(F.xxhash64(x["v"], y["v"]))
        body = F.shiftrightunsigned(F.when(n == 1, F.xxhash64(x["v"])).otherwise(both), SLOT_BITS)
        before = F.when(i == 0, slot(F.get(chosen, n - 1)) - SLOTS).otherwise(slot(F.get(chosen, i - 1)))
        numbers = F.sequence(before + 1, slot(x))
        tuples = F.transform(numbers, lambda s: F.shiftleft(s, 64 - SLOT_BITS).bitwiseOR(body))
        return F.when(before < slot(x), tuples).otherwise(F.array().cast("array<long>"))

    return F.sort_array(F.flatten(F.transform(chosen, entry)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the tuples that agree; two texts without words are alike, one without is unlike any other."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def shown(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.hex(x))), "-")


def stepped(df: DataFrame, keep: list[str], names: list[str], **steps) -> DataFrame:
    """One more step for every text, from the columns of the last, named by the text and a letter."""
    return settled(df, keep, **{f"_{n}_{letter}": fn(n) for letter, fn in steps.items() for n in names})


def by_slots(df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    """``keep`` of ``df`` with the tuples of each text, from its sorted k-mers ``_<name>_s``."""
    df = stepped(df, keep, names, s=lambda n: eligible(F.col(f"_{n}_s")))
    df = stepped(df, keep, names, s=lambda n: F.col(f"_{n}_s"), f=lambda n: first_ones(F.col(f"_{n}_s")))
    df = stepped(
        df, keep, names, a=lambda n: selected(F.col(f"_{n}_f")), l=lambda n: later_ones(F.col(f"_{n}_s"), F.col(f"_{n}_f"))
    )
    df = stepped(df, keep, names, c=lambda n: F.sort_array(F.concat(F.col(f"_{n}_a"), selected(F.col(f"_{n}_l")))))
    df = stepped(df, keep, names, c=lambda n: selected(F.col(f"_{n}_c")))
    return settled(df, keep, **{n: slots(F.col(f"_{n}_c")) for n in names})


def fingerprints(df: DataFrame, keep: list[str], **texts: str) -> DataFrame:
    """``keep`` of ``df`` with the tuples of each text column, named by the keyword."""
    names = list(texts)
    df = stepped(df, keep, names, w=lambda n: words_of(F.col(texts[n])))
    df = stepped(df, keep, names, w=lambda n: cut_long(F.col(f"_{n}_w")))
    df = stepped(df, keep, names, s=lambda n: F.sort_array(kmers(F.col(f"_{n}_w"))))
    return by_slots(df, keep, names)


def ends_in_word(text: Column) -> Column:
    return ~F.substr(text, F.lit(-1)).rlike(GAPS) & (F.length(text) > 0)


def starts_with_word(text: Column) -> Column:
    return ~F.substr(text, F.lit(1), F.lit(1)).rlike(GAPS) & (F.length(text) > 0)


def edited_fingerprints(df: DataFrame, keep: list[str], head: str, rest: str, other: str) -> DataFrame:
    """``keep`` of ``df`` with the tuples ``mine`` of ``head`` + ``rest`` and ``theirs`` of ``head`` + ``other``.

    The same as ``fingerprints`` of the two whole texts; the words and the sorted k-mers of ``head`` serve both.
    """
    ends = {"mine": rest, "theirs": other}
    split = settled(
        df, keep, _h=words_of(F.col(head)),
        **{f"_{n}_t": words_of(F.col(c)) for n, c in ends.items()},
        **{f"_{n}_g": ends_in_word(F.col(head)) & starts_with_word(F.col(c)) for n, c in ends.items()},
    )
    last, common = F.slice("_h", -1, 1), F.slice("_h", 1, F.greatest(F.size("_h") - 1, F.lit(0)))

    def tail(n):
        # a word may stand across the border
        t, glued = F.col(f"_{n}_t"), F.col(f"_{n}_g")
        across = F.concat(F.array(F.concat(F.get("_h", F.size("_h") - 1), F.get(t, F.lit(0)))), F.slice(t, 2, F.size(t)))
        whole = F.concat(F.when(F.size("_h") > 0, last).otherwise(F.array().cast("array<string>")), t)
        return cut_long(F.when(glued, across).otherwise(whole))

    cut = settled(split, keep, _c=cut_long(common), **{f"_{n}_t": tail(n) for n in ends})
    shared = F.greatest(F.size("_c") - (K - 1), F.lit(0))
    words = settled(
        cut, keep, _shared=shared, _mine_w=F.concat("_c", "_mine_t"),
        _theirs_w=F.concat(F.slice("_c", shared + 1, K - 1), F.col("_theirs_t")),
    )
    made = settled(
        words, keep, _shared=F.col("_shared"), _mine_s=F.sort_array(kmers(F.col("_mine_w"))),
        _theirs_s=kmers(F.col("_theirs_w"), F.col("_shared")),
    )
    # sorted already but for its end, which sorting makes use of
    early = F.filter("_mine_s", lambda x: x["p"] < F.col("_shared"))
    theirs = F.sort_array(F.concat(early, "_theirs_s"))
    made = settled(made, keep, _mine_s=F.col("_mine_s"), _theirs_s=theirs)
    return by_slots(made, keep, list(ends))


def edited(text: Column, other: Column) -> tuple[Column, Column, Column]:
    """``text`` before its last quarter of characters, that quarter, and the first as many of ``other``, which replace it."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.substr(text, F.lit(1), n - quarter), F.substr(text, n - quarter + 1, quarter), F.substr(other, F.lit(1), quarter)


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, no, ghost, doc_id, text, next_text): each document beside the one after it by id.

    Ids are cut into ranges.  The first document of each range is also dealt, as a ghost, to the
    range before it, and the very first to the last range, so one window per range finds all
    neighbours.  Null ids come first, ties by text, nulls as empty texts.
    """
    bounds = range_bounds(docs, "doc_id", ROWS_PER_RANGE)
    ranges = len(bounds) + 1
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), range_no(F.col("doc_id"), bounds).alias("_range"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))
    # one id per range, at most as many as there are bounds
    firsts = {r["_range"]: r["f"]["doc_id"] for r in placed.groupBy("_range").agg(first.alias("f")).collect()}
    ids = F.array(*[F.lit(firsts.get(i)).cast("long") for i in range(ranges)])
    opens = F.get(ids, F.col("_range")).eqNullSafe(F.col("doc_id"))
    own = F.struct(F.col("_range").alias("bucket"), F.lit(0).alias("ghost"))
    before = F.struct(F.pmod(F.col("_range") - 1, F.lit(ranges)).cast("int").alias("bucket"), F.lit(1).alias("ghost"))
    rows = placed.select("doc_id", "text", F.inline(F.when(opens, F.array(own, before)).otherwise(F.array(own))))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    return rows.withColumns({"no": F.row_number().over(order), "next_text": F.lead("text").over(order)})


def neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses.

    A single document is its own neighbour; an empty table gives no rows; other columns are not read.
    """
    head, rest, other = edited(F.col("text"), F.coalesce("next_text", F.lit("")))
    keep = ["bucket", "no", "ghost", "doc_id"]
    rows = settled(with_next(docs), keep, n_chars=F.length("text").cast("long"), head=head, rest=rest, other=other)
    keep = [*keep, "n_chars"]
    whole = F.encode(F.concat("head", "other"), "UTF-8")
    rows = settled(rows, [*keep, "head", "rest", "other"], edited_sha256=F.sha2(whole, 256))
    rows = edited_fingerprints(rows, [*keep, "edited_sha256"], "head", "rest", "other")
    following = F.lead("mine").over(Window.partitionBy("bucket").orderBy("no"))
    return rows.withColumn("following", following).where("ghost = 0").select(
        "doc_id", "n_chars", "edited_sha256",
        shown(F.col("mine")).alias("fingerprint"), shown(F.col("theirs")).alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("theirs")).alias("near_edited"),
        likeness(F.col("mine"), F.col("following")).alias("near_next"),
    )


def op8_order_minhash(spark, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and their neighbours."""
    return neighbours(table(spark, sf_dir, "documents"))
