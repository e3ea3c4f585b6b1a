r"""Citations: spans, numbers, and sentences resolved to their references.

A document's text and its reference list sit in one row, so a citation is
looked up inside that row: nothing is exchanged, and a range such as
``[1]-[900]`` selects the references whose number lies in it rather than being
written out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.folds import scan
from corpusgauge.functions.text import RIGHT_EDGE, WS, WS_RANGES, find_all, settled, strip, stripped_parts, up_to_last
from corpusgauge.operators.documents import SENTENCE_END, prose, sentence_array
from corpusgauge.operators.references import entry_array, entry_struct
from corpusgauge.schema import DOC_KEYS

# The citation forms.
SPAN = r"\[[^\]]+\]"
NUMERIC_SPAN = rf"\A\[\d(?:[\d{WS_RANGES},\-–，]*\d)?\]\z"
# a letter and later on its line four digits, tried from the first letter of each line
AUTHOR_YEAR = r"(?dm)^[^A-Za-z\n]*+[A-Za-z].*?\d{4}"
AUTHOR_YEAR_SHORT = rf"\[{WS}*[A-Za-z]{{2,}}[0-9]{{2,}}[a-z]?{WS}*\]"
RANGE = rf"\[(\d+)\]{WS}*[\-–]{WS}*\[(\d+)\]"
SINGLE = r"\[(\d+)\]"
LIST_RANGE = r"\A(\d+)[\-–](\d+)"
ROUND_AUTHOR_YEAR = r"\(([A-Z][^()]+, \d{4}[a-z]?)\)"
NAME_THEN_YEAR = rf"(?<![A-Z])([A-Z][A-Za-z\-]++(?: et al\.)?){WS}*\((20\d{{2}}[a-z]?|19\d{{2}}[a-z]?)\)"
FROM_INTRODUCTION = r"(?idm)(^[^\n#]*+#[^\n]*introduction(?s:.*))\z"
# a range "3-5" or a bare number of one to three digits
BARE_NUMBER = (
    rf"(?<!\d)\d{{1,3}}{WS}*[–-]{WS}*\d{{1,3}}{RIGHT_EDGE}|(?<!\d)\d{{1,3}}{RIGHT_EDGE}"
)
BARE_RANGE = rf"\A(\d+){WS}*[–-]{WS}*(\d+)\z"


def square_brackets(text: Column) -> Column:
    """``(Author et al., 2018a; ...)`` with square brackets."""
    return F.regexp_replace(text, ROUND_AUTHOR_YEAR, "[$1]")


def spans(text: Column) -> Column:
    """Bracketed spans; what follows the last closing bracket is not searched."""
    return find_all(up_to_last(text, "]"), SPAN)


def is_author_year(span: Column) -> Column:
    return span.rlike(AUTHOR_YEAR) | span.rlike(AUTHOR_YEAR_SHORT)


def _interval(low: Column, high: Column) -> Column:
    return F.struct(low.try_cast("bigint").alias("low"), high.try_cast("bigint").alias("high"))


def number_intervals(sentence: Column, strict: bool = False) -> Column:
    """Cited numbers as intervals: ``[a]-[b]``, ``[n]`` and, unless ``strict``,
    lists inside one bracket such as ``[1,3,5-7]``."""
    # most sentences have no dash, and need not be searched for ranges
    dashed = F.contains(sentence, F.lit("-")) | F.contains(sentence, F.lit("–"))
    ranges = F.when(dashed, F.zip_with(find_all(sentence, RANGE, 1), find_all(sentence, RANGE, 2), _interval)).otherwise(
        F.array().cast("array<struct<low:bigint,high:bigint>>")
    )
    rest = F.when(dashed, F.regexp_replace(sentence, RANGE, "")).otherwise(sentence)
    if strict:
        singles = F.transform(find_all(rest, SINGLE, 1), lambda n: _interval(n, n))
    else:
        numeric = F.filter(spans(rest), lambda s: s.rlike(NUMERIC_SPAN))
        parts = F.flatten(F.transform(numeric, lambda s: stripped_parts(F.split(F.btrim(s, F.lit("[]")), "[,，]"))))
        singles = F.transform(
            parts,
            lambda p: F.when(p.rlike(r"\A\d+\z"), _interval(p, p)).otherwise(
                _interval(F.regexp_extract(p, LIST_RANGE, 1), F.regexp_extract(p, LIST_RANGE, 2))
            ),
        )
    return F.filter(F.concat(ranges, singles), lambda i: i["low"] <= i["high"])


def citation_spans(sentences: DataFrame, keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """Every bracketed span of every sentence, with its kind."""
    span = F.col("span")
    kind = (
        F.when(span.rlike(NUMERIC_SPAN), "numeric")
        .when(is_author_year(span), "author_year")
        .otherwise("other")
    )
    return sentences.select(
        *keys, "sent_no", F.posexplode(spans(F.col("sentence"))).alias("span_no", "span")
    ).withColumn("kind", kind)


def _disjoint(intervals: Column) -> Column:
    """Sorted intervals with overlapping ones merged."""
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")

    def add(done: Column, i: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        wider = F.struct(last["low"].alias("low"), F.greatest(last["high"], i["high"]).alias("high"))
        return F.when(
            F.coalesce(i["low"] <= last["high"], F.lit(False)),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider)),
        ).otherwise(F.concat(done, F.array(i)))

    return F.aggregate(F.array_sort(intervals), none, add)


def numeric_citations(
    sentences: DataFrame, keys: Sequence[str] = DOC_KEYS, strict: bool = False, block: int = 1000
) -> DataFrame:
    """Distinct cited numbers per sentence.

    Overlapping ranges are merged in the row, so no number comes twice and
    nothing is exchanged.  A range is written out ``block`` numbers at a time,
    so a mistyped ``[1]-[999999999]`` never becomes one huge array.
    """
    keys = [*keys, "sent_no"]
    citing = settled(
        sentences.filter(F.contains("sentence", F.lit("["))), keys,
        found=number_intervals(F.col("sentence"), strict),
    )
    blocks = citing.select(*keys, F.inline(_disjoint(F.col("found")))).select(
        *keys, "high", F.explode(F.sequence("low", "high", F.lit(block))).alias("start")
    )
    last = F.least(F.col("high"), F.col("start") + block - 1)
    return blocks.select(*keys, F.explode(F.sequence("start", last)).alias("ref_no"))


def _lookup(refs: Column, key: Column) -> Column:
    """Text of the entry with this id, or null."""
    return F.get(F.filter(refs, lambda r: r["ref_id"] == key), F.lit(0))["ref_text"]


def _with_references(contents: DataFrame, keys: list[str], **extra: Column) -> DataFrame:
    """Keys, ``extra``, the references of the document and the numbered ones.

    An id used twice keeps its first place and its last text; sorting by id
    finds both ends of a run of equal ids.
    """
    found = settled(contents, keys, entries=entry_array(F.col("ref_block")), **extra)
    names = [*keys, *extra]
    listed = F.transform("entries", lambda e, i: F.struct(entry_struct(e).alias("ref"), i.alias("at")))
    parsed = settled(found, names, listed=listed)
    by_id = F.array_sort(
        F.transform(
            "listed",
            lambda e: F.struct(
                e["ref"]["ref_id"].alias("ref_id"), e["at"].alias("at"), e["ref"]["ref_text"].alias("ref_text")
            ),
        )
    )
    grouped = settled(parsed, names, by_id=by_id)

    def differs(r: Column, neighbour: Column) -> Column:
        return F.coalesce(F.get(F.col("by_id"), neighbour)["ref_id"] != r["ref_id"], F.lit(True))

    ends = F.zip_with(
        F.filter("by_id", lambda r, i: differs(r, i - 1)),
        F.filter("by_id", lambda r, i: differs(r, i + 1)),
        lambda first, last: F.struct(
            first["at"].alias("at"), first["ref_id"].alias("ref_id"), last["ref_text"].alias("ref_text")
        ),
    )
    unique = settled(grouped, names, refs=F.filter(F.array_sort(ends), lambda r: r["ref_text"] != ""))
    numbered = F.array_sort(
        F.transform(
            F.filter("refs", lambda r: r["ref_id"].rlike(r"\A(0|[1-9]\d{0,17})\z")),
            lambda r: F.struct(r["ref_id"].try_cast("bigint").alias("n"), r["ref_text"].alias("text")),
        )
    )
    return settled(unique, [*names, "refs"], numbered=numbered)


def _cited(sent_no: Column, sentence: Column, strict: bool) -> Column:
    """What a sentence cites: number intervals, then keys in order."""
    names = F.zip_with(
        find_all(sentence, NAME_THEN_YEAR, 1),
        find_all(sentence, NAME_THEN_YEAR, 2),
        lambda name, year: F.struct(
            F.concat(name, F.lit(", "), year).alias("key"),
            F.concat(F.replace(name, F.lit("et al."), F.lit("et al")), F.lit(", "), year).alias("other"),
        ),
    )
    named = F.contains(sentence, F.lit("("))  # a year stands in round brackets
    names = F.when(named, names).otherwise(F.array().cast("array<struct<key:string,other:string>>"))
    dated = F.filter(spans(sentence), is_author_year)
    keys = F.flatten(F.transform(dated, lambda s: stripped_parts(F.split(F.btrim(s, F.lit("[]")), ";"))))
    plain = F.transform(keys, lambda k: F.struct(k.alias("key"), k.alias("other")))
    return F.struct(
        sent_no.alias("sent_no"),
        sentence.alias("sentence"),
        number_intervals(sentence, strict).alias("numbers"),
        F.concat(names, plain).alias("keys"),
    )


def _as_cited(number: Column, text: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), text)


def _resolved(cited: Column, refs: Column, numbered: Column) -> Column:
    by_number = F.transform(
        F.filter(
            numbered,
            lambda r: F.exists(
                cited["numbers"], lambda i: (r["n"] >= i["low"]) & (r["n"] <= i["high"])
            ),
        ),
        lambda r: _as_cited(r["n"], r["text"]),
    )

    def by_key(k: Column) -> Column:
        own, other = _lookup(refs, k["key"]), _lookup(refs, k["other"])
        return F.when(own != "", _as_cited(k["key"], own)).when(other != "", _as_cited(k["other"], other))

    keyed = F.filter(F.transform(cited["keys"], by_key), lambda t: t.isNotNull())
    return F.array_distinct(F.concat(by_number, keyed))


def _direct(contents: DataFrame, keys: list[str], strict: bool, *carry: str) -> DataFrame:
    """One row per document with ``hits``: (sent_no, sentence, refs) found."""
    with_refs = _with_references(
        contents, keys, split=sentence_array(F.col("main_content")), **{c: F.col(c) for c in carry}
    )
    kept = [*keys, *carry, "refs", "numbered"]
    # a sentence without any bracket cites nothing here
    citing = F.filter(
        F.transform("split", lambda s, i: F.struct(i.alias("sent_no"), s.alias("sentence"))),
        lambda s: F.contains(s["sentence"], F.lit("[")) | F.contains(s["sentence"], F.lit("(")),
    )
    squared = settled(
        with_refs, kept,
        squared=F.transform(
            citing,
            lambda s: F.struct(s["sent_no"].alias("sent_no"), square_brackets(s["sentence"]).alias("sentence")),
        ),
    )
    cited = settled(
        squared, kept, cited=F.transform("squared", lambda s: _cited(s["sent_no"], s["sentence"], strict))
    )
    hits = F.transform(
        F.filter("cited", lambda c: (F.size(c["numbers"]) > 0) | (F.size(c["keys"]) > 0)),
        lambda c: F.struct(
            c["sent_no"].alias("sent_no"), c["sentence"].alias("sentence"),
            _resolved(c, F.col("refs"), F.col("numbered")).alias("references"),
        ),
    )
    return settled(cited, kept, hits=F.filter(hits, lambda h: F.size(h["references"]) > 0))


def _exploded(hits: DataFrame, keys: list[str], column: str = "hits") -> DataFrame:
    return hits.select(*keys, F.inline(column))


def cite_resolve(
    contents: DataFrame, keys: Sequence[str] = DOC_KEYS, strict: bool = False
) -> DataFrame:
    """Sentences with at least one resolved citation, references in order.

    Order: by number, then ``Surname (year)``, then bracketed author-year
    keys, each once.
    """
    return _exploded(_direct(contents, list(keys), strict), list(keys))


def _fallback_sentences(main: Column) -> Column:
    """Sentences from the introduction's heading on, headings included."""
    text = prose(main)
    tail = F.regexp_extract(text, FROM_INTRODUCTION, 1)
    tail = F.when(tail != "", tail).otherwise(text)
    return stripped_parts(F.split(strip(tail), SENTENCE_END, -1))


def _bare_numbers(sentence: Column) -> Column:
    """Bare ranges and numbers in order; a number inside a range's bounds is left out."""
    tokens = F.transform(
        find_all(sentence, BARE_NUMBER),
        lambda t: F.when(
            t.rlike(BARE_RANGE),
            F.struct(
                F.regexp_extract(t, BARE_RANGE, 1).try_cast("int").alias("low"),
                F.regexp_extract(t, BARE_RANGE, 2).try_cast("int").alias("high"),
            ),
        ).otherwise(F.struct(t.try_cast("int").alias("low"), t.try_cast("int").alias("high"))),
    )
    # "7-3" is no range: it counts as the two numbers
    return F.flatten(
        F.transform(
            tokens,
            lambda t: F.when(t["low"] <= t["high"], F.array(t)).otherwise(
                F.array(
                    F.struct(t["low"].alias("low"), t["low"].alias("high")),
                    F.struct(t["high"].alias("low"), t["high"].alias("high")),
                )
            ),
        )
    )


def _fallback_numbers(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``numbers_hits``: bare numbers accepted while they count up.

    A number or range is accepted when it ends at most one above the highest
    accepted so far; the highest is carried through the document by one scan
    over its sentences.
    """
    rest = [c for c in docs.columns if c != "loose"]
    found = settled(
        docs, rest,
        loose=F.transform("loose", lambda s: F.struct(s.alias("sentence"), _bare_numbers(s).alias("found"))),
    )
    alone = F.transform(
        "loose",
        lambda s: F.struct(
            s["sentence"].alias("sentence"),
            F.filter(
                s["found"],
                lambda t: (t["low"] < t["high"])
                | ~F.exists(
                    s["found"],
                    lambda r: (r["low"] < r["high"]) & (t["low"] >= r["low"]) & (t["low"] <= r["high"]),
                ),
            ).alias("found"),
        ),
    )
    flat = settled(found, [c for c in found.columns if c != "loose"], loose=alone)
    start = F.struct(F.lit(0).alias("top"), F.array().cast("array<struct<low:int,high:int>>").alias("kept"))

    def accept(state: Column, t: Column) -> Column:
        return F.when(
            t["high"] <= state["top"] + 1,
            F.struct(
                F.greatest(state["top"], t["high"]).alias("top"), F.concat(state["kept"], F.array(t)).alias("kept")
            ),
        ).otherwise(state)

    # what a sentence accepts stays with it; the highest goes on to the next sentence
    def sentence_by_sentence(state: Column, s: Column) -> Column:
        return F.aggregate(s["found"], F.struct(state["top"].alias("top"), start["kept"].alias("kept")), accept)

    accepted = settled(flat, found.columns, accepted=scan(F.col("loose"), start, sentence_by_sentence))
    resolved = F.transform(
        "loose",
        lambda s, i: F.struct(
            i.alias("sent_no"), s["sentence"].alias("sentence"),
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.get(F.col("accepted"), i)["kept"],
                        lambda a: F.transform(
                            F.filter("numbered", lambda r: (r["n"] >= a["low"]) & (r["n"] <= a["high"])),
                            lambda r: _as_cited(r["n"], r["text"]),
                        ),
                    )
                )
            ).alias("references"),
        ),
    )
    return settled(accepted, found.columns, number_hits=F.filter(resolved, lambda h: F.size(h["references"]) > 0))


def _named(refs: Column) -> Column:
    """(name, shown) of every entry with a leading capitalised word, its surname; taken out once per entry."""
    entries = F.filter(refs, lambda r: r["ref_id"].rlike(r"\A\[?[A-Z]"))
    return F.transform(entries, lambda r: F.struct(
        F.regexp_extract(r["ref_id"], r"\A\[?([A-Z][A-Za-z\-]*)", 1).alias("name"),
        F.concat(r["ref_id"], F.lit(" "), r["ref_text"]).alias("shown"),
    ))


def _surname_hits(sentence: Column, named: Column) -> Column:
    """``id text`` of every entry of :func:`_named` whose surname is in the sentence."""
    hits = F.filter(named, lambda r: F.contains(sentence, r["name"]))
    return F.array_distinct(F.transform(hits, lambda r: r["shown"]))


def citations(contents: DataFrame, keys: Sequence[str] = DOC_KEYS, strict: bool = False) -> DataFrame:
    """All cited sentences with the way they were found.

    Documents without any bracketed hit fall back to bare numbers, those
    without either to surnames.  ``stage`` is 1, 2 or 3.
    """
    keys = list(keys)
    direct = _direct(contents, keys, strict, "main_content")
    none = F.size("hits") == 0
    loose = F.when(none, _fallback_sentences(F.col("main_content"))).otherwise(F.array().cast("array<string>"))
    named = F.when(none, _named(F.col("refs")))
    staged = settled(direct, [*keys, "numbered", "hits"], named=named, loose=loose)
    with_numbers = _fallback_numbers(staged, keys)
    by_name = F.filter(
        F.transform(
            "loose",
            lambda s, i: F.struct(
                i.alias("sent_no"), s["sentence"].alias("sentence"),
                _surname_hits(s["sentence"], F.col("named")).alias("references"),
            ),
        ),
        lambda h: F.size(h["references"]) > 0,
    )
    stage = F.when(F.size("hits") > 0, 1).when(F.size("number_hits") > 0, 2).otherwise(3)
    chosen = F.when(F.size("hits") > 0, F.col("hits")).when(
        F.size("number_hits") > 0, F.col("number_hits")
    ).otherwise(by_name)
    return _exploded(settled(with_numbers, keys, stage=stage, chosen=chosen), [*keys, "stage"], "chosen")


def cite_fallback_numbers(contents: DataFrame, keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """The bare-number stage for documents without any bracketed hit."""
    keys = list(keys)
    direct = _direct(contents, keys, False, "main_content")
    staged = settled(
        direct.filter(F.size("hits") == 0), [*keys, "numbered"],
        loose=_fallback_sentences(F.col("main_content")),
    )
    return _exploded(_fallback_numbers(staged, keys), keys, "number_hits")


def cite_fallback_surnames(contents: DataFrame, keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """The surname stage on its own: every sentence from the introduction on."""
    keys = list(keys)
    parsed = _with_references(contents, keys, loose=_fallback_sentences(F.col("main_content")))
    with_refs = settled(parsed, [*keys, "loose"], named=_named(F.col("refs")))
    hits = F.transform(
        "loose",
        lambda s, i: F.struct(
            i.alias("sent_no"), s.alias("sentence"), _surname_hits(s, F.col("named")).alias("references")
        ),
    )
    return _exploded(settled(with_refs, keys, hits=F.filter(hits, lambda h: F.size(h["references"]) > 0)), keys)


def write_citations(cited: DataFrame, keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """``sentence`` and its references joined by ``;``, each sentence once per document.

    A repeated sentence has the references of its last place.
    """
    last = cited.groupBy(*keys, "sentence").agg(F.max_by("references", "sent_no").alias("references"))
    return last.select(*keys, "sentence", F.array_join("references", ";").alias("references"))
