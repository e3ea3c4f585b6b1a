r"""Markdown documents: main content, sections, sentences and features.

All parsing happens inside the row that holds the document: one projection,
one generator, no shuffle.  Only the grouped means at the end exchange data,
and they are partially aggregated first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.numbers import half_up
from corpusgauge.functions.text import (
    LEFT_EDGE,
    NOT_WS,
    RIGHT_EDGE,
    WS,
    WS_RANGES,
    bound,
    count_all,
    find_all,
    settled,
    strip,
    stripped_parts,
    up_to_last,
)
from corpusgauge.schema import DOC_KEYS

# What marks the start of a reference list, strictest first.
EXACT_HEADING = rf"^#{{1,6}}{WS}*References{WS}*$"
LOOSE_HEADING = r"^#{1,6}.*reference"
NUMBERED_LINE = r"^\[\d+\]"
REFERENCE_WORD = rf"{LEFT_EDGE}(?:bibliography|references?){RIGHT_EDGE}"
NEXT_HEADING = rf"^#{{1,6}}{WS}+{NOT_WS}+"

_LAST_WORD = rf"(?is)\A(.*){REFERENCE_WORD}(.*)\z"

# Markdown and LaTeX features.
IMAGE = r"(?d)!\[.*?\]\(.*?\)"
HTML_IMAGE = r"(?i)<img [^>]*>"
HTML_IMAGE_SRC = r"(?id)<img [^>]*src=['\"].*?['\"][^>]*>"
BLOCK_EQUATIONS = [r"(?s)\$\$.*?\$\$", r"(?s)\\\[.*?\\\]", r"(?s)\\begin\{.*?\}.*?\\end\{.*?\}"]
INLINE_EQUATION = r"(?d)(?<!\$)\$(?!\$)(.+?)(?<!\$)\$(?!\$)"
# one run of pipe lines; it is a table when a separator row follows its head
PIPE_RUN = r"\|[^\n]*+(?:\n\|[^\n]*+)*+"
SEPARATOR_ROW = rf"\n\|[{WS_RANGES}\-:|]+\|"
HTML_TABLE = r"(?is)<table.*?</table>"
LAST_TABLE = r"(?is)\A.*</table>"

SENTENCE_END = rf"\.(?={WS}+[A-Z]|\n|[A-Z])"
# a run of marks before whitespace, or up to its last newline; a run is tried once
COUNTED_SENTENCE_END = rf"(?<![.!?\n])(?:[.!?\n]++(?:{WS}|\z)|[.!?\n]+\n)"


def reference_tier(md: Column) -> Column:
    """1 a heading "References", 2 a heading that mentions a reference, 3 a line
    that starts with ``[n]``, 4 a last word "references" or "bibliography",
    5 no references."""
    return (
        F.when(md.rlike(f"(?dim){EXACT_HEADING}"), 1)
        .when(md.rlike(f"(?dim){LOOSE_HEADING}"), 2)
        .when(md.rlike(f"(?dm){NUMBERED_LINE}"), 3)
        .when(md.rlike(f"(?i){REFERENCE_WORD}"), 4)
        .otherwise(5)
    )


def _around(md: Column, tier: Column) -> Column:
    """[text before the mark, text from it on]; splitting once finds both."""
    return (
        F.when(tier == 1, F.split(md, f"(?dim){EXACT_HEADING}", 2))
        .when(tier == 2, F.split(md, f"(?dim){LOOSE_HEADING}", 2))
        # an empty match at the very start would not split
        .when(md.rlike(rf"\A{NUMBERED_LINE[1:]}") & (tier == 3), F.array(F.lit(""), md))
        .when(tier == 3, F.split(md, f"(?dm)(?={NUMBERED_LINE})", 2))
        .when(tier == 4, F.array(F.regexp_extract(md, _LAST_WORD, 1), F.regexp_extract(md, _LAST_WORD, 2)))
        .otherwise(F.array(md, F.lit("")))
    )


def split_content_refs(
    docs: DataFrame, text: str = "md", keys: Sequence[str] = DOC_KEYS
) -> DataFrame:
    """``main_content``, ``ref_block`` and ``tier`` of every document.

    In tiers 1, 2 and 4 the list ends at the next heading and the main
    content goes on after that heading's first word.
    """
    keys = list(keys)
    tier = F.col("tier")
    tiered = settled(docs, [*keys, text], tier=reference_tier(F.col(text)))
    cut = settled(tiered, [*keys, "tier"], around=_around(F.col(text), tier))
    before, after = F.get("around", F.lit(0)), F.get("around", F.lit(1))
    bounded = tier.isin(1, 2, 4)
    listed = F.when(bounded, F.split(after, f"(?dm){NEXT_HEADING}", 2)).otherwise(F.array(after))
    parts = settled(cut, [*keys, "tier"], head=strip(before), listed=listed)
    tail = strip(F.coalesce(F.get("listed", F.lit(1)), F.lit("")))
    main = F.when(bounded, F.concat("head", F.lit("\n"), tail)).otherwise(F.col("head"))
    return parts.select(
        *keys, "tier", main.alias("main_content"), strip(F.get("listed", F.lit(0))).alias("ref_block")
    )


def sections_by_hash(
    contents: DataFrame, text: str = "main_content", keys: Sequence[str] = DOC_KEYS
) -> DataFrame:
    """Cut before every line that starts with ``#``; a preamble is a section."""
    return contents.select(
        *keys, F.posexplode(F.split(text, r"\n(?=#)", -1)).alias("section_no", "section")
    )


def sections_by_heading(
    docs: DataFrame, text: str = "md", keys: Sequence[str] = DOC_KEYS
) -> DataFrame:
    """Cut before every heading line; what precedes the first one is dropped."""
    cut = F.split(text, rf"(?dm)(?=^#+{WS}+)", -1)
    headed = F.filter(cut, lambda s: s.rlike(rf"\A#+{WS}"))
    return docs.select(*keys, F.posexplode(headed).alias("section_no", "section"))


def prose(main: Column) -> Column:
    """Main content without images and embedded HTML pages."""
    no_images = bound(main, lambda m: _replaced(m, IMAGE, up_to_last(m, "](", ")")))
    pages = r"(?s)<html>.*?</html>"
    return bound(no_images, lambda m: F.when(F.contains(m, F.lit("</html>")), _replaced(m, pages, up_to_last(m, "</html>"))).otherwise(m))


def _replaced(text: Column, pattern: str, part: Column) -> Column:
    """``text`` without the pattern, which is only looked for in ``part``, its beginning."""
    return bound(part, lambda p: F.concat(F.regexp_replace(p, pattern, ""), F.substring(text, F.length(p) + 1, F.length(text))))


def sentence_array(main: Column) -> Column:
    """Sentences of the main content in order."""
    no_headings = F.regexp_replace(prose(main), rf"(?dm)^#+{WS}+.*$", "")
    packed = F.regexp_replace(no_headings, r"\n{2,}", "\n")
    return stripped_parts(F.split(packed, SENTENCE_END, -1))


def sentences(
    contents: DataFrame, text: str = "main_content", keys: Sequence[str] = DOC_KEYS
) -> DataFrame:
    return contents.select(
        *keys, F.posexplode(sentence_array(F.col(text))).alias("sent_no", "sentence")
    )


def sentence_count(text: Column) -> Column:
    """Non-empty pieces between runs of sentence-ending marks."""
    return F.size(F.filter(F.split(strip(text), COUNTED_SENTENCE_END, -1), lambda s: s != ""))


def sentence_counts(
    contents: DataFrame, text: str = "main_content", by: Sequence[str] = ("category", "system")
) -> DataFrame:
    """Documents and mean number of sentences per category and system."""
    return contents.select(*by, sentence_count(F.col(text)).alias("n")).groupBy(*by).agg(
        F.count("*").alias("docs"), half_up(F.avg("n"), 6).alias("mean_sentences")
    )


def md_features(docs: DataFrame, text: str = "md", keys: Sequence[str] = DOC_KEYS) -> DataFrame:
    """Images, equations, tables and sentences per document, and densities.

    A density is a count divided by the number of sentences.
    """
    keys = list(keys)
    md = F.col(text)
    tagged = up_to_last(md, ">")
    images = F.size(
        F.array_distinct(
            F.concat(
                find_all(up_to_last(md, "](", ")"), IMAGE), find_all(tagged, HTML_IMAGE_SRC), find_all(tagged, HTML_IMAGE)
            )
        )
    )
    closed = [md, up_to_last(md, "\\]"), up_to_last(md, "\\end{", "}")]
    equations = sum((count_all(part, p) for part, p in zip(closed, BLOCK_EQUATIONS, strict=True)), count_all(md, INLINE_EQUATION))
    tables = F.size(F.filter(find_all(md, PIPE_RUN), lambda t: t.rlike(SEPARATOR_ROW))) + count_all(
        F.regexp_extract(md, LAST_TABLE, 0), HTML_TABLE
    )
    counted = settled(
        docs, [*keys, text], images=images, equations=equations, tables=tables
    )
    main = split_content_refs(counted, text, [*keys, "images", "equations", "tables"])
    counted = settled(
        main, [*keys, "images", "equations", "tables"], sentences=sentence_count(F.col("main_content"))
    )
    densities = [
        F.when(F.col("sentences") > 0, half_up(F.col(c) / F.col("sentences"), 6)).alias(f"{c.capitalize()}_density")
        for c in ("images", "equations", "tables")
    ]
    return counted.select("*", *densities)


def md_feature_means(features: DataFrame, by: Sequence[str] = ("category", "system")) -> DataFrame:
    """Mean of every feature per group, long."""
    names = [
        "images", "equations", "tables", "sentences",
        "Images_density", "Equations_density", "Tables_density",
    ]
    wide = features.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])
    cells = [F.struct(F.lit(n).alias("feature"), half_up(F.col(n), 6).alias("value")) for n in names]
    return wide.select(*by, F.inline(F.array(*cells)))
