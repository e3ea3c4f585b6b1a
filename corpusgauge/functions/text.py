r"""Column helpers for text: whitespace, slices and shared patterns.

Java's ``\s``, ``\b`` and ``.`` differ from the behaviour the parsers need:
``\s`` and ``\b`` here mean the Unicode ones, and only ``\n`` ends a line
(flag ``d``).  The classes below spell that out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_RANGES = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = f"[{WS_RANGES}]"
NOT_WS = f"[^{WS_RANGES}]"
# whitespace that does not end a line
WS_INLINE = r"[\t\x{0b}-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
LEFT_EDGE = rf"(?<!{WORD})"
RIGHT_EDGE = rf"(?!{WORD})"

_WS_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WS_CHARS = "".join(map(chr, _WS_CODES))


def strip(col: Column) -> Column:
    """Trim every kind of whitespace, in time linear in the text."""
    return F.btrim(col, F.lit(WS_CHARS))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def up_to_last(text: Column, mark: str, close: str | None = None) -> Column:
    """``text`` up to its last ``mark`` (and the ``close`` after it); empty without one.

    A pattern that must end in the mark finds nothing beyond, and would try
    again from every start there.
    """
    if close is None:
        return bound(text, lambda t: F.substring(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, mark, -1))))

    def closed(whole: Column, after: Column) -> Column:
        head = F.substring(whole, F.lit(1), F.length(whole) - F.length(after))
        return F.when(F.contains(whole, F.lit(mark)), F.concat(head, F.substring_index(after, close, 1), F.lit(close))).otherwise("")

    return bound(up_to_last(text, close), lambda w: bound(F.substring_index(w, mark, -1), lambda a: closed(w, a)))


def non_empty(items: Column) -> Column:
    return F.filter(items, lambda s: s != "")


def stripped_parts(items: Column) -> Column:
    """Trimmed, non-empty elements of an array of strings."""
    return non_empty(F.transform(items, strip))


def find_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def count_all(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def lines(col: Column) -> Column:
    """All line ends that split a reference list, not only newline."""
    return F.split(col, r"[\n\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", -1)


def settled(df, keep: list[str], **exprs: Column):
    """Evaluate ``exprs`` once per row and give them names.

    The optimizer may push a projected expression into the place that uses
    it.  Inside a higher-order function that would run it once per element;
    a one-element generator between the two stops that without a shuffle.
    """
    packed = F.struct(*[e.alias(n) for n, e in exprs.items()])
    return df.select(*keep, F.inline(F.array(packed)))
