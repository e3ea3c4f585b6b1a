"""Reading JSON out of free-form answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge.functions.text import strip

_STRICT = {"allowSingleQuotes": "false"}
_LITERAL = {"allowBackslashEscapingAnyCharacter": "true"}
#: A quoted string (an open one up to the end), or what stands between two.
_PIECES = r"""(?s)'(?:[^'\\]|\\.)*+(?:'|\z)|"(?:[^"\\]|\\.)*+(?:"|\z)|[^'"]++"""


def _only(parsed: Column) -> Column:
    """The single element of a wrapped parse; text after it would add more or fail."""
    return F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0)))


def _wrapped(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]"))


def object_fields(raw: Column) -> Column:
    """Fields of the JSON object in a response, or null.

    The whole response, else the part from the first ``{`` to the last ``}``.
    A response that is valid JSON of another kind has no fields.
    """
    whole = _only(F.from_json(_wrapped(raw), "array<string>", _STRICT))
    other = whole.isNotNull() & ~strip(raw).startswith("{")
    part = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    found = _only(F.from_json(_wrapped(part), "array<map<string,string>>", _STRICT))
    return F.when(~other & (part != ""), found)


def as_json(literal: Column) -> Column:
    """A Python literal with the constants of JSON and without closing commas; what stands in quotes stays as it is."""

    def plain(piece: Column) -> Column:
        for word, value in (("True", "true"), ("False", "false"), ("None", "null")):
            piece = F.regexp_replace(piece, rf"(?<![\w.]){word}(?!\w)", value)
        return F.regexp_replace(piece, r",(\s*+[\]}])", "$1")

    pieces = F.regexp_extract_all(literal, F.lit(_PIECES), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("\\A['\"]"), p).otherwise(plain(p))), "")


def list_items(raw: Column) -> Column:
    """The list in a response, from the first ``[`` to the last ``]``: JSON, or a Python literal with single quotes,
    ``True``, ``False``, ``None`` and closing commas.  Null when neither reads it; constants are items as JSON spells them."""
    text = strip(raw)
    part = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    part = F.when(part != "", part).otherwise(text)
    strict = _only(F.from_json(_wrapped(part), "array<array<string>>", _STRICT))
    lenient = _only(F.from_json(_wrapped(as_json(part)), "array<array<string>>", _LITERAL))
    return F.coalesce(strict, lenient)
