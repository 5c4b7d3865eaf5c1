"""Regular-expression dialect: rules are written as in browsers and turned into Java's syntax here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a browser's \s and trim() take as blank (fixed values).
BLANK = " \\t\\n\\x0B\\f\\r\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Marks put around matches; documents that hold one go to quarantine.
MARKS = "﷐﷑﷒"
CJK = "\\u4e00-\\u9fa5"


def java(pattern: str) -> str:
    """The pattern with \\s spelt out, both outside and inside character classes, and $ as absolute end."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            out.append((BLANK if inside else f"[{BLANK}]") if pair == "\\s" else pair)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "$" and not inside:
            c = "\\z"
        out.append(c)
        i += 1
    return "".join(out)


def trim(column: Column | str) -> Column:
    return F.btrim(column, F.lit(BLANKS))


def matches(column: Column | str, pattern: str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).rlike(java(pattern))


def extract(column: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(column, java(pattern), group)


def replace(column: Column | str, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(column, java(pattern), by)


def escaped(column: Column) -> Column:
    """The text as a literal pattern."""
    return F.regexp_replace(column, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")
