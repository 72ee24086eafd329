"""Column helpers for Python-like string semantics in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in text (Java's own classes differ from them).
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NO_STRINGS = "array<string>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; written out, an expression is computed anew wherever lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))  # looks at the ends only


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def strings() -> Column:
    """An empty array of strings."""
    return F.array().cast(NO_STRINGS)
