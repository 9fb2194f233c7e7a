"""Text rules as Column builders."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word, a line end and a number.
WORD = r"[\p{L}\p{N}_']+"
LINE_END = r"\R|[\x1c-\x1e]"
LINE_END_CHARACTERS = list("\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029")
NUMBER = r"-?\p{Nd}+(?:\.\p{Nd}+)?"
FENCED_BLOCK = r"(?s)```[^\n]*\n(.*?)```"
BLANK = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


# The decimal digits of all scripts, and the ASCII digit of each, from the character database.
_DIGITS = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_VALUES = [str(unicodedata.digit(c)) for c in _DIGITS]


def words(text: Column) -> Column:
    """All words of a text, accents included."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    """All lines of a text; a line end at the very end opens no further line."""
    closed = (
        F.when(text.endswith("\r\n"), F.left(text, F.length(text) - 2))
        .when(F.right(text, F.lit(1)).isin(LINE_END_CHARACTERS), F.left(text, F.length(text) - 1))
        .otherwise(text)
    )
    return F.when(text != "", F.split(closed, LINE_END)).when(text == "", F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    """Text without white space at both ends."""
    return F.btrim(text, F.lit(BLANK))


def split_on(text: Column, separator: str) -> Column:
    """Parts of a text between literal separators."""
    return F.split(text, re.escape(separator), -1)


def slice_text(text: Column, start: int | None, stop: int | None) -> Column:
    """Characters ``start`` to ``stop`` (excluded); negative positions count from the end, None is an open end."""
    size = F.length(text)
    start = 0 if start is None else start
    if stop is None:
        first = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
        return F.substring(text, first + 1, size)

    def position(p: int) -> Column:
        if p >= 0:
            return F.least(F.lit(p), size)
        return F.greatest(size + p, F.lit(0))

    if 0 <= start <= stop:
        return F.substring(text, start + 1, stop - start)
    first, last = position(start), position(stop)
    return F.substring(text, first + 1, F.greatest(last - first, F.lit(0)))


def numbers(text: Column) -> Column:
    """All numbers in a text, as doubles."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.when(x.rlike("[^ -~]"), ascii_digits(x)).otherwise(x).cast("double"))


def ascii_digits(text: Column) -> Column:
    """Digits of other scripts as 0 to 9."""
    return F.translate(text, "".join(_DIGITS), "".join(_VALUES))


def masked(text: Column) -> Column:
    """A stripped text with every number replaced by ``#``."""
    return F.regexp_replace(strip(text), NUMBER, "#")


def non_blank_lines(text: Column) -> Column:
    """All lines with anything but white space in them."""
    return F.filter(F.split(text, LINE_END), lambda line: strip(line) != "")


def same_line(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Same text once numbers are masked, and every pair of numbers nearer than ``tolerance``.

    The shorter list of numbers is filled up with nulls, and null is near to nothing.
    """
    near = F.zip_with(numbers(a), numbers(b), lambda x, y: F.coalesce(F.abs(x - y) < tolerance, F.lit(False)))
    return (a == b) | ((masked(a) == masked(b)) & F.forall(near, lambda ok: ok))


def same_output(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Line-by-line match of two outputs; blank lines do not count."""

    def match(x: Column, y: Column) -> Column:
        return F.coalesce(same_line(x, y, tolerance), F.lit(False))

    return F.forall(F.zip_with(non_blank_lines(a), non_blank_lines(b), match), lambda ok: ok)


def fenced_code(answer: Column) -> Column:
    """The first fenced block of an answer, or the whole answer, stripped."""
    found = F.regexp_extract_all(answer, F.lit(FENCED_BLOCK), F.lit(1))
    return strip(F.coalesce(F.get(found, F.lit(0)), answer))
