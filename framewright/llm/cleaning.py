"""Quality rules, line first: lines that break a rule go, then documents that lost too much go.

A line's verdict depends on the line alone, so equal lines share it; a document's verdict depends on the share of its
word characters that stood in removed lines, and on two base rules over the whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from framewright.llm import blocks

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
TERMINAL = (".", "!", "?", "…", '"', "'", ")", "]", "”", "’", "»", ":", ";")
# Phrases of page furniture, looked for in the lower-cased line.
BOILERPLATE = (
    "accept cookies", "cookie policy", "cookie settings", "use of cookies", "terms of use", "terms of service",
    "privacy policy", "all rights reserved", "enable javascript", "javascript is disabled", "lorem ipsum", "click here",
    "sign in", "sign up", "log in", "subscribe to", "newsletter", "share this", "read more", "skip to content", "back to top",
)
_FURNITURE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_SEPARATORS = re.compile(r"[|»›•]|::")


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the verdict; percentages are whole numbers."""

    min_words: int = 50
    max_repeat_percent: int = 50  # of words in repeated three-word windows
    separator_percent: int = 25  # separators per words: navigation
    symbol_percent: int = 20  # symbols per words
    shout_words: int = 4  # lines of at least so many words ...
    shout_percent: int = 70  # ... with so many capitals among their letters
    max_lost_percent: int = 55  # of word characters in removed lines


def line_fault(line: str, words: list[bytes], rules: Rules) -> str:
    """The first rule that a line with words breaks, or an empty text: navigation, symbols, capitals, boilerplate, punctuation."""
    n = len(words)
    if 100 * len(_SEPARATORS.findall(line)) > rules.separator_percent * n:
        return "navigation"
    marks = sum(map(line.count, "#*$%&|<>"))
    if 100 * marks > rules.symbol_percent * n:
        return "symbols"
    if n >= rules.shout_words and not line.islower():
        upper = sum(map(str.isupper, line))
        if 100 * upper > rules.shout_percent * sum(map(str.isalpha, line)):
            return "capitals"
    if _FURNITURE.search(line.lower()):
        return "boilerplate"
    if not line.rstrip(" \t\x0b\x0c\r").endswith(TERMINAL):
        return "punctuation"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice in the text, the first one included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, again = set(), set()
    for window in windows:
        (again if window in seen else seen).add(window)
    covered, reach = 0, 0  # words before ``reach`` are counted
    for i, window in enumerate(windows):
        if window in again:
            covered += i + 3 - max(i, reach)
            reach = i + 3
    return covered


def judge(text: bytes, rules: Rules = Rules()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, clean text."""
    words = text.split()
    n_words = len(words)
    if not n_words:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, rules.min_words > 0, 0, ""
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    faults: dict[bytes, str] = {}
    word_chars = lost = dup_lines = 0
    clean = []
    for raw in text.split(b"\n"):
        own = raw.split()
        if not own:
            continue
        chars = len(b"".join(own).decode())
        word_chars += chars
        if raw in faults:
            dup_lines += 1
        else:
            faults[raw] = line_fault(raw.decode(), own, rules)
        if faults[raw]:
            lost += chars
        else:
            clean.append(raw)
    repeat = repeated_words(words)
    failed = n_words < rules.min_words or 100 * repeat > rules.max_repeat_percent * n_words
    return n_words, word_chars, n_symbols, dup_lines, repeat, failed, lost, b"\n".join(clean).decode()


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, lost_chars long, kept boolean, clean_text string"
)


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row per document: its counts, ``base_failed``, ``lost_chars`` (word characters in removed lines), ``kept``, ``clean_text``.

    A null or empty text has no words and fails the base. Rows are judged one by one: repeated rows give equal rows,
    no rows give none, other columns are not read.
    """

    def work(rows: pa.RecordBatch, texts: pa.LargeStringArray) -> dict:
        body, bounds = blocks.raw(texts)
        whole, ends = body.tobytes(), bounds.tolist()
        made = [judge(whole[a:b], rules) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        columns = list(zip(*made, strict=True)) if made else [[] for _ in range(8)]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "clean_text"]
        kept = [not m[5] and 100 * m[6] <= rules.max_lost_percent * m[1] for m in made]
        return {"doc_id": rows.column("doc_id"), "kept": kept, **dict(zip(names, columns, strict=True))}

    return blocks.mapped(docs.select("doc_id", "text"), SCHEMA, work)
