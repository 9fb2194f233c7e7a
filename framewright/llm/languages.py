"""Language identification by rank-order profiles (out-of-place distance between lists of the most frequent n-grams).

Texts are lower-cased, everything but letters becomes a break, and n-grams of one to three characters are counted
inside words with a break on both sides. A profile lists a language's ``PROFILE`` most frequent n-grams by rank.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import blocks

PROFILE = 400
UNKNOWN = "und"
_BREAK = 1  # not a letter, and not 0: a leading break must count
_SIZES = (1, 2, 3)


@cache
def _letters() -> np.ndarray:
    """True for the code points of letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as 64-bit codes (21 bits a character, the break is 1), and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    letters = _letters()[codes]
    codes = np.where(letters, codes, np.uint64(_BREAK))
    # One break between words, and one on each side.
    keep = letters | np.concatenate([[False], letters[:-1]])
    codes = np.concatenate([[np.uint64(_BREAK)], codes[keep], [np.uint64(_BREAK)]])
    if not letters.any():
        return codes[:0], np.zeros(0, np.int64)
    inner = codes != _BREAK
    made = [codes[inner]]
    for n in _SIZES[1:]:
        runs = codes[: len(codes) - n + 1].copy()
        whole = np.ones(len(runs), bool)
        for i in range(1, n):
            runs = (runs << np.uint64(21)) | codes[i : i + len(runs)]
            if i < n - 1:
                whole &= inner[i : i + len(whole)]  # a break only at the ends
        if n == 2:  # needs a letter on one side
            whole &= inner[:-1] | inner[1:]
        made.append(runs[whole])
    return np.unique(np.concatenate(made), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first; ties in the order of their codes."""
    if len(codes) > size:
        limit = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= limit
        codes, counts = codes[near], counts[near]
    return codes[np.lexsort((codes, -counts))][:size]


def train(labelled: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """A profile per value of ``lang`` from all rows of ``labelled`` (text, lang); null texts and languages are passed over.

    Counts are added up in the tasks first, then by Spark. What comes to the driver is ``size`` n-grams a language.
    """

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for rows, texts in blocks.slices(batches, "text"):
            langs = rows.column("lang").to_pylist()
            for lang in sorted({x for x in langs if x is not None}):
                own = [t for t, x in zip(texts.to_pylist(), langs, strict=True) if x == lang]
                codes, counts = grams("\n".join(own))
                into = total.setdefault(lang, {})
                for code, n in zip(codes.tolist(), counts.tolist(), strict=True):
                    into[code] = into.get(code, 0) + n
        for lang, into in total.items():
            codes = np.fromiter(into, np.int64, len(into))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(into)), pa.array(codes), pa.array(list(into.values()), pa.int64())], names=["lang", "gram", "n"]
            )

    sums = labelled.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    sums = sums.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = sums.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Profiles:
    """Profiles as one sorted table of n-grams, with a rank for each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs = sorted(profiles)
        self.size = size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.uint64))
        self.rank = np.full((len(self.codes), max(1, len(self.langs))), -1)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, np.array(profiles[lang], np.uint64)), k] = np.arange(len(profiles[lang]))

    def distances(self, grams_in_order: np.ndarray) -> np.ndarray:
        """Out-of-place distance to every language; an n-gram that a profile lacks costs ``size``."""
        n = len(grams_in_order)
        place = np.minimum(np.searchsorted(self.codes, grams_in_order), len(self.codes) - 1)
        found = self.codes[place] == grams_in_order
        rank = np.where(found[:, None], self.rank[place], -1)
        return np.where(rank >= 0, np.abs(rank - np.arange(n)[:, None]), self.size).sum(axis=0)

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and its lead over the next, 0 to 1."""
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        away = self.distances(own)
        best = int(np.argmin(away))
        if len(self.langs) == 1:
            return self.langs[0], float(1 - away[0] / (self.size * len(own)))
        second = float(np.min(np.delete(away, best)))
        return self.langs[best], (second - float(away[best])) / second if second else 0.0


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text).

    A text that is null or has no letter is ``und`` with score 0, and so is every text where no profile was learned.
    Rows are judged one by one: repeated rows give equal rows, no rows give none, other columns are not read.
    """
    table = Profiles(profiles, size)

    def work(rows: pa.RecordBatch, texts: pa.LargeStringArray) -> dict:
        found = [table.predict(t) for t in texts.to_pylist()]
        return {"doc_id": rows.column("doc_id"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return blocks.mapped(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double", work)
