"""Phrases that occur together more often than their parts would by chance, counted by sorting suffixes.

A suffix is a word and up to ``longest - 1`` words behind it in its piece. Every suffix is dealt to a bucket by its leading
words, and in a bucket a three-way quicksort by words parts the pointers to the suffixes: what equals the pivot is a
phrase, the size of that partition its count, and it is sorted on by the next word. Partitions with too few suffixes
are abandoned, since all suffixes with the same leading words are in the same bucket.

The leading words are two. Where both are hot (more than ``capacity`` occurrences), the third leads too, and so on, so that
at most ``capacity`` suffixes share the words that deal them, or they are equal, and equal suffixes of a task travel as
one with a weight. Phrases of hot words shorter than what dealt them are counted in parts, which are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import blocks
from framewright.session import scratch_path

BUCKETS = 256  # at least, so that a slice of a small table is dealt out as that of a large one
HOT_WORDS = 65_536  # more words cannot be hot: each has over 1 / HOT_WORDS of all occurrences
UNKNOWN = "und"

# Fixed values of the contract: what ends a piece, and what parts words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
OUTSIDE = BREAK.copy()
OUTSIDE[[0x20, 0x09]] = True

_COUNTED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_DEALT = pa.schema(
    [("bucket", pa.int64()), ("lang", pa.string()), ("led_by", pa.int32()), ("words", pa.binary()), ("suffixes", pa.binary()), ("weights", pa.binary())]
)
_FOUND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])
_FOUND_DDL = "lang string, phrase string, size int, n long"


class _Words:
    """The words of a slice of texts: their bytes, a number for each distinct word, its text's language and its piece."""

    def __init__(self, langs: pa.Array, texts: pa.LargeStringArray):
        body, offsets = blocks.raw(texts)
        self.body = blocks.LOWER[body]
        start, end, row = blocks.words(self.body, offsets, OUTSIDE)
        encoded = pc.fill_null(langs.cast(pa.string()), UNKNOWN).dictionary_encode()
        self.langs = encoded.dictionary.to_pylist()
        self.lang = encoded.indices.to_numpy(zero_copy_only=False)[row]
        breaks = np.concatenate([[0], np.cumsum(BREAK[self.body], dtype=np.int64)])
        new = np.ones(len(start), bool)
        new[1:] = (row[1:] != row[:-1]) | (breaks[start[1:]] > breaks[end[:-1]])
        self.piece = np.cumsum(new, dtype=np.int32)
        known = pa.array(blocks.word_hashes(self.body, start, end)).dictionary_encode()
        self.hashes, self.word = known.dictionary.to_numpy(), known.indices.to_numpy()
        first = np.zeros(len(self.hashes), np.int64)
        first[self.word[::-1]] = np.arange(len(self.word) - 1, -1, -1)
        self._start, self._size = start[first], end[first] - start[first]

    def names(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the words of these numbers, each with a line end behind, and their sizes with it."""
        size = self._size[numbers] + 1
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self._start[numbers] - (ends - size), size)
        joined = self.body[np.minimum(place, len(self.body) - 1)]
        joined[ends - 1] = 10
        return joined, size


def _split(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of words that each have a line end behind."""
    end = np.flatnonzero(joined == 10)
    return np.concatenate([[0], end[:-1] + 1]), end


def _columns(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: all occurrences of every word. ``docs`` has lang and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks.slices(batches, "text"):
            words = _Words(rows.column("lang"), texts)
            width = len(words.hashes)
            times = np.bincount(words.lang.astype(np.int64) * width + words.word)
            codes = np.flatnonzero(times)
            if len(codes) == 0:
                continue
            joined, size = words.names(codes % width)
            inside = np.ones(len(joined), bool)
            inside[np.cumsum(size) - 1] = False
            offsets = np.concatenate([[0], np.cumsum(size - 1)]).astype(np.int32)
            names = pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(joined[inside]))
            langs = pa.array(words.langs, pa.string()).take(pa.array(codes // width))
            yield pa.RecordBatch.from_arrays([langs, names, pa.array(times[codes])], schema=_COUNTED)

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hot_hashes(hot: list) -> dict[str, np.ndarray]:
    found: dict[str, list[bytes]] = {}
    for row in hot:
        found.setdefault(row["lang"], []).append(row["word"].encode())
    hashed = {}
    for lang, words in found.items():
        ends = np.cumsum([len(w) for w in words])
        hashed[lang] = blocks.word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    return hashed


def _numbered(suffix: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from 1 on that occur, and the suffixes with their places in that list, counted from 1; 0 stays 0."""
    if suffix.size * 8 > words:
        seen = np.zeros(words, bool)
        seen[suffix] = True
        seen[0] = False
        return np.flatnonzero(seen), np.cumsum(seen)[suffix] * (suffix > 0)
    used, local = np.unique(suffix, return_inverse=True)
    return (used[1:], local) if used[0] == 0 else (used, local + 1)


def _suffixes(docs: DataFrame, longest: int, hot: list, buckets: int) -> DataFrame:
    """Suffixes of two words or more in blocks: one row for the suffixes of a slice that go to one bucket."""
    hot_hashes = _hot_hashes(hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks.slices(batches, "text"):
            words = _Words(rows.column("lang"), texts)
            n = len(words.word)
            kept = np.flatnonzero(np.concatenate([words.piece[1:] == words.piece[:-1], [False]])) if n else np.zeros(0, np.int64)
            if len(kept) == 0:
                continue
            # Word numbers from 1 on; 0 stands where the piece has ended.
            number = np.concatenate([words.word + np.int32(1), np.zeros(longest, np.int32)])
            piece = np.concatenate([words.piece, np.full(longest, -1, np.int32)])
            suffix = np.stack([np.where(piece[kept + d] == piece[kept], number[kept + d], 0) for d in range(longest)])
            hashes = np.concatenate([np.zeros(1, np.uint64), words.hashes])
            lang = words.lang[kept]
            is_hot = np.zeros((len(words.langs), len(hashes)), bool)
            for code, name in enumerate(words.langs):
                if name in hot_hashes:
                    is_hot[code] = np.isin(hashes, hot_hashes[name])
            ends = np.cumsum([len(x.encode()) for x in words.langs])
            names = np.frombuffer("".join(words.langs).encode() or b"\0", np.uint8)
            lead = blocks.word_hashes(names, np.concatenate([[0], ends[:-1]]), ends)[lang]
            led_by = np.full(len(kept), 2, np.int32)
            more = np.ones(len(kept), bool)
            whole = lead
            for d in range(longest):
                step = hashes[suffix[d]]
                whole = blocks.scramble(whole * blocks.STEP + step)
                lead = np.where(more, whole, lead) if d >= 1 else lead
                led_by[more] = max(d + 1, 2)
                more &= is_hot[lang, suffix[d]] if d >= 1 else True
                if d == 1:
                    more &= is_hot[lang, suffix[0]]
            bucket = (lead % np.uint64(buckets)).astype(np.int64)
            # Equal suffixes become one: neighbours in the order of their hashes, if all their words are equal.
            order = np.argsort(whole, kind="stable")
            sorted_suffix, sorted_lang = suffix[:, order], lang[order]
            new = np.ones(len(order), bool)
            new[1:] = (sorted_suffix[:, 1:] != sorted_suffix[:, :-1]).any(axis=0) | (sorted_lang[1:] != sorted_lang[:-1])
            first = np.flatnonzero(new)
            weight = np.diff(np.append(first, len(order)))
            at = order[first]
            key = (bucket[at] * len(words.langs) + lang[at]) * (longest + 1) + led_by[at]
            by_key = np.argsort(key, kind="stable")
            key, at, weight = key[by_key], at[by_key], weight[by_key]
            edges = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] - 1)), len(key))
            out = {name: [] for name in _DEALT.names}
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                some = at[a:b]
                used, local = _numbered(suffix[:, some], len(hashes))
                out["bucket"].append(int(bucket[some[0]]))
                out["lang"].append(words.langs[lang[some[0]]])
                out["led_by"].append(int(led_by[some[0]]))
                out["words"].append(words.names(used - 1)[0].tobytes())
                out["suffixes"].append(local.astype("<u2" if len(used) < 65_536 else "<u4").tobytes())
                out["weights"].append(b"" if weight[a:b].max() == 1 else weight[a:b].astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=_DEALT)

    return docs.mapInArrow(deal, "bucket long, lang string, led_by int, words binary, suffixes binary, weights binary")


def phrases(columns: list[np.ndarray], weights: np.ndarray, least: int, led_by: int) -> Iterator[tuple[int, int, int]]:
    """(pointer, words, count) of every phrase of two words or more with ``least`` suffixes, by three-way quicksort.

    ``columns[d]`` has word d of every suffix, 0 behind its end; the phrase is the first ``words`` words of the suffix
    at the pointer. Phrases shorter than ``led_by`` are counted however rare: other buckets may have more of them.
    """
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        pointers, depth = stack.pop()
        least_here = least if led_by <= max(depth + 1, 2) else 1
        key = columns[depth][pointers]
        pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
        below, above = key < pivot, key > pivot
        same = pointers[~(below | above)]
        count = int(weights[same].sum())
        if pivot and count >= least_here:
            if depth >= 1:
                yield int(same[0]), depth + 1, count
            if depth + 1 < len(columns):
                stack.append((same, depth + 1))
        for side in (below, above):
            rest = pointers[side]
            if len(rest) and weights[rest].sum() >= least_here:
                stack.append((rest, depth))


def _mined(table: pa.Table, longest: int, least: int) -> pa.Table:
    """The phrases of one bucket."""
    out = {name: [] for name in _FOUND.names}
    groups: dict[tuple[str, int], list] = {}
    for row in table.select(["lang", "led_by", "words", "suffixes", "weights"]).to_batches():
        for lang, led_by, words, suffixes, weights in zip(*(row.column(c) for c in row.schema.names)):
            groups.setdefault((lang.as_py(), led_by.as_py()), []).append((words.as_py(), suffixes.as_buffer(), weights.as_buffer()))
    for (lang, led_by), parts in groups.items():
        joined = np.frombuffer(b"".join(words for words, _, _ in parts), np.uint8)
        start, end = _split(joined)
        known = pa.array(blocks.word_hashes(joined, start, end)).dictionary_encode()
        number = known.indices.to_numpy() + np.int32(1)
        first = np.zeros(len(known.dictionary) + 1, np.int64)
        first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
        found, counted, before = [], [], 0
        for words, suffixes, weights in parts:
            size = words.count(b"\n")
            lookup = np.concatenate([np.zeros(1, np.int32), number[before : before + size]])
            suffix = lookup[np.frombuffer(suffixes, "<u2" if size < 65_536 else "<u4").reshape(longest, -1)]
            before += size
            found.append(suffix)
            counted.append(np.frombuffer(weights, "<u4").astype(np.int64) if weights.size else np.ones(suffix.shape[1], np.int64))
        columns = np.concatenate(found, axis=1)
        del found, parts
        for pointer, size, n in phrases(list(columns), np.concatenate(counted), least, led_by):
            out["lang"].append(lang)
            at = first[columns[:size, pointer]].tolist()
            out["phrase"].append(b" ".join([joined[start[i] : end[i]].tobytes() for i in at]).decode())
            out["size"].append(size)
            out["n"].append(n)
    return pa.Table.from_pydict(out, schema=_FOUND)


def mine(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text: str = "text", lang: str = "lang", capacity: int = 2_000_000
) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split into pieces and words by the fixed byte classes of this module; a null text has no
    words, a null lang is ``und``. a counts the phrase (at least ``least``), l and r the parts of its weakest cut, n the
    words of the language; score is floor(1000 a n / (l r)). A phrase inside a longer one of the same count is dropped.
    Other columns of ``docs``, whatever their names, are not looked at; repeated rows count each time; an empty table, or texts
    of single words, give no rows. Equal scores stand by a, then by the phrase's bytes.

    Runs jobs: words are counted and phrases mined, and both are written. ``capacity`` is about the most suffixes of a
    bucket, which one task sorts.
    """
    spark, docs = docs.sparkSession, _columns(docs, text, lang)
    words_path, phrases_path = scratch_path(spark), scratch_path(spark)
    word_counts(docs).write.parquet(words_path)
    words = spark.read.parquet(words_path)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = words.where(F.col("n") > max(capacity, total // HOT_WORDS)).select("lang", "word").collect()
    dealt = _suffixes(docs, longest, hot, max(BUCKETS, -(-total // capacity)))
    found = dealt.groupBy("bucket").applyInArrow(lambda table: _mined(table, longest, least), _FOUND_DDL)
    (
        found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a"))
        .where(F.col("a") >= least)
        .write.parquet(phrases_path)
    )
    return best(spark.read.parquet(phrases_path), words, top)


def best(found: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """Score the cuts of phrases (lang, phrase, size, a), drop those inside longer ones, and rank: the rows of ``mine``."""
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("times")).unionByName(
        words.select("lang", F.col("word").alias("part"), F.col("n").alias("times"))
    )
    cuts = (
        found.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        .withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
        .withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
        .join(counts.select("lang", F.col("part").alias("head"), F.col("times").alias("l")), ["lang", "head"])
        .join(counts.select("lang", F.col("part").alias("tail"), F.col("times").alias("r")), ["lang", "tail"])
    )
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))

    def wide(column: str) -> str:
        return f"cast({column} as decimal(18, 0))"

    scored = (
        cuts.join(totals, "lang")
        .withColumn("score", F.expr(f"({wide('1000 * a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
        .select("lang", "phrase", "cut.*")
    )
    # A longer phrase of the same count need only be one word longer: counts never rise with more words.
    longer = found.where("size > 2").select(
        "lang",
        "a",
        F.explode(
            F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))
        ).alias("phrase"),
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    kept = scored.join(longer, ["lang", "phrase", "a"], "left_anti").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    # First the best of each of 64 parts of a language, so that no task ranks a whole language.
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
