"""Spelling variants: words one letter apart, found by probing Bloom filters of the vocabulary with generated edits.

The vocabulary is counted from the texts. Its words, sharded by length, fill blocked Bloom filters (512-bit blocks, one bit
in each of eight lanes, 16 bits a word). They are broadcast in rounds of at most ``ROUND_BYTES``, a proven bound however
large the vocabulary is: a round holds some lengths, or some blocks of one. In each round all words probe their edits, whose
hashes follow from the word's own in a few operations: every deletion in the shard one letter shorter, and every
replacement by a later letter of the alphabet in the same shard, so each near pair is generated once (an insertion is a
deletion seen from the longer word). Only edits that some filter holds are written out, and an exact join with the
vocabulary removes the false ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import blocks
from framewright.session import scratch_path

HELD_WORDS = 300_000  # distinct words that a task counts before it hands them on
PART_BYTES = 4 << 20  # of a long text that are searched for words at a time
LONG = 64  # lengths from here on share a shard
BITS = 16  # of a filter for each word
BLOCK_BYTES = 64
ROUND_BYTES = 32 << 20
PROBED = 1 << 18  # letters whose edits are generated at a time

# Fixed values of the contract: a word is a run of A-Z, a-z and U+00C0 to U+00FF, in UTF-8.
RUN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")
# The same letters after lower-casing A-Z, as their Latin-1 bytes.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint8)
_SURE_END = re.compile(rb"[^A-Za-z\x80-\xFF]")

_BACK = np.uint64(pow(int(blocks.STEP), -1, 1 << 64))
# Odd factors that turn a hash into the bits of a block, one for each lane.
_LANES = np.random.default_rng(7).integers(1, 1 << 31, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)

_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
_PROBES = pa.schema([("word", pa.string()), ("n", pa.int64()), ("edit", pa.string())])


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``PART_BYTES`` that no word crosses."""
    start = 0
    while len(text) - start > PART_BYTES and (end := _SURE_END.search(text, start + PART_BYTES)):
        yield text[start : end.end()]
        start = end.end()
    yield text[start:] if start else text


def _misspelt(run: bytes, seed: int, every: int) -> bytes:
    h = zlib.crc32(run, seed)
    if h % every:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, misspell_every: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n: lower-cased (A-Z) runs of letters with ``least_length`` code points and ``least_count`` occurrences or more.

    With ``misspell_every``, runs whose checksum with their document's key (a null key: the empty text) is a multiple lose one
    letter, at all places of that document alike: misspellings planted for measuring. A null text has no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], schema=_COUNTED)

        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text").cast(pa.large_binary())):
                seed = zlib.crc32(b"%s:" % (key.as_py() or "").encode())
                for part in _parts((text.as_py() or b"").lower()):
                    for run, times in Counter(RUN.findall(part)).items():
                        if misspell_every:
                            run = _misspelt(run, seed, misspell_every)
                        if len(run) - run.count(b"\xc3") >= least_length:
                            held[run] += times
                    if len(held) >= HELD_WORDS:
                        yield out()
                        held.clear()
        if held:
            yield out()

    columns = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    counted = columns.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


class _Letters:
    """Words as one row of Latin-1 letters; for every letter its word, its word's shard, and what an edit of it changes."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in raw], np.int64)
        self.letter = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(raw)), self.size)
        self.place = np.arange(len(self.letter)) - np.repeat(first, self.size)
        self.power = blocks.powers(int(self.size.max(initial=0)) + 2)[self.place + 1]
        values = blocks.BYTE_KEYS[self.letter] * self.power
        self.sums = np.add.reduceat(values, first) if len(raw) else values
        before = np.cumsum(values) - values
        self.before = before - before[first][self.word] if len(raw) else before
        self.values = values

    def shortened(self) -> tuple[np.ndarray, np.ndarray]:
        """Letters to delete (the first of each run of equal ones), and the hash of the word without it."""
        repeated = np.zeros(len(self.letter), bool)
        repeated[1:] = (self.letter[1:] == self.letter[:-1]) & (self.word[1:] == self.word[:-1])
        at = np.flatnonzero(~repeated)
        behind = self.sums[self.word[at]] - self.before[at] - self.values[at]
        return at, self.before[at] + behind * _BACK

    def replaced(self, by: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters that come before ``by`` in the alphabet, and the hash of the word with ``by`` in its place."""
        at = np.flatnonzero(self.letter < by)
        return at, self.sums[self.word[at]] + (blocks.BYTE_KEYS[by] - blocks.BYTE_KEYS[self.letter[at]]) * self.power[at]


def _mixed(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
    return blocks.scramble(sums + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _block(hashes: np.ndarray, blocks_of_shard: np.ndarray) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * blocks_of_shard.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def _bit(hashes: np.ndarray, lane: int) -> np.ndarray:
    return (((hashes & _LOW) * _LANES[lane]) & _LOW) >> np.uint64(26)


class Filters:
    """The blocks of some shards that one round holds; edits of other shards or blocks are left to other rounds."""

    def __init__(self, blocks_of_shard: dict[int, int], held: list[tuple[int, int, int]]):
        self.total = np.zeros(LONG + 1, np.int64)
        for shard, n in blocks_of_shard.items():
            self.total[shard] = n
        self.low, self.high, self.base = (np.zeros(LONG + 1, np.int64) for _ in range(3))
        size = 0
        for shard, low, high in held:
            self.low[shard], self.high[shard], self.base[shard] = low, high, size
            size += high - low
        self.lanes = np.zeros((size, 8), np.uint64)

    def fill(self, shard: np.ndarray, block: np.ndarray, lanes: np.ndarray) -> None:
        self.lanes[self.base[shard] + block - self.low[shard]] = lanes

    def has(self, sums: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the vocabulary."""
        shard = np.minimum(size, LONG)
        hashes = _mixed(sums, size)
        block = _block(hashes, self.total[shard])
        left = np.flatnonzero((block >= self.low[shard]) & (block < self.high[shard]))
        hashes, at = hashes[left], (self.base[shard] + block - self.low[shard])[left]
        for lane in range(8):
            hit = (self.lanes[at, lane] >> _bit(hashes, lane)) & np.uint64(1) == 1
            left, hashes, at = left[hit], hashes[hit], at[hit]
        return left


def rounds(blocks_of_shard: dict[int, int], most: int) -> list[list[tuple[int, int, int]]]:
    """Parts of shards (shard, first block, end block) in rounds of at most ``most`` blocks."""
    found, room = [[]], most
    for shard, n in sorted(blocks_of_shard.items()):
        low = 0
        while low < n:
            if room == 0 or (room < n <= most):  # a shard that fits a round is not torn
                found.append([])
                room = most
            high = min(n, low + room)
            found[-1].append((shard, low, high))
            room -= high - low
            low = high
    return [held for held in found if held]


def _shard_of(column: str = "word"):
    return F.least(F.length(column), F.lit(LONG)).cast("int")


def filter_blocks(words: DataFrame, blocks_of_shard: dict[int, int]) -> DataFrame:
    """shard, block, l0 to l7: the blocks of the filters that hold ``words``."""
    schema = "shard int, block long, " + ", ".join(f"l{i} long" for i in range(8))
    total = Filters(blocks_of_shard, []).total

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            letters = _Letters(batch.column("word").to_pylist())
            hashes, shard = _mixed(letters.sums, letters.size), np.minimum(letters.size, LONG)
            lanes = [(np.uint64(1) << _bit(hashes, lane)).view(np.int64) for lane in range(8)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), pa.array(_block(hashes, total[shard])), *map(pa.array, lanes)],
                names=["shard", "block", *(f"l{i}" for i in range(8))],
            )

    placed = words.select("word").mapInArrow(place, schema)
    return placed.groupBy("shard", "block").agg(*(F.bit_or(f"l{i}").alias(f"l{i}") for i in range(8)))


def _edits(words: list[str], counts: list[int], filters: Filters) -> pa.RecordBatch:
    letters = _Letters(words)
    source, edits = [], []
    at, sums = letters.shortened()
    for hit in at[filters.has(sums, letters.size[letters.word[at]] - 1)].tolist():
        word, place = int(letters.word[hit]), int(letters.place[hit])
        source.append(word)
        edits.append(words[word][:place] + words[word][place + 1 :])
    for by in ALPHABET.tolist():
        at, sums = letters.replaced(by)
        for hit in at[filters.has(sums, letters.size[letters.word[at]])].tolist():
            word, place = int(letters.word[hit]), int(letters.place[hit])
            source.append(word)
            edits.append(words[word][:place] + chr(by) + words[word][place + 1 :])
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in source], pa.string()), pa.array([counts[i] for i in source], pa.int64()), pa.array(edits, pa.string())], schema=_PROBES
    )


def _probed(words: DataFrame, filters) -> DataFrame:
    """word, n, edit: the edits of every word that the broadcast filters hold."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            ends = np.cumsum([len(w) for w in names])
            start = 0
            while start < len(names):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + PROBED, side="right")))
                yield _edits(names[start:stop], counts[start:stop], filters.value)
                start = stop

    return words.mapInArrow(probe, "word string, n long, edit string")


def near_pairs(words: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, n, other, other_n: every two words that differ by one letter inserted, deleted or replaced, once.

    ``words`` has word and n, and is read several times: hand over a written table. Runs a few jobs a round.
    """
    spark = words.sparkSession
    sizes = words.groupBy(_shard_of().alias("shard")).count().collect()  # a row for each of at most 64 lengths
    blocks_of_shard = {row["shard"]: -(-row["count"] * BITS // (8 * BLOCK_BYTES)) for row in sizes}
    path = scratch_path(spark)
    filter_blocks(words, blocks_of_shard).write.parquet(path)
    stored = spark.read.parquet(path)
    exact = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    found = words.select("word", "n", F.col("word").alias("edit")).limit(0)
    for held in rounds(blocks_of_shard, max(1, round_bytes // BLOCK_BYTES)):
        filters = Filters(blocks_of_shard, held)
        inside = F.lit(False)
        for shard, low, high in held:
            inside |= (F.col("shard") == shard) & (F.col("block") >= low) & (F.col("block") < high)
        table = stored.where(inside).toArrow()  # at most round_bytes of filter
        filters.fill(
            table.column("shard").to_numpy(), table.column("block").to_numpy(), np.stack([table.column(f"l{i}").to_numpy().view(np.uint64) for i in range(8)], axis=1)
        )
        out = scratch_path(spark)
        _probed(words, spark.sparkContext.broadcast(filters)).write.parquet(out)
        found = found.unionByName(spark.read.parquet(out))
    return found.join(exact, F.col("edit") == F.col("other")).select("word", "n", "other", "other_n")


def forms(words: DataFrame, ratio: int = 2, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, form, n, n_near, form_n: the most frequent near word, where it has ``ratio`` times the word's occurrences or more."""
    near = F.explode(F.array(F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    best = (
        near_pairs(words, round_bytes).select(near.alias("x")).select("x.*")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    )
    joined = words.join(best, "word", "left").withColumn("much", -F.col("best.less") >= ratio * F.col("n"))
    return joined.select(
        "word",
        F.when(F.col("much"), F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("much"), -F.col("best.less")).alias("form_n"),
    )


def _roots(links: DataFrame) -> DataFrame:
    """word, root: where following ``links`` (word, root) ends. Rounds double the steps; every link at least doubles a count, so they are few."""
    spark = links.sparkSession
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        path = scratch_path(spark)
        links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).write.parquet(path)
        links = spark.read.parquet(path)
        if not links.where("moved").limit(1).count():
            return links.drop("moved")
        links = links.drop("moved")


def group(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, misspell_every: int | None = None, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The spelling variants of the words of ``docs``: word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: the smallest in code-point order) if it has ``ratio`` times the word's n or
    more, else null; root is where following forms ends, the word itself if it has none. Null and empty texts have no words;
    rows that repeat count each time; other columns are not looked at; an empty table gives no rows. A word of any length
    keeps all its edits. Runs jobs: the vocabulary, the filters, the hits of every round and the links are written.
    """
    spark = docs.sparkSession
    path, formed = scratch_path(spark), scratch_path(spark)
    vocabulary(docs, least_length, least_count, misspell_every).write.parquet(path)
    forms(spark.read.parquet(path), ratio, round_bytes).write.parquet(formed)
    table = spark.read.parquet(formed)
    roots = _roots(table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
