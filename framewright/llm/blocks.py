"""Texts of an Arrow batch as one byte array, and the word arithmetic done on it with numpy.

Spark deals the rows out; inside a task these helpers work on slices of a batch, so memory follows
``SLICE_BYTES`` or the longest single text, never a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

# Byte classes. White space is \x20 and \x09-\x0D; letters are ASCII letters and every byte of a longer character.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RANDOM = np.random.default_rng(20240611)
BYTE_KEYS = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd constant modulo 2^64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), STEP)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


def scramble(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def texts(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """A column of strings without nulls: null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "").cast(pa.large_string())


def raw(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and n + 1 offsets into them."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    whole = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.LargeStringArray]]:
    """Cut batches into runs of rows with about ``size`` bytes of text; a longer text stands alone."""
    for batch in batches:
        text = texts(batch.column(column))
        if batch.num_rows == 0:
            continue
        _, offsets = raw(text)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start), text.slice(start, stop - start)
            start = stop


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of True."""
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def words(body: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as start and end in ``body``, and the text each one is in. A word never crosses a text's end."""
    if len(body) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~outside[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    keep = inside[cuts[:-1]]
    start, end = cuts[:-1][keep], cuts[1:][keep]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from its bytes and their places in it."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    values = BYTE_KEYS[body[place + np.repeat(start, size)]] * powers(int(size.max()))[place]
    return scramble(np.add.reduceat(values, first) + size.astype(np.uint64))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` neighbouring values (``len - k + 1`` of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors, total = powers(k + 1), np.zeros(n, np.uint64)
    for i in range(k):
        total += hashes[i : i + n] * factors[i + 1]
    return scramble(total)


def mapped(df, schema: str, fn: Callable[[pa.RecordBatch, pa.LargeStringArray], dict], text: str = "text"):
    """Apply ``fn(rows, texts)`` to slices of every batch; it returns columns of ``schema`` by name."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, column in slices(batches, text):
            made = fn(rows, column)
            yield pa.RecordBatch.from_arrays([_column(made[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(work, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
