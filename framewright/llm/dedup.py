"""Exact duplicates by an index of live digests: cuckoo filters over bucketed keys.

The index is dealt into buckets by digest. Each bucket has a cuckoo filter and its stored keys (digest, size in bytes,
the copy that stays, number of copies). A digest that the filter has not seen is new without a look at the keys; a hit
is verified against the keys. Deleting the last copy takes the digest out of the filter. A filter that overflows is
built again, twice as large, from the stored keys. Copies are folded within each task before they are dealt, so a
text that a third of all rows share sends one row per task to its bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import blocks
from framewright.llm.rows import content, stay
from framewright.session import scratch_path

BUCKET_KEYS = 20_000  # digests that a bucket is meant for; the number of buckets follows the number of rows
SLOTS, KICKS, LOAD = 4, 200, 0.9
_LOCAL_BITS = 33


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; every digest has two buckets."""

    def __init__(self, expected: int):
        size = 1
        while size * SLOTS * LOAD < expected:
            size *= 2
        self.mask = size - 1
        self.slots: list[list[int]] = [[] for _ in range(size)]
        self._turn = 0

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = self._print(digest)
        first = int.from_bytes(digest[:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def __contains__(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        return mark in self.slots[first] or mark in self.slots[second]

    def add(self, digest: bytes) -> bool:
        """False if there is no room: the filter is then to be built anew (some other mark has been pushed out)."""
        mark, first, second = self._places(digest)
        for place in (first, second):
            if len(self.slots[place]) < SLOTS:
                self.slots[place].append(mark)
                return True
        place = second
        for _ in range(KICKS):
            self._turn = (self._turn + 1) % SLOTS
            mark, self.slots[place][self._turn] = self.slots[place][self._turn], mark
            place = self._other(place, mark)
            if len(self.slots[place]) < SLOTS:
                self.slots[place].append(mark)
                return True
        return False

    def remove(self, digest: bytes) -> None:
        mark, first, second = self._places(digest)
        for place in (first, second):
            if mark in self.slots[place]:
                self.slots[place].remove(mark)
                return


class Bucket:
    """One bucket of the index: a filter before stored keys."""

    def __init__(self, expected: int = 64):
        self.keys: dict[bytes, list] = {}  # digest: size in bytes, copy that stays, copies
        self.filter = CuckooFilter(expected)
        self.resized = 0

    def _grow(self) -> None:
        expected = 2 * max(len(self.keys), int(len(self.filter.slots) * SLOTS * LOAD))
        while True:
            self.filter, self.resized = CuckooFilter(expected), self.resized + 1
            if all(self.filter.add(d) for d in self.keys):
                return
            expected *= 2

    def insert(self, digest: bytes, size: int, row: tuple, copies: int = 1) -> None:
        if digest in self.filter:
            found = self.keys.get(digest)  # a hit may be another digest's mark
            if found is not None and found[0] == size:
                found[1] = max(found[1], row)
                found[2] += copies
                return
        self.keys[digest] = [size, row, copies]
        if not self.filter.add(digest):
            self._grow()

    def delete(self, digest: bytes, size: int, copies: int = 1) -> bool:
        """Take copies away; whether the digest is still live. A digest that is not there is passed over."""
        if digest not in self.filter:
            return False
        found = self.keys.get(digest)
        if found is None or found[0] != size:
            return False
        found[2] -= copies
        if found[2] > 0:
            return True
        del self.keys[digest]
        self.filter.remove(digest)
        return False


def digests(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, content (hash of the text), digest (sha256 of the text with A-Z lower-cased, null counts as empty), size.

    Written to the shared folder and read back, so the place of a row (task and number) stays what it is.
    """
    state = {"task": -1, "rows": 0}

    def work(rows: pa.RecordBatch, texts: pa.LargeStringArray) -> dict:
        task = TaskContext.get().partitionId()
        if state["task"] != task:
            state.update(task=task, rows=0)
        body, bounds = blocks.raw(texts)
        whole, ends = body.tobytes().lower(), bounds.tolist()  # bytes.lower() turns A-Z only
        first, n = state["rows"], len(ends) - 1
        state["rows"] += n
        return {
            "row_id": (np.int64(task) << _LOCAL_BITS) + first + np.arange(n),
            "doc_id": rows.column("doc_id"),
            "content": rows.column("content"),
            "digest": [hashlib.sha256(whole[a:b]).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)],
            "size": np.diff(bounds),
        }

    path = scratch_path(docs.sparkSession)
    made = blocks.mapped(
        docs.select("doc_id", "text", content().alias("content")), "row_id long, doc_id long, content long, digest binary, size long", work
    )
    made.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


_CHANGE = "bucket long, digest binary, size long, doc_id long, row_id long, copies long"
INDEX = _CHANGE + ", live boolean"
_INDEX_ARROW = pa.schema(
    [("bucket", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("doc_id", pa.int64()), ("row_id", pa.int64()),
     ("copies", pa.int64()), ("live", pa.bool_())]
)


def _folded(rows: DataFrame, buckets: int, sign: int) -> DataFrame:
    """Copies of one task as one change: the greatest (doc_id, row_id) and their number, with the sign of the change."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("digest", "size", "doc_id", "row_id"))
            for digest, size, doc_id, row_id in zip(*columns, strict=True):
                row = _order(doc_id, row_id)
                found = seen.setdefault((digest, size), [row, 0])
                found[0] = max(found[0], row)
                found[1] += sign
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int.from_bytes(d[16:24], "little") % buckets for d, _ in seen]),
                    pa.array([d for d, _ in seen], pa.binary()),
                    pa.array([s for _, s in seen], pa.int64()),
                    pa.array([r[1] if r[0] else None for r, _ in seen.values()], pa.int64()),
                    pa.array([r[2] for r, _ in seen.values()], pa.int64()),
                    pa.array([n for _, n in seen.values()], pa.int64()),
                ],
                names=["bucket", "digest", "size", "doc_id", "row_id", "copies"],
            )

    return rows.select("digest", "size", "doc_id", "row_id").mapInArrow(fold, _CHANGE)


def _order(doc_id, row_id) -> tuple:
    """Rows in the order of doc_id, a null below all, then of their place."""
    return (doc_id is not None, doc_id or 0, row_id)


def _bucket(table: pa.Table) -> pa.Table:
    """One bucket's keys after its changes; ``live`` is false where the copy that stayed was deleted."""
    columns = [table.column(c).to_pylist() for c in ("digest", "size", "doc_id", "row_id", "copies")]
    number = table.column("bucket")[0].as_py()
    index, gone = Bucket(len(columns[0])), set()
    rows = list(zip(*columns, strict=True))
    for digest, size, doc_id, row_id, copies in rows:
        if copies > 0:
            index.insert(digest, size, _order(doc_id, row_id), copies)
    for digest, size, doc_id, row_id, copies in rows:
        if copies < 0 and index.delete(digest, size, -copies) and _order(doc_id, row_id) >= index.keys[digest][1]:
            gone.add(digest)
    made = [(number, d, k[0], k[1][1] if k[1][0] else None, k[1][2], k[2], d not in gone) for d, k in index.keys.items()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True) if made else [[]] * 7, _INDEX_ARROW, strict=True)], schema=_INDEX_ARROW)


def build(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """The index of ``digests``: a row per live digest with the copy that stays (doc_id, row_id) and the number of copies."""
    if buckets is None:
        buckets = -(-rows.count() // BUCKET_KEYS) or 1
    return _folded(rows, buckets, 1).groupBy("bucket").applyInArrow(_bucket, INDEX)


def insert(index: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """The index after the rows were added. ``buckets`` is the number it was built with."""
    changes = index.drop("live").unionByName(_folded(rows, buckets, 1))
    return changes.groupBy("bucket").applyInArrow(_bucket, INDEX)


def delete(index: DataFrame, gone: DataFrame, left: DataFrame, buckets: int) -> DataFrame:
    """The index after the rows ``gone`` were deleted; ``left`` are the rows that stay (they name the next copy where
    the one that stayed is gone). Digests without copies leave the filters and the index."""
    changes = index.drop("live").unionByName(_folded(gone, buckets, -1))
    after = changes.groupBy("bucket").applyInArrow(_bucket, INDEX)
    heirs = left.groupBy("digest", "size").agg(F.max(F.struct("doc_id", "row_id")).alias("next"))
    named = after.join(heirs, ["digest", "size"], "left")
    stays = F.when(F.col("live"), F.struct("doc_id", "row_id")).otherwise(F.col("next"))
    return named.select(
        "bucket", "digest", "size", stays["doc_id"].alias("doc_id"), stays["row_id"].alias("row_id"), "copies", F.lit(True).alias("live")
    )


def mark(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, text): doc_id, row_id, content, keep_id, group_size, kept, digest.

    Of texts that are equal after lower-casing A-Z (null counts as empty) the row with the greatest doc_id stays; of
    repeated rows with that doc_id the last in the input; a null doc_id is below all. No rows give none.
    """
    rows = digests(docs)
    index = build(rows).select("digest", "size", F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"), F.col("copies").alias("group_size"))
    return rows.join(index, ["digest", "size"]).select(
        "doc_id", "row_id", "content", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "digest"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without exact copies, all columns: what ``mark`` keeps."""
    return stay(docs, mark(docs).where("kept").select("doc_id", "content"))
