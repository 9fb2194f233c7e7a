"""Records of CSV files whose cells hold line breaks, read by many tasks per file.

Spark deals a file out in byte ranges that end at line ends, whether or not a quote is open there. The ranges are read
twice. First every range tells how many quotes it has (so in which state it leaves for either state it starts in) and
whether a record begins in it. A prefix pass over these rows, one per range, gives each its state. Then every range
glues its lines to records; what begins before a range or goes on behind it is a fragment, at most two a range, and the
fragments of a record are brought together by the range it began in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RANGES = pa.schema([("file", pa.string()), ("at", pa.int64()), ("odd", pa.bool_()), ("begins_outside", pa.bool_()), ("begins_inside", pa.bool_())])
_GLUED = pa.schema(
    [("file", pa.string()), ("at", pa.int64()), ("owner", pa.int64()), ("whole", pa.bool_()), ("head", pa.bool_()), ("text", pa.string())]
)
_RANGES_DDL = "file string, at long, odd boolean, begins_outside boolean, begins_inside boolean"
_GLUED_DDL = "file string, at long, owner long, whole boolean, head boolean, text string"


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines in their ranges: only line feeds end them, so that a carriage return inside a cell stays."""
    read = spark.read.text(path, lineSep="\n")
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def _by_range(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of one range each; ranges of a task follow one another."""
    if batch.num_rows == 0:
        return
    at, file = batch.column("at"), batch.column("file")
    change = pc.or_(pc.not_equal(at.slice(1), at.slice(0, len(at) - 1)), pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)))
    cuts = [0, *(np.flatnonzero(change.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def _inside(lines: pa.Array, quote: str, before: int) -> np.ndarray:
    """For every line and the end: 1 if a quote is open before it."""
    quotes = pc.count_substring(lines, quote).to_numpy(zero_copy_only=False).astype(np.int64)
    return (np.concatenate([[0], np.cumsum(quotes)]) + before) & 1


def _summarised(batches: Iterator[pa.RecordBatch], quote: str) -> Iterator[pa.RecordBatch]:
    here, odd, begins = None, 0, [False, False]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*here, bool(odd), *begins], _RANGES)], schema=_RANGES)

    for batch in batches:
        for rows in _by_range(batch):
            named = (rows.column("file")[0].as_py(), rows.column("at")[0].as_py())
            if named != here:
                if here is not None:
                    yield out()
                here, odd, begins = named, 0, [False, False]
            inside = _inside(rows.column("value"), quote, odd)
            # A line begins a record if the range started outside and an even number of quotes went by, or the other way round.
            begins = [begins[0] or bool((inside[:-1] == 0).any()), begins[1] or bool((inside[:-1] == 1).any())]
            odd = int(inside[-1])
    if here is not None:
        yield out()


def _states(lines: DataFrame, quote: str) -> DataFrame:
    """file, at, open (a quote is open where the range starts), owner (the range in which that record began). A row per range."""
    ranges = lines.mapInArrow(lambda batches: _summarised(batches, quote), _RANGES_DDL)
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stated = ranges.withColumn("open", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    begins = F.when(F.col("open"), F.col("begins_inside")).otherwise(F.col("begins_outside"))
    return stated.withColumn("begin", F.when(begins, F.col("at"))).select("file", "at", "open", F.last("begin", ignorenulls=True).over(before).alias("owner"))


def _glued(batches: Iterator[pa.RecordBatch], quote: str) -> Iterator[pa.RecordBatch]:
    """Records that lie in one range, and fragments of others with the range that owns them."""
    here, held, goes_on, odd, headed = None, [], False, 0, False

    def out(texts: pa.Array, owner: int | None, whole: bool, heads: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(texts)
        heads = np.zeros(n, bool) if heads is None else heads
        columns = [[here[0]] * n, [here[1]] * n, [owner] * n, [whole] * n, heads, texts]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _GLUED)], schema=_GLUED)

    def fragment() -> pa.RecordBatch:
        return out(pa.array(["\n".join(held)]), before if goes_on else here[1], False, np.array([not goes_on and not headed and here[1] == 0]))

    before = None
    for batch in batches:
        for rows in _by_range(batch):
            named = (rows.column("file")[0].as_py(), rows.column("at")[0].as_py())
            if named != here:
                if held:
                    yield fragment()
                here, held, headed = named, [], False
                goes_on, before = rows.column("open")[0].as_py(), rows.column("owner")[0].as_py()
                odd = int(goes_on)
            lines = rows.column("value")
            inside = _inside(lines, quote, odd)
            first = np.flatnonzero(inside[:-1] == 0)  # lines that begin a record
            lead = int(first[0]) if len(first) else len(lines)
            if lead:  # the rest of a record from before this batch
                held.extend(lines.slice(0, lead).to_pylist())
            if len(first):
                if held:
                    if goes_on:
                        yield fragment()
                    else:
                        yield out(pa.array(["\n".join(held)]), here[1], True, np.array([not headed and here[1] == 0]))
                        headed = True
                    held, goes_on = [], False
                stop = len(lines) if inside[-1] == 0 else int(first[-1])
                begins = first if inside[-1] == 0 else first[:-1]
                if len(begins):
                    some = lines.slice(0, stop)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(begins, stop).astype(np.int32)), some)
                    texts = pc.binary_join(lists, "\n")
                    filled = pc.invert(pc.is_in(texts, value_set=pa.array(["", "\r"]))).to_numpy(zero_copy_only=False)
                    texts = texts.filter(pa.array(filled))
                    heads = np.zeros(len(texts), bool)
                    if len(texts) and not headed:
                        heads[0], headed = here[1] == 0, True
                    yield out(texts, here[1], True, heads)
                if inside[-1]:
                    held = lines.slice(stop).to_pylist()
            odd = int(inside[-1])
    if held:
        yield fragment()


def records(spark: SparkSession, path, quote: str = '"') -> DataFrame:
    """The records of CSV files as text, without the first of every file: ``text``.

    A record ends at a line feed (or carriage return and line feed) outside quotes; blank lines are no records. A file that ends inside
    quotes ends its last record there. Files are split like text files; one row per byte range is broadcast (for a range of
    128 MB, some 8,000 for each terabyte). A record may be longer than a range: it comes together in one task, as a row must.
    """
    lines = _lines(spark, path)
    stated = lines.join(F.broadcast(_states(lines, quote)), ["file", "at"])
    glued = stated.select("file", "at", "open", "owner", "value").mapInArrow(lambda batches: _glued(batches, quote), _GLUED_DDL)
    whole = glued.where("whole and not head").select("text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"])
    torn = (
        glued.where("not whole").groupBy("file", "owner").agg(F.array_join(parts, "\n").alias("text"), F.max("head").alias("head"))
        .where("not head").select("text")
    )
    return whole.unionByName(torn).select(F.regexp_replace("text", "\r$", "").alias("text"))
