"""Packing documents into training sequences by cutting-stock column generation.

Full blocks of a document are sequences of their own. What is left of each document (less than a sequence)
is an item of its length; the histogram of these lengths, at most ``capacity`` numbers, goes to the driver, where
a linear program over patterns of lengths is solved by column generation. Its rounded patterns become a small
table of ranks, which is joined to the documents ranked within their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm import blocks, cutting, tokens
from framewright.operators.order import with_position
from framewright.session import scratch_path

CAPACITY = 1024
_LOCAL_BITS = 33


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Ids of every text with ``end_id`` behind: row_id, doc_id, n_tokens, blocks_before (in the task), ids (binary).

    ``ids`` are little-endian unsigned 32-bit integers; null and empty texts are the end id alone. Written to the
    shared folder and read back, so ``row_id`` (task and place) stays what it is when a task runs again later.
    """

    state = {"task": -1, "rows": 0, "blocks": 0}

    def encode(rows: pa.RecordBatch, texts: pa.LargeStringArray) -> dict:
        task = TaskContext.get().partitionId()
        if state["task"] != task:
            state.update(task=task, rows=0, blocks=0)
        ids, offsets = tokens.encoder(tokenizer).encode(texts)
        n = len(offsets) - 1
        ends = offsets[1:] + np.arange(1, n + 1)
        whole = np.full(len(ids) + n, end_id, "<u4")
        inside = np.ones(len(whole), bool)
        inside[ends - 1] = False
        whole[inside] = ids
        bounds = np.concatenate([[0], ends]).astype(np.int64)
        size = np.diff(bounds)
        full = np.cumsum(size // capacity)
        made = {
            "row_id": (np.int64(task) << _LOCAL_BITS) + state["rows"] + np.arange(n),
            "doc_id": rows.column("doc_id"),
            "n_tokens": size,
            "blocks_before": state["blocks"] + full - size // capacity,
            "ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds * 4), pa.py_buffer(whole)]),
        }
        state["rows"] += n
        state["blocks"] += int(full[-1]) if n else 0
        return made

    path = scratch_path(docs.sparkSession)
    made = blocks.mapped(docs.select("doc_id", "text"), "row_id long, doc_id long, n_tokens long, blocks_before long, ids binary", encode)
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _slots(spark: SparkSession, lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[DataFrame, int]:
    rows, sequences = cutting.layout(lengths, demand, capacity)
    schema = "length long, rank_from long, rank_to long, per_sequence long, sequence long, at long, piece_start long, piece_length long"
    return spark.createDataFrame(rows, schema), sequences


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, start (its document's ids before it), length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id (0, 1, ... without gaps), offset (place in the sequence), padded (the
    sequence's length with padding: ``capacity``, or the fill where that is a power of two).
    Every id is in exactly one piece. Repeated rows are packed as often as they occur; a null doc_id stays
    null; null texts are empty and have the end id alone; no rows give no pieces. Ties in length are ranked by doc_id, then by
    place in the input.
    """
    spark = docs.sparkSession
    ids = tokenized(docs, tokenizer, end_id, capacity)
    tail = F.col("n_tokens") % capacity
    histogram = ids.where(tail > 0).groupBy(tail.alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    lengths = np.array([r["length"] for r in histogram], int)
    demand = np.array([r["n"] for r in histogram], int)
    slots, tails = _slots(spark, lengths, demand, capacity)

    # Documents ranked within their length: one range sort of (length, doc_id, row_id), without the ids.
    before = dict(zip(lengths.tolist(), (np.cumsum(demand) - demand).tolist(), strict=True))
    first = spark.createDataFrame(list(before.items()), "length long, before long")
    ranked = with_position(ids.where(tail > 0).select("row_id", tail.alias("length"), "doc_id"), "length", "doc_id", "row_id")
    # A row for each length and pattern: at most capacity lengths, as many patterns, and the items left by rounding.
    table = slots.join(first, "length")
    placed = (
        ranked.join(F.broadcast(table), "length")
        .withColumn("rank", F.col("pos") - 1 - F.col("before"))
        .where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .withColumn("turn", F.col("rank") - F.col("rank_from"))
        .select(
            "row_id",
            F.expr("sequence + turn div per_sequence").alias("sequence_id"),
            (F.col("at") + F.col("turn") % F.col("per_sequence") * F.col("piece_length")).alias("offset"),
            "piece_start",
            "piece_length",
        )
    )
    tail_pieces = (
        ids.where(tail > 0)
        .select("row_id", "doc_id", "n_tokens", F.expr(f"substring(ids, cast((n_tokens div {capacity}) * {4 * capacity} + 1 as int))").alias("ids"))
        .join(placed, "row_id")
        .select(
            "doc_id",
            (F.expr(f"(n_tokens div {capacity}) * {capacity}") + F.col("piece_start")).alias("start"),
            F.col("piece_length").alias("length"),
            F.expr("substring(ids, cast(4 * piece_start + 1 as int), cast(4 * piece_length as int))").alias("ids"),
            F.col("n_tokens").alias("doc_tokens"),
            "sequence_id",
            "offset",
        )
    )

    # Full blocks, numbered on from the sequences of tails. One row per task of the writer for the offsets.
    task = F.shiftright("row_id", _LOCAL_BITS)
    running = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ids.groupBy(task.alias("task")).agg(F.sum(F.expr(f"n_tokens div {capacity}")).alias("blocks"))
    tasks = sizes.select("task", F.coalesce(F.sum("blocks").over(running), F.lit(0)).alias("first_block"))
    full_pieces = (
        ids.where(F.col("n_tokens") >= capacity)
        .withColumn("task", task)
        .join(F.broadcast(tasks), "task")
        .withColumn("block", F.explode(F.expr(f"sequence(0L, n_tokens div {capacity} - 1)")))
        .select(
            "doc_id",
            (F.col("block") * capacity).alias("start"),
            F.lit(capacity).cast("long").alias("length"),
            F.expr(f"substring(ids, cast(block * {4 * capacity} + 1 as int), {4 * capacity})").alias("ids"),
            F.col("n_tokens").alias("doc_tokens"),
            (F.lit(tails) + F.col("first_block") + F.col("blocks_before") + F.col("block")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
    return full_pieces.unionByName(tail_pieces)
