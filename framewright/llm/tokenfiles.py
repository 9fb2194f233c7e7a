"""Token-id files in Simple-8b, in ascending order of documents.

A file set is a folder of Parquet part files that Spark commits. A row is a run of neighbouring documents: their ids
(``doc_ids``), their sizes (``sizes``), and ``words`` / ``blocks``, the coded token ids of all of them in a row and
the word offset of each block of 1024 ids. Rows are numbered by ``shard`` (a range of documents) and ``run``; ``before`` counts the ids of
earlier runs of the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm import blocks, simple8b, tokens

_FILE = "shard int, run int, before long, n_tokens long, doc_ids array<bigint>, sizes array<bigint>, words binary, blocks binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> str:
    """Encode every text (null: empty), put ``end_id`` behind each, and write the files in ascending doc_id order.

    A null doc_id comes first; rows with the same doc_id stand in the order of their texts. Extra columns are not
    written. No rows give no files to speak of (reading gives no rows).
    """
    state = {"shard": -1, "run": 0, "before": 0}

    def code(rows: pa.RecordBatch, texts: pa.LargeStringArray) -> dict:
        shard = TaskContext.get().partitionId()
        if state["shard"] != shard:
            state.update(shard=shard, run=0, before=0)
        ids, offsets = tokens.encoder(tokenizer).encode(texts)
        n = len(offsets) - 1
        ends = offsets[1:] + np.arange(1, n + 1)
        whole = np.full(len(ids) + n, end_id, np.uint64)
        inside = np.ones(len(whole), bool)
        inside[ends - 1] = False
        whole[inside] = ids
        words, starts = simple8b.encode(whole)
        run, before = state["run"], state["before"]
        state["run"], state["before"] = run + 1, before + len(whole)
        doc_ids = rows.column("doc_id")
        return {
            "shard": [shard],
            "run": [run],
            "before": [before],
            "n_tokens": [len(whole)],
            "doc_ids": [doc_ids.to_pylist()],
            "sizes": [np.diff(np.concatenate([[0], ends]))],
            "words": [words.astype("<u8").tobytes()],
            "blocks": [starts.astype("<u4").tobytes()],
        }

    # Range partitions in doc_id order. The other keys only part rows of one doc_id, should it hold very many.
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    blocks.mapped(ordered, _FILE, code).write.parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file set: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian uint32)."""
    files = spark.read.schema(_FILE).parquet(path)
    # Totals of shards: one row per part file, so a single ordered window is bounded by their number.
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    files = files.join(F.broadcast(shards), "shard").withColumn("first", F.col("shard_start") + F.col("before"))

    target = "doc_id long, start long, n_tokens long, ids binary"
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                sizes = np.asarray(row["sizes"].values, np.int64)
                n = row["n_tokens"].as_py()
                words = np.frombuffer(row["words"].as_buffer(), "<u8")
                ids = simple8b.decode(words, np.frombuffer(row["blocks"].as_buffer(), "<u4").astype(np.int64), n).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(sizes)])
                body = pa.BinaryArray.from_buffers(
                    pa.binary(), len(sizes), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)]
                )
                start = row["first"].as_py() + ends[:-1]
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(start), pa.array(sizes), body], schema=schema)

    return files.mapInArrow(decode, target)
