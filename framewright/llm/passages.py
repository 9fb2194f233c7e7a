"""Passages that documents repeat, found by streaming segments of documents through a compressed FM-index per shard.

1. Every text is cut into segments: neighbouring windows of ``window`` words with the same anchor, the least hash of a run
   of ``window // 3`` words in them. Equal windows have equal anchors, so what repeats meets under one anchor. A segment is a
   row of numbers (anchor, digest, document, place); only anchors of two documents or more go on, and equal segments fold.
2. One copy of each segment left is cut out of its text and goes to the shard of its anchor. A shard has about
   ``SHARD_WORDS`` words, whatever the input: it builds the index (``fm_index``), and every segment is searched backwards for
   matches of ``window`` words or more with a segment of a smaller document.
3. An anchor with more than ``crowd`` different segments (a passage shorter than a window that very many documents quote) would
   not fit a shard. Its windows are told apart by the digests of whole windows instead, which aggregate in parts.
4. Intervals go back to all copies of a segment, and to the documents.

64-bit hashes stand for words and 128 bits for segments and windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import blocks
from framewright.llm.fm_index import FMIndex
from framewright.llm.rows import content
from framewright.session import scratch_path

SHARD_WORDS = 200_000
CROWD = 2_000  # different segments that one anchor may bring into a shard
LAST = (1 << 63) - 1  # stands for a null doc_id, which is larger than any

_PLACED = "anchor long, d1 long, d2 long, owner long, content long, start int, windows int"
_PLACED_ARROW = pa.schema(
    [("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("owner", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())]
)
_CUT = (
    "doc_id long, owner long, content long, text string, n_words long, kept_sha256 string, "
    "segments array<struct<d1:long, d2:long, anchor:long, least:long, crowded:boolean, words:binary>>"
)
_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_SPANS = "d1 long, d2 long, a int, b int"
_SECOND = np.uint64(0xD6E8FEB86659FD93)  # makes a second, independent digest of the same words


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("owner"), content().alias("content"), "text")


def _window_anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of the words, the least hash of its runs of ``window // 3`` words."""
    run = max(1, window // 3)
    least, width, span = blocks.run_hashes(hashes, run), 1, window - run + 1
    while width < span:  # least of ever wider ranges; the last step overlaps
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return least


def _prefix_sums(hashes: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * blocks.powers(len(hashes)), out=sums[1:])
    return sums


_BACK = np.uint64(pow(int(blocks.STEP), -1, 1 << 64))


def _back_powers(n: int) -> np.ndarray:
    back = np.full(n, _BACK)
    back[:1] = 1
    return np.cumprod(back, dtype=np.uint64)


def _digests(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of the words first to end, whatever their place."""
    size, shift = (end - first).astype(np.uint64), _back_powers(len(hashes) + 1)[first]
    pair = []
    for values in (hashes, blocks.scramble(hashes ^ _SECOND)):
        sums = _prefix_sums(values)
        pair.append(blocks.scramble((sums[end] - sums[first]) * shift + size).view(np.int64))
    return pair[0], pair[1]


def segments(docs: DataFrame, window: int) -> DataFrame:
    """The segments of all texts: anchor, digest (d1, d2), owner, content, first word, number of windows."""
    widest = window - max(1, window // 3) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks.slices(batches, "text"):
            body, offsets = blocks.raw(texts)
            start, end, row = blocks.words(body, offsets)
            if len(start) < window:
                continue
            hashes = blocks.word_hashes(body, start, end)
            anchors = _window_anchors(hashes, window)
            at = np.flatnonzero(row[: len(anchors)] == row[window - 1 :])
            if len(at) == 0:
                continue
            new = np.ones(len(at), bool)
            new[1:] = (anchors[at[1:]] != anchors[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
            # Long runs of one anchor (words that repeat without end) are cut, so that a segment is less than two windows.
            first = np.flatnonzero(new)
            since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            first = np.flatnonzero(since % widest == 0)
            windows = np.diff(np.append(first, len(at)))
            begin = at[first]
            d1, d2 = _digests(hashes, begin, begin + windows + window - 1)
            owner = row[begin]
            in_text = begin - np.searchsorted(row, owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchors[begin].view(np.int64)), pa.array(d1), pa.array(d2),
                    rows.column("owner").take(pa.array(owner)), rows.column("content").take(pa.array(owner)),
                    pa.array(in_text.astype(np.int32)), pa.array(windows.astype(np.int32)),
                ],
                schema=_PLACED_ARROW,
            )

    return docs.select("owner", "content", "text").mapInArrow(work, _PLACED)


def _word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # ASCII white space, as \x20 and \x09-\x0D are


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """Documents without places (array of segments) are done; of the others the text and the words of those segments go on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in blocks.slices(iter([batch]), "text"):
                out: dict[str, list] = {name: [] for name in ("text", "n_words", "kept_sha256", "segments")}
                for text, places in zip(texts, rows.column("places").to_pylist()):
                    words = _word_list(text.as_py())
                    out["n_words"].append(len(words))
                    out["text"].append(None if places is None else text.as_py())
                    out["kept_sha256"].append(_sha(words) if places is None else None)
                    found = []
                    if places:
                        body = np.frombuffer(text.as_py().encode(), np.uint8)
                        hashes = blocks.word_hashes(body, *blocks.words(body, np.array([0, len(body)]))[:2])
                        for p in places:
                            some = hashes[p["start"] : p["start"] + p["windows"] + window - 1]
                            found.append({"d1": p["d1"], "d2": p["d2"], "anchor": p["anchor"], "least": p["least"], "crowded": p["crowded"], "words": some.tobytes()})
                    out["segments"].append(found)
                columns = [rows.column(c) for c in ("doc_id", "owner", "content")] + [pa.array(out[k], kind) for k, kind in _CUT_TYPES.items()]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "owner", "content", *_CUT_TYPES])

    return docs.mapInArrow(work, _CUT)


_SEGMENT = pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("anchor", pa.int64()), ("least", pa.int64()), ("crowded", pa.bool_()), ("words", pa.binary())])
_CUT_TYPES = {"text": pa.string(), "n_words": pa.int64(), "kept_sha256": pa.string(), "segments": pa.list_(_SEGMENT)}


def _searched(table: pa.Table, window: int) -> pa.Table:
    """Build the index of one shard and stream its segments through it."""
    words = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words").combine_chunks()]
    owners = table.column("least").to_numpy()
    depth = 1 << int(max(map(len, words))).bit_length()
    segment, a, b = FMIndex(words, owners, depth).covered(window)
    return pa.table(
        {
            "d1": table.column("d1").take(pa.array(segment)),
            "d2": table.column("d2").take(pa.array(segment)),
            "a": pa.array(a.astype(np.int32)),
            "b": pa.array(b.astype(np.int32)),
        }
    )


def _crowded_windows(segments: DataFrame, window: int) -> DataFrame:
    """w1, w2, d1, d2, least, at: the digest of every window of the given segments."""
    schema = "w1 long, w2 long, d1 long, d2 long, least long, at int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes = np.frombuffer(row["words"], np.uint64)
                at = np.arange(len(hashes) - window + 1)
                w1, w2 = _digests(hashes, at, at + window)
                same = [pa.array(np.full(len(at), row[c], np.int64)) for c in ("d1", "d2", "least")]
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), *same, pa.array(at.astype(np.int32))], names=["w1", "w2", "d1", "d2", "least", "at"])

    return segments.select("d1", "d2", "least", "words").mapInArrow(work, schema)


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def intervals(docs: DataFrame, window: int, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """For keyed documents (``_keyed``): the rows of ``_cut``, and owner, content, spans of words to remove."""
    placed = _written(segments(docs, window))
    shared = _written(
        placed.groupBy("anchor").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low < high").select("anchor")
    )
    placed = _written(placed.join(shared, "anchor", "left_semi"))
    folded = _written(
        placed.groupBy("d1", "d2").agg(
            F.min("anchor").alias("anchor"),
            F.min("owner").alias("least"),
            F.max("owner").alias("most"),
            F.min(F.struct("owner", "content", "start", "windows")).alias("at"),
        )
    )
    size = folded.agg(F.coalesce(F.sum(F.col("at.windows") + (window - 1)), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_WORDS))
    crowds = _written(folded.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor", F.lit(True).alias("crowded")))

    # One place for each different segment, and a row for every document that has any.
    places = (
        folded.join(crowds, "anchor", "left")
        .select(
            F.col("at.owner").alias("owner"),
            F.col("at.content").alias("content"),
            F.struct(F.col("at.start").alias("start"), F.col("at.windows").alias("windows"), "d1", "d2", "anchor", "least", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("place"),
        )
    )
    none = placed.select("owner", "content").distinct().select("owner", "content", F.lit(None).cast(places.schema["place"].dataType).alias("place"))
    by_document = places.unionByName(none).groupBy("owner", "content").agg(F.collect_list("place").alias("places"))
    cut = _written(_cut(docs.join(by_document, ["owner", "content"], "left"), window))

    pieces = cut.select(F.explode("segments").alias("s")).select("s.*").dropDuplicates(["d1", "d2"])
    near = (
        pieces.where("not crowded").select(F.pmod("anchor", F.lit(shards)).alias("shard"), "d1", "d2", "least", "words")
        .groupBy("shard")
        .applyInArrow(lambda table: _searched(table, window), _SPANS)
    )
    windows = _written(_crowded_windows(pieces.where("crowded"), window))
    first = _written(windows.groupBy("w1", "w2").agg(F.min("least").alias("first")))
    far = windows.join(first, ["w1", "w2"]).where("first < least").select("d1", "d2", F.col("at").alias("a"), (F.col("at") + window).alias("b"))
    spans = near.unionByName(far).groupBy("d1", "d2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    told = _written(
        folded.join(spans, ["d1", "d2"], "left").where("most > least or spans is not null").select("d1", "d2", "least", "spans")
    )

    # The first document of a segment loses the spans; later ones, which repeat it whole, all of it.
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows") + (window - 1)).alias("b")))
    moved = F.transform(F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")), lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    removed = (
        placed.select("d1", "d2", "owner", "content", "start", "windows").join(told, ["d1", "d2"])
        .select("owner", "content", F.when(F.col("owner") > F.col("least"), whole).otherwise(moved).alias("spans"))
        .groupBy("owner", "content")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )
    return cut, removed


def _strip(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_removed": [], "kept_sha256": []}
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                words = _word_list(text.as_py())
                edge = np.zeros(len(words) + 1, np.int64)
                if spans.is_valid and len(spans.values):
                    np.add.at(edge, spans.values.field("a").to_numpy(), 1)
                    np.add.at(edge, spans.values.field("b").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(_sha([words[i] for i in np.flatnonzero(~gone).tolist()] if gone.any() else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return docs.select("doc_id", "n_words", "text", "spans").mapInArrow(work, _KEPT)


def strip(docs: DataFrame, window: int = 50, crowd: int = CROWD) -> DataFrame:
    """Remove words in windows of ``window`` words that start in a document with a smaller doc_id too: doc_id, n_words, n_removed, kept_sha256.

    Words are split at ASCII white space and compared as they are; kept words are joined by one space for the digest. Windows
    are judged on the input. A null text has no words; shorter texts lose none. A null doc_id is larger than any; rows
    with the same doc_id (repeated rows, or null twice) take nothing from each other. Other columns are not looked at. An
    empty table gives no rows. Runs jobs: segments, cut documents and verdicts are written.
    """
    cut, removed = intervals(_keyed(docs), window, crowd)
    done = cut.where("kept_sha256 is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    rest = cut.where("kept_sha256 is null").select("doc_id", "owner", "content", "n_words", "text")
    return done.unionByName(_strip(rest.join(removed, ["owner", "content"], "left")))
