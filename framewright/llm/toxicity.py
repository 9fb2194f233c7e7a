"""Toxicity by multiple-instance learning: only documents are labelled, their sentences are scored.

A sentence's probability is a logistic function of the sum of its words' weights, less what a sentence without learned
words has (p0): p = max(0, (q - p0) / (1 - p0)), so sentences that say nothing add nothing, however many there are. The
weights are trained from document labels alone through the noisy-or of a document's sentences, 1 - prod(1 - p), so they
settle on the words that make single sentences toxic; the same weights then point to the sentences. A document's score
is the noisy-or of its offending sentences, or the largest p if none offends: length alone makes no text toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from framewright.llm import blocks
from framewright.llm.sampling import labelled_sample
from framewright.session import cut_lineage

SAMPLE = 12_000  # labelled documents that the weights are trained on; the choice goes by a hash of the doc_id
SAMPLE_BYTES = 64 << 20  # of their texts together: what comes to the driver follows their words
BITS = 20
PREFIXES = (4, 5, 6)  # beside the whole word, its first bytes: stems
_LEAK = 0.03
OFFENDING = 0.5  # a sentence with this probability or more offends
FEATURES = 30_000  # trained, those that speak most for the label; all others weigh nothing

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # 2 ** BITS
    bias: float
    background: float  # -log(1 - p0), taken out of every sentence


def features(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: features (words x 4, the last column is the whole word), sentence number, text number; and
    the byte where each word begins. Sentences end at . ! ? and line ends, and with the text."""
    body, bounds = blocks.raw(pc.utf8_lower(texts))
    start, end, text = blocks.words(body, bounds, _OUTSIDE)
    stops = _STOP[body]
    stops[bounds[1:-1][bounds[1:-1] < len(body)]] = True
    sentence = np.cumsum(stops)[start] if len(start) else np.zeros(0, np.int64)
    found = np.zeros((len(start), len(PREFIXES) + 1), np.uint32)
    mask = np.uint64((1 << BITS) - 1)
    found[:, -1] = blocks.word_hashes(body, start, end) & mask
    for k, n in enumerate(PREFIXES):
        long = end - start > n
        stem = blocks.word_hashes(body, start[long], start[long] + n)
        found[long, k] = (blocks.scramble(stem + np.uint64(n)) | np.uint64(1)) & mask
    return found, sentence, text, start


def _probabilities(model: Model, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """log(1 - p) of each sentence with words, its text, and where it begins and ends among the words."""
    found, sentence, text, _ = features(texts)
    if not len(found):
        none = np.zeros(0, np.int64)
        return np.zeros(0), none, none, none
    first = np.flatnonzero(np.diff(sentence, prepend=-1) | np.diff(text, prepend=-1))
    z = np.add.reduceat(model.weights[found].sum(axis=1, dtype=float), first) + model.bias
    return -np.maximum(np.logaddexp(0, z) - model.background, 0.0), text[first], first, np.append(first[1:], len(found))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chosen: int = FEATURES, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from ``labels`` (doc_id, label 0/1) and ``docs`` (doc_id, text).

    Null labels are passed over; of several labels of a document the greatest counts. Without labelled documents, or
    with one class only, the model gives every text with words that class. ``chosen`` bounds the features that get a weight; it
    bounds the model, not the rows. Learned from are at most ``sample`` labelled documents with at most ``sample_bytes`` of text
    together, whole ones, in the order of a hash of their ids (documents that no longer fit are passed over).
    """
    spark = docs.sparkSession
    picked = labelled_sample(labels, sample, F.max)

    # ``picked`` has at most ``sample`` rows; of rows that repeat a doc_id any one is learned from.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    rows = _within(rows.select("label", "text", "doc_id"), sample_bytes)
    able, kinds = _speaking(rows, chosen)
    if min(kinds) == 0:
        return Model(np.zeros(1 << BITS, np.float32), -40.0 if kinds[1] == 0 else 40.0, 0.0)
    place = np.full(1 << BITS, -1, np.int32)
    place[able] = np.arange(len(able))
    shared = spark.sparkContext.broadcast(place)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the fit needs of a document: its chosen features by sentence, and how many sentences have some."""
        for part, texts in blocks.slices(batches, "text"):
            found, sentence, text, _ = features(texts)
            ends = np.searchsorted(text, np.arange(part.num_rows + 1))
            made = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                at = shared.value[found[a:b]]
                word, column = np.nonzero(at >= 0)
                loud, own = np.unique(sentence[a:b][word], return_inverse=True)
                made.append((at[word, column].tobytes(), own.astype(np.int32).tobytes(), len(loud)))
            columns = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True))],
                names=["label", "feature", "sentence", "loud"],
            )

    return _fit(rows.mapInArrow(gather, "label int, feature binary, sentence binary, loud long").collect(), able)


def _within(rows: DataFrame, most: int) -> DataFrame:
    """Labelled documents (a bounded number) whose texts have ``most`` bytes together: all of them, as a rule."""
    sizes = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("doc_id").alias("turn")).collect()
    if sum(r["size"] for r in sizes) <= most:
        return rows.select("label", "text")
    kept, room = [], most
    for r in sorted(sizes, key=lambda r: (r["turn"], r["doc_id"])):
        if r["size"] <= room:
            kept.append((r["doc_id"],))
            room -= r["size"]
    chosen = rows.sparkSession.createDataFrame(kept, "doc_id long")
    return rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("label", "text")


def _speaking(rows: DataFrame, chosen: int) -> tuple[np.ndarray, tuple[int, int]]:
    """The features that speak most for the label (at most ``chosen``), and the number of documents of each label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks.slices(batches, "text"):
            label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            found, _, text, _ = features(texts)
            pairs = np.unique((text[:, None].astype(np.int64) << BITS) | found)  # each feature once a document
            feature, kind = pairs & ((1 << BITS) - 1), label[pairs >> BITS]
            kinds, n = np.unique(feature * 2 + kind, return_counts=True)
            whole = np.bincount(label, minlength=2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([kinds // 2, [-1, -1]])), pa.array(np.concatenate([kinds % 2, [0, 1]])), pa.array(np.concatenate([n, whole]))],
                names=["feature", "label", "n"],
            )

    counted = rows.mapInArrow(count, "feature long, label long, n long")
    sums = counted.groupBy("feature").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg")
    )
    sums = cut_lineage(sums)
    whole = sums.where("feature = -1").first()
    if whole is None:
        return np.zeros(0, np.int64), (0, 0)
    pos, neg = int(whole["pos"]), int(whole["neg"])
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    best = sums.where("feature > 0 and pos >= 2").withColumn("odds", odds).where("odds > 0.5")
    best = best.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "feature").limit(chosen).select("feature")
    return np.array([r["feature"] for r in best.collect()], np.int64), (neg, pos)


def _fit(rows: list, able: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 2e-5) -> Model:
    """Weights of the features ``able`` by gradient steps on the likelihood of the documents' labels.

    A share ``_LEAK`` of the documents counts as toxic for no sentence's sake; it bounds the slope of those that no
    learned word explains.
    """
    y = np.array([r["label"] for r in rows], float)
    loud = np.array([r["loud"] for r in rows], np.int64)
    first = np.cumsum(loud) - loud
    feature = np.concatenate([np.frombuffer(r["feature"], np.int32) for r in rows])
    sentence = np.concatenate([np.frombuffer(r["sentence"], np.int32) + at for r, at in zip(rows, first, strict=True)])
    document = np.repeat(np.arange(len(rows)), loud)
    n = len(document)
    w, bias = np.zeros(len(able)), -6.0
    m, v = np.zeros(len(able) + 1), np.zeros(len(able) + 1)
    balance = np.where(y == 1, (len(y) - y.sum()) / y.sum(), 1.0) ** 0.5
    for step in range(1, steps + 1):
        z = np.bincount(sentence, w[feature], n) + bias
        p = 1 / (1 + np.exp(-z))
        p0 = 1 / (1 + np.exp(-bias))
        above = z >= bias  # the others' probability is 0
        s = np.bincount(document, np.where(above, np.logaddexp(0, z) - np.logaddexp(0, bias), 0.0), len(y))  # -log of "no sentence"
        clean = (1 - _LEAK) * np.exp(-s)
        slope = np.where(y == 1, -clean / (1 - clean), 1.0) * balance
        each = slope[document] * np.where(above, p, 0.0)
        gradient = np.append(np.bincount(feature, each[sentence], len(able)), (slope[document] * np.where(above, p - p0, 0.0)).sum()) / len(y)
        gradient[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[able] = w
    return Model(weights, float(bias), float(np.logaddexp(0, bias)))


def _document_scores(none_toxic: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Scores of ``n`` texts from log(1 - p) of their sentences."""
    found = np.zeros(n)
    if len(text):
        p = -np.expm1(none_toxic)
        np.maximum.at(found, text, p)
        found = np.maximum(found, -np.expm1(np.bincount(text, np.where(p >= OFFENDING, none_toxic, 0.0), n)))
    return found


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` and the score (0 to 1) as column ``name`` for every row of ``docs`` (with text).

    A null or empty text, or one without words, has no sentence and score 0. Repeated rows give equal rows, no rows
    give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats
    kept = StructType([docs.schema[c] for c in keep])
    target = to_arrow_schema(StructType([*kept, StructField(name, DoubleType())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks.slices(batches, "text"):
            none_toxic, text, _, _ = _probabilities(shared.value, texts)
            columns = [rows.column(c).cast(target.field(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_document_scores(none_toxic, text, rows.num_rows))], schema=target)

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(work, StructType([*kept, StructField(name, DoubleType())]))


def sentences(docs: DataFrame, model: Model, least: float = OFFENDING) -> DataFrame:
    """The offending sentences: doc_id, sentence (text), score, for sentences that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(rows: pa.RecordBatch, texts: pa.LargeStringArray) -> dict:
        none_toxic, text, first, last = _probabilities(shared.value, texts)
        bad = np.flatnonzero(-np.expm1(none_toxic) >= least)
        lowered, bounds = blocks.raw(pc.utf8_lower(texts))
        start, end, _ = blocks.words(lowered, bounds, _OUTSIDE)
        found = [lowered[start[first[i]] : end[last[i] - 1]].tobytes().decode() for i in bad]
        return {"doc_id": rows.column("doc_id").take(pa.array(text[bad])), "sentence": found, "score": -np.expm1(none_toxic[bad])}

    return blocks.mapped(docs.select("doc_id", "text"), "doc_id long, sentence string, score double", work)
