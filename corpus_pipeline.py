"""The corpus pipeline: documents through operators of ``framewright.llm``, each stage on what the one before kept.

Toxic documents go, then poor ones, then exact copies, then all but one of each group of near copies; what stays is
packed into training sequences. Models learn from ``labels`` in the folder of the tables. Every stage but the last
returns the columns of ``documents``; ``run`` writes its rows to the shared folder and reads them as the next one's.
No stage can be said in SQL (learned weights, links by similarity, a linear program), so there is no ``ORACLE_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import dedup, jaccard, packing, quality, rows, tokens, toxicity
from framewright.session import scratch_path

TOXIC_FROM = 0.5  # documents with this score or more go
GOOD_FROM = 0.7  # documents below go, as operator 8 predicts


def _labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(column).alias("label"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that noisy-or scoring does not reject."""
    model = toxicity.train(docs, _labels(spark, sf_dir, "toxic"))
    scored = toxicity.score(rows.packed(docs), model, keep=("doc_id", "text", "others"), name="toxic")
    return rows.unpacked(scored.where(F.col("toxic") < TOXIC_FROM), docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject. Only the labelled sample is measured twice, to learn and to score."""
    model = quality.learn(docs, _labels(spark, sf_dir, "quality"))
    measured = quality.statistics(rows.packed(docs), keep=("doc_id", "text", "others"))
    scored = quality.score(measured, model, name="good")
    return rows.unpacked(scored.where(F.col("good") >= GOOD_FROM), docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles, 80 percent in common."""
    return jaccard.keep_one(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 1024 byte-level ids."""
    pieces = packing.pack(docs, tokens.tokenizer_path(tokens.BYTE_LEVEL), end_id=0, capacity=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the pieces of the documents that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
