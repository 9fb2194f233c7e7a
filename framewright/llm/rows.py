"""Choosing rows of a table of documents by doc_id and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content() -> Column:
    """A hash of a row's text; a null text counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _key(doc_id, text_hash) -> Column:
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), text_hash.cast("string"))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and ``others``: all other columns in one, whatever their names, so that an operator's own names meet none of theirs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("others"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the table that ``packed`` took, in their order."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in columns))


def stay(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` (doc_id, content) names, one for each; any one where rows repeat doc_id and text.

    One join by doc_id and content together: copies of a text have keys of their own, so no key is hot unless whole
    rows repeat, and those are folded before they move.
    """
    keyed = packed(docs).withColumn("key", _key("doc_id", content())).dropDuplicates(["key"])
    named = chosen.select(_key("doc_id", F.col("content")).alias("key")).distinct()
    return unpacked(keyed.join(named, "key", "left_semi"), docs.columns)
