"""Order, limits, top-k, distinct values and frequencies.

Spark rows have no order of their own. Where order carries meaning an operator takes ``seq``, a
column that numbers the rows as they came; equal values keep that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import cut_lineage

LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row inside the partition below


def ascending(names, seq=None) -> list[Column]:
    return [F.asc_nulls_last(n) for n in _names(names)] + ([F.col(seq).asc()] if seq else [])


def descending(names, seq=None) -> list[Column]:
    return [F.desc_nulls_last(n) for n in _names(names)] + ([F.col(seq).asc()] if seq else [])


def _names(names) -> list:
    return list(names) if isinstance(names, (list, tuple)) else [names]


def with_position(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """Sort by ``order`` and number the rows 1, 2, 3 ... across all partitions.

    The sort is Spark's range sort. A row's number is its place inside its partition plus the
    sizes of the partitions before; the sorted rows are checkpointed first, so both are read from
    the same partitions. The sizes are one row per partition, whatever the data volume.
    """
    return _placed(df.orderBy(*order), name)


def _placed(ordered: DataFrame, name: str) -> DataFrame:
    placed = cut_lineage(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", LOCAL_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + inside + 1)
        .drop("_id", "_part", "_before")
    )


def numbered(df: DataFrame, name: str = "pos") -> DataFrame:
    """The rows of an ordered table, numbered 1, 2, 3 ... as they stand (checkpoints them, see ``with_position``)."""
    return _placed(df, name)


def sort(df: DataFrame, names, seq=None, desc: bool = False) -> DataFrame:
    """Sort by one or more columns, missing values last, equal values in the order of ``seq``."""
    return df.orderBy(*(descending if desc else ascending)(names, seq))


def rsort(df: DataFrame, names, seq=None) -> DataFrame:
    return sort(df, names, seq, desc=True)


def cut(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``: a lazy top-k, whose ``n`` rows come together in one task.

    For cuts that are too long for that, ``cut_by_position`` keeps the rows spread.
    """
    return df.orderBy(*order).limit(n)


def cut_by_position(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, spread over the partitions of a range sort (runs a job, see ``with_position``)."""
    return with_position(df, *order, name="_at").where(F.col("_at") <= n).drop("_at")


def top(df: DataFrame, n: int, value: str = "value", seq=None) -> DataFrame:
    """The ``n`` rows with the largest ``value``, largest first, ties as first seen."""
    return cut(df, descending(value, seq), n)


def bottom(df: DataFrame, n: int, value: str = "value", seq=None) -> DataFrame:
    """The ``n`` rows with the smallest ``value``, smallest first, ties as first seen."""
    return cut(df, ascending(value, seq), n)


def first(df: DataFrame, n: int, seq: str) -> DataFrame:
    """The first ``n`` rows."""
    return cut(df, [F.col(seq).asc()], n)


def last(df: DataFrame, n: int, seq: str) -> DataFrame:
    """The last ``n`` rows, in their original order."""
    return cut(df, [F.col(seq).desc()], n).orderBy(F.col(seq).asc())


def rev(df: DataFrame, seq: str) -> DataFrame:
    """All rows, last one first."""
    return df.orderBy(F.col(seq).desc())


def first_seen(df: DataFrame, name: str, seq: str) -> DataFrame:
    """Each distinct value once, with the place where it was first seen (not yet ordered)."""
    return df.groupBy(name).agg(F.min(seq).alias("first_seen"))


def uniq(df: DataFrame, name: str, seq: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    return first_seen(df, name, seq).orderBy("first_seen").select(name)


def counted(df: DataFrame, name: str, seq: str) -> DataFrame:
    """Key, count and first place of every distinct value (not yet ordered)."""
    return df.groupBy(F.col(name).alias("key")).agg(
        F.count(F.lit(1)).alias("value"), F.min(seq).alias("first_seen")
    )


def freq(df: DataFrame, name: str, seq: str) -> DataFrame:
    """Key and count of every distinct value, most frequent first, ties as first seen."""
    return sort(counted(df, name, seq), "value", "first_seen", desc=True).select("key", "value")
