"""Projection, derived columns, key/value frames and rows by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.nested import path
from framewright.functions.text import slice_text
from framewright.operators.order import numbered, with_position
from framewright.operators.select import items, same_key


def pick(df: DataFrame, names) -> DataFrame:
    """Keep the named columns, in that order."""
    return df.select(*[F.col(f"`{n}`") for n in items(names)])


def pick_nested(df: DataFrame, name: str, fields) -> DataFrame:
    """Keep the named fields of every record in array column ``name``."""
    return df.withColumn(name, F.transform(name, lambda r: F.struct(*[r[f].alias(f) for f in items(fields)])))


def each(df: DataFrame, field, keep=(), alias: str | None = None) -> DataFrame:
    """One field of every row (``a.0.b`` walks into nested values), next to the columns ``keep``."""
    return df.select(*keep, path(field).alias(alias or str(field).replace(".", "_")))


def each_nested(df: DataFrame, name: str, field: str) -> DataFrame:
    """Replace array column ``name`` by one field of every record in it."""
    return df.withColumn(name, F.transform(name, lambda r: r[field]))


def set_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a column."""
    return df.withColumn(name, value)


def set_nested(df: DataFrame, name: str, field: str, block) -> DataFrame:
    """Add or replace one field of every record in array column ``name``."""
    return df.withColumn(name, F.transform(name, lambda r: r.withField(field, block(r))))


def map_values(df: DataFrame, block, name: str = "value") -> DataFrame:
    """Replace a column by ``block(column)``; on a key/value frame the keys are kept."""
    return df.withColumn(name, block(F.col(name)))


def map_array(df: DataFrame, name: str, block) -> DataFrame:
    """Replace every element of array column ``name`` by ``block(element)``."""
    return df.withColumn(name, F.transform(name, block))


def map_map(df: DataFrame, name: str, block) -> DataFrame:
    """Replace the values of map column ``name``; keys are kept."""
    return df.withColumn(name, F.transform_values(name, lambda _, v: block(v)))


def pairs(df: DataFrame, name: str) -> DataFrame:
    """One key/value row per entry of map column ``name``."""
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(name).alias("key", "value"))


def keys(df: DataFrame, name: str | None = None) -> DataFrame:
    """The keys of a key/value frame, or of map column ``name`` as an array."""
    return df.select("key") if name is None else df.withColumn(name, F.map_keys(name))


def vals(df: DataFrame, name: str | None = None) -> DataFrame:
    """The values of a key/value frame, or of map column ``name`` as an array."""
    return df.select("value") if name is None else df.withColumn(name, F.map_values(name))


def slice_column(df: DataFrame, name: str, start: int | None, stop: int | None) -> DataFrame:
    """Cut a text column, or every text of an array column, to ``[start:stop]``; None is an open end."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return df.withColumn(name, F.transform(name, lambda t: slice_text(t, start, stop)))
    return df.withColumn(name, slice_text(F.col(name), start, stop))


def join_rows(df: DataFrame, key: str, text: str, seq: str, sep: str, name: str = "joined") -> DataFrame:
    """One text per key: its rows' texts in the order of ``seq``. A key's texts come together in one value, so groups must be
    small enough for a cell."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("at"), F.col(text).alias("part"))))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["part"]), sep).alias(name))


def group_rows(df: DataFrame, key: str, seq: str, keep_null: bool = False) -> DataFrame:
    """All rows, group after group in order of first appearance, numbered inside their group.

    Adds ``group_pos`` (1 for the group seen first) and ``row_pos`` (1 for the first row of its
    group). No group is gathered anywhere: the rows are range-sorted once, so a hot group is spread
    over as many tasks as its size asks for. ``seq`` numbers the rows: no two have the same.
    """
    rows = df if keep_null else df.where(F.col(key).isNotNull())
    firsts = rows.groupBy(F.col(key).alias("_key")).agg(F.min(seq).alias("_first"))
    placed = with_position(
        rows.join(firsts, same_key(F.col(key), F.col("_key"))).drop("_key"), "_first", seq, name="_at"
    )
    # A group's first row is the one whose seq is the group's first; those rows stand in order already.
    starts = numbered(placed.where(F.col(seq) == F.col("_first")).select("_first", F.col("_at").alias("_start")), name="group_pos")
    return (
        placed.join(starts, "_first")
        .withColumn("row_pos", F.col("_at") - F.col("_start") + 1)
        .drop("_first", "_at", "_start")
    )
