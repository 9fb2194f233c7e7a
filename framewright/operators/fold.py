"""Blocks of arbitrary code per group, over the rows of a group in order, without bringing a group together.

Rows are range-sorted by key and ``seq``, so a hot group lies in many partitions. A block carries a small state from row to
row. Every partition runs its last group from the block's start and leaves one row: its first and last key and that
state. The states of a group that goes on over partition ends are joined along those rows, and a second pass runs each
partition with the state its first group comes in with.

A block is an object with four parts::

    start                      the state before the first row of a group
    run(state, rows)           (new state, result): go on over ``rows``, a pandas frame of neighbouring rows of one group;
                               the result has a value for every row (``scan``), or is not looked at (``fold``)
    join(left, right)          the state after rows that leave ``left`` and then rows that left ``right`` from ``start``
    finish(state)              the value of a whole group (``fold`` only)

States are picklable and small; they do not grow with the rows. ``join`` must be true to ``run``: the state of rows in
one piece equals the joined states of its parts, wherever it is cut.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from framewright.session import cut_lineage

_HELD = 10_000  # finished groups that a task hands on together
_WHOLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}


@dataclass(frozen=True)
class Block:
    """A block from plain functions; ``finish`` is only needed to fold."""

    start: Any
    run: Callable[[Any, pd.DataFrame], tuple[Any, Any]]
    join: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any] | None = None


def _sorted(df: DataFrame, key: str, seq: str) -> tuple[DataFrame, str]:
    """Rows in order of key and ``seq``, written once, and the name of the column with the number of their partition."""
    part = "part"
    while part in df.columns:
        part += "_"
    ordered = df.orderBy(F.asc_nulls_first(key), F.asc_nulls_first(seq))
    return cut_lineage(ordered.withColumn(part, F.spark_partition_id())), part


def _same(a, b) -> bool:
    return a == b or (a is None and b is None) or (a != a and b != b)


def _cuts(keys: pa.Array) -> list[int]:
    """Where the runs of equal keys of a batch begin, and its end. Nulls are equal, and so are NaNs."""
    one, two = keys.slice(0, len(keys) - 1), keys.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(pc.is_null(one), pc.is_null(two)))
    if pa.types.is_floating(keys.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(one), pc.is_nan(two)), False))
    return [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist(), len(keys)]


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """A batch for a block; whole numbers stay whole where some are missing."""
    missing = {f.type for f, column in zip(batch.schema, batch.columns) if column.null_count and f.type in _WHOLE}
    return batch.to_pandas(types_mapper=lambda kind: _WHOLE[kind] if kind in missing else None)


def _pieces(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[Any, bool, pd.DataFrame]]]]:
    """Every batch with its runs of equal keys: (key, begins, rows); ``begins`` unless a run goes on from the batch before."""
    last, seen = None, False
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys, frame, found = batch.column(key), _frame(batch), []
        cuts = _cuts(keys)
        for a, b in zip(cuts[:-1], cuts[1:]):
            name = keys[a].as_py()
            found.append((name, not (seen and a == 0 and _same(name, last)), frame.iloc[a:b]))
            last, seen = name, True
        yield batch, found


def _ends(rows: DataFrame, part: str, key: str, block: Block) -> dict[int, tuple[Any, bool]]:
    """For every partition with rows: the state it comes in with, and whether its last group goes on in the next one.

    The driver sees one row per partition: two keys and a state.
    """
    kind = rows.schema[key].dataType
    schema = StructType([StructField("part", rows.schema[part].dataType), StructField("first", kind), StructField("last", kind)]).add("single", "boolean").add("state", "binary")
    target = to_arrow_schema(schema)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first = name = None
        groups, state = 0, block.start
        for batch, found in _pieces(batches, key):
            if number is None:
                number, first = batch.column(part)[0].as_py(), found[0][0]
            for name, begins, piece in found:
                if begins:
                    groups, state = groups + 1, block.start
                state = block.run(state, piece)[0]
        if number is not None:
            yield pa.RecordBatch.from_pydict({"part": [number], "first": [first], "last": [name], "single": [groups == 1], "state": [pickle.dumps(state)]}, schema=target)

    ends: dict[int, tuple[Any, bool]] = {}
    before, carried = None, block.start
    for row in rows.mapInArrow(summarise, schema).orderBy("part").collect():
        comes_in = before is not None and _same(before["last"], row["first"])
        if comes_in:
            ends[before["part"]] = (ends[before["part"]][0], True)
        ends[row["part"]] = (carried if comes_in else block.start, False)
        own = pickle.loads(row["state"])
        carried = block.join(carried, own) if comes_in and row["single"] else own
        before = row
    return ends


def _column(values: list, kind: pa.DataType) -> pa.Array:
    joined = pd.concat([pd.Series(v) for v in values], ignore_index=True)
    return pa.Array.from_pandas(joined).cast(kind)


def scan(df: DataFrame, key: str, seq: str, block: Block, name: str, kind: str) -> DataFrame:
    """``df`` with a column ``name`` of type ``kind``: what ``block`` gives for every row of its group, in the order of ``seq``.

    A column that had that name is replaced. Null keys are a group. Equal ``seq`` in a group have no order of their own.
    Runs two jobs (the sort is checkpointed, and one row per partition comes to the driver). An empty table has no rows.
    """
    rows, part = _sorted(df, key, seq)
    ends = _ends(rows, part, key, block)
    kept = [c for c in df.columns if c != name]
    schema = StructType([*(rows.schema[c] for c in kept), StructField(name, _parse_datatype_string(kind))])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first = block.start, True
        for batch, found in _pieces(batches, key):
            results = []
            for _, begins, piece in found:
                if first:
                    state, first = ends[batch.column(part)[0].as_py()][0], False
                elif begins:
                    state = block.start
                state, result = block.run(state, piece)
                results.append(result)
            columns = [batch.column(c).cast(target.field(c).type) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, _column(results, target.field(name).type)], schema=target)

    return rows.mapInArrow(run, schema)


def fold(df: DataFrame, key: str, seq: str, block: Block, kind: str) -> DataFrame:
    """``(key, value)`` for every group: what ``block.finish`` makes of the state after all its rows in the order of ``seq``.

    The same jobs as ``scan``; null keys are a group.
    """
    rows, part = _sorted(df, key, seq)
    ends = _ends(rows, part, key, block)
    value: DataType = _parse_datatype_string(kind)
    schema = StructType([StructField("key", rows.schema[key].dataType), StructField("value", value)])
    key_kind, value_kind = to_arrow_type(rows.schema[key].dataType), to_arrow_type(value)

    def out(held: list[tuple[Any, Any]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], key_kind), pa.array([v for _, v in held], value_kind)], names=["key", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[Any, Any]] = []
        state, end, name = block.start, None, None
        for batch, found in _pieces(batches, key):
            for own, begins, piece in found:
                if end is None:
                    end = ends[batch.column(part)[0].as_py()]
                    state = end[0]
                elif begins:
                    held.append((name, block.finish(state)))
                    state = block.start
                state, name = block.run(state, piece)[0], own
                if len(held) >= _HELD:
                    yield out(held)
                    held = []
        if end is not None and not end[1]:
            held.append((name, block.finish(state)))
        if held:
            yield out(held)

    return rows.mapInArrow(run, schema)


def running_total(value: str) -> Block:
    """``scan``: the sum of ``value`` up to each row (nulls add nothing); ``fold``: the group's sum."""

    def run(state, rows):
        result = state + rows[value].fillna(0).cumsum()
        return result.iloc[-1].item(), result

    return Block(0, run, lambda a, b: a + b, lambda state: state)


def clamped_balance(value: str, floor: float = 0.0) -> Block:
    """``scan``: a balance that starts at ``floor``, takes every ``value``, and never falls below ``floor``; ``fold``: where it ends.

    Built-in windows cannot say it, as each row depends on the balance before. The state of a run of rows is the sum of its
    values and the balance it leaves, from which a run with any balance before can be told.
    """

    def run(state, rows):
        total, low = state
        result = []
        for v in rows[value].fillna(0).tolist():
            total, low = total + v, max(floor, low + v)
            result.append(low)
        return (total, low), result

    def join(left, right):
        # After the floor was met, what came before is forgotten; else the values add up.
        return left[0] + right[0], max(right[1], left[1] + right[0])

    return Block((0.0, floor), run, join, lambda state: state[1])


def _alike(a, b) -> bool:
    return bool(pd.isna(a) and pd.isna(b)) or bool(not pd.isna(a) and not pd.isna(b) and a == b)


@dataclass(frozen=True)
class _Runs:
    """Runs of equal values: the first run's value and length, the last run's, the longest, and whether there is one run only."""

    head: Any = None
    head_n: int = 0
    tail: Any = None
    tail_n: int = 0
    longest: int = 0
    one: bool = True


def longest_run(value: str) -> Block:
    """``scan``: for each row the length so far of the run of equal ``value`` that it is in; ``fold``: the longest run."""

    def run(state, rows):
        values = rows[value]
        new = (values != values.shift()) & ~(values.isna() & values.shift().isna())
        goes_on = state.head_n > 0 and _alike(values.iloc[0], state.tail)
        new.iloc[0] = not goes_on
        lengths = (~new).groupby(new.cumsum()).cumcount() + 1
        if goes_on:
            lengths = lengths.where(new.cumsum() > 0, lengths + state.tail_n)
        first_end = int((new.cumsum() == (0 if goes_on else 1)).sum())
        if state.head_n == 0:
            head, head_n, one = values.iloc[0], first_end, first_end == len(values)
        else:
            grown = state.one and goes_on
            head, head_n = state.head, state.head_n + (first_end if grown else 0)
            one = grown and first_end == len(values)
        tail_n = int(lengths.iloc[-1])
        made = _Runs(head, head_n, values.iloc[-1], tail_n, max(state.longest, int(lengths.max())), one)
        return made, lengths

    def join(left, right):
        if not left.head_n or not right.head_n:
            return left if left.head_n else right
        meet = _alike(left.tail, right.head)
        middle = left.tail_n + right.head_n if meet else 0
        head_n = middle if meet and left.one else left.head_n
        tail_n = middle if meet and right.one else right.tail_n
        return _Runs(left.head, head_n, right.tail, tail_n, max(left.longest, right.longest, middle), meet and left.one and right.one)

    return Block(_Runs(), run, join, lambda state: state.longest)
