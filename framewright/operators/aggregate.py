"""Whole-table and grouped aggregates, statistics and pivots."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.hashes import fingerprints
from framewright.functions.numbers import round_even
from framewright.operators.sketches import quantile_error
from framewright.session import cut_lineage

SKETCH_SIZE = 4_096
SMALL_GROUP = 100_000  # rows of groups that are kept whole: a bracket would spare little
FEW_GROUPS = 1_000  # groups whose brackets are sent to every task, a few numbers each


def total(c) -> Column:
    """Sum that skips nulls; the sum of nothing is zero."""
    return F.coalesce(F.sum(c), F.lit(0))


def rows() -> Column:
    """Number of rows."""
    return F.count(F.lit(1))


def rows_where(predicate: Column) -> Column:
    """Number of rows that meet a condition."""
    return F.count_if(predicate)


def share(predicate: Column, digits: int = 1) -> Column:
    """Percentage of rows that meet a condition."""
    return round_even(F.try_divide(F.count_if(predicate), rows()) * 100, digits)


def summarise(df: DataFrame, **measures: Column) -> DataFrame:
    """One row with the named measures over all rows."""
    return df.agg(*[m.alias(name) for name, m in measures.items()])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def wide_columns(df: DataFrame, measure: Callable[[Column], Column], names: list[str] | None = None) -> DataFrame:
    """One row with ``measure`` of every column (text columns too), each in its own type."""
    return df.agg(*[measure(F.col(n)).alias(n) for n in names or df.columns])


def agg_all_columns(df: DataFrame, measure: Callable[[Column], Column], names: list[str] | None = None) -> DataFrame:
    """``measure`` of every numeric column as ``(column, value)`` rows, from one pass over the table.

    The long form has one type, double; ``wide_columns`` keeps whole numbers above 2^53 and texts exact.
    """
    names = names or numeric_columns(df)
    wide = df.agg(*[measure(F.col(n)).cast("double").alias(n) for n in names])
    return wide.unpivot([], names, "column", "value")


def by(df: DataFrame, key, value: Column, seq: str | None = None, keep_null: bool = False) -> DataFrame:
    """``(key, value)`` for every group; with ``seq`` also the place where the group was first seen.

    Partial aggregation runs before the shuffle, so a hot group costs one row per task. Rows with
    a null key form no group unless ``keep_null``.
    """
    key = F.col(key) if isinstance(key, str) else key
    kept = df if keep_null else df.where(key.isNotNull())
    measures = [value.alias("value")] + ([F.min(seq).alias("first_seen")] if seq else [])
    return kept.groupBy(key.alias("key")).agg(*measures)


def by_many(df: DataFrame, key, keep_null: bool = False, **measures: Column) -> DataFrame:
    """Several named measures for every group, from one shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    kept = df if keep_null else df.where(key.isNotNull())
    return kept.groupBy(key.alias("key")).agg(*[m.alias(name) for name, m in measures.items()])


def by_block(df: DataFrame, partial, partial_schema: str, key: str, **merge: Column) -> DataFrame:
    """A block written in pandas for every group, as partial results that Spark merges.

    ``partial`` turns one batch of rows (of any mix of groups) into a few rows per group; the
    ``merge`` aggregates combine these by ``key``. No group is ever brought together as rows, so
    the size of a group does not matter.
    """

    def batches(frames):
        for frame in frames:
            yield partial(frame)

    return df.mapInPandas(batches, partial_schema).groupBy(key).agg(*[m.alias(n) for n, m in merge.items()])


def nuniq(df: DataFrame, name: str) -> DataFrame:
    """Number of distinct values of a column, nulls not counted."""
    return df.agg(F.count_distinct(name).alias("value"))


def nuniq_rows(df: DataFrame) -> DataFrame:
    """Number of distinct rows, counted by their hashes: 16 bytes of a row are shuffled, whatever its width."""
    one, two = fingerprints(df.columns)
    return df.select(one.alias("one"), two.alias("two")).distinct().agg(rows().alias("value"))


def percentiles(df: DataFrame, value: str, fractions: dict[str, float], by: tuple[str, ...] = (), few_groups: bool | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of ``fractions``.

    With ``few_groups`` (the default without ``by``) a sketch per group first brackets every percentile; rows outside
    the brackets are only counted, so little is left to sort. Otherwise, and with more than ``FEW_GROUPS`` groups after
    all, the distinct values are sorted. Both give the same values; the caller knows which suits the table. Rows with
    a null key are a group as in SQL.
    """
    by = tuple(by)
    few_groups = not by if few_groups is None else few_groups
    v = F.col(value).cast("double")
    values = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    if few_groups:
        result = _bracketed(values, fractions, by)
        if result is not None:
            return result
    counts = values.groupBy(*by, "_v").agg(rows().alias("_n"))
    spots = [(F.col("_all") - 1) * F.lit(float(f)) for f in fractions.values()]
    found = _values_at(counts, by, F.array(*[F.floor(x) for x in spots], *[F.ceil(x) for x in spots]))
    return found.groupBy(*by).agg(*[_interpolated(x).alias(name) for name, x in zip(fractions, spots)])


def _interpolated(spot: Column, among: Column | None = None) -> Column:
    """The value at a fractional rank, from the values at the ranks below and above."""
    keep = F.lit(True) if among is None else among
    low = F.max(F.when(keep & (F.col("_rank") == F.floor(spot)), F.col("_v")))
    high = F.max(F.when(keep & (F.col("_rank") == F.ceil(spot)), F.col("_v")))
    return low + (high - low) * F.max(F.when(keep, spot - F.floor(spot)))


def _bracketed(values: DataFrame, fractions: dict[str, float], by: tuple[str, ...]) -> DataFrame | None:
    """Percentiles from the rows near them; None if a bracket misses its rank after all, or there are too many groups.

    A sketch's quantiles are within ``quantile_error`` 99 times of 100, the brackets allow for five times that. Small groups
    are kept whole. The brackets go to the rows, which stay where they were read until those outside are counted: a join
    that shuffles would bring a group together in one task.
    """
    names, wanted, slack = list(fractions), [float(f) for f in fractions.values()], 5 * quantile_error(SKETCH_SIZE)
    ends = F.array(*[F.lit(e) for f in wanted for e in (max(f - slack, 0.0), min(f + slack, 1.0))])
    sketch = cut_lineage(
        values.groupBy(*by).agg(
            rows().alias("_all"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
            F.kll_sketch_agg_double("_v", SKETCH_SIZE).alias("_sketch"),
        ).withColumn("_ends", F.when(F.col("_all") > 0, F.kll_sketch_get_quantile_double("_sketch", ends))).drop("_sketch")
    )
    if by and sketch.limit(FEW_GROUPS + 1).count() > FEW_GROUPS:
        return None
    pieces = []
    for i, f in enumerate(wanted):
        whole = F.col("_all") <= SMALL_GROUP
        low = F.when(whole | F.lit(f <= slack), F.col("_min")).otherwise(F.col("_ends")[2 * i])
        high = F.when(whole | F.lit(f >= 1 - slack), F.col("_max")).otherwise(F.col("_ends")[2 * i + 1])
        # a value below the bracket is counted as null, a value above it falls out
        piece = F.struct(F.lit(i).alias("_f"), F.when(F.col("_v") >= low, F.col("_v")).alias("_v"))
        pieces.append(F.when(F.col("_v") <= high, piece))
    if by:  # a missing key is a group, too: an equality would lose it, and a lost group costs the general way
        groups = sketch.select(*(F.col(c).alias(f"_group{i}") for i, c in enumerate(by)), "_all", "_min", "_max", "_ends")
        same = [F.col(c).eqNullSafe(F.col(f"_group{i}")) for i, c in enumerate(by)]
        near = values.join(F.broadcast(groups), same)  # FEW_GROUPS rows at most
    else:
        bounds = {c: sketch.select(c).scalar() for c in ("_all", "_min", "_max", "_ends")}
        near = values.select("_v", *[c.alias(name) for name, c in bounds.items()])
    near = near.select(*by, "_all", F.inline(F.array(*pieces))).where(F.col("_f").isNotNull())
    counts = near.groupBy(*by, "_f", "_all", "_v").agg(rows().alias("_n"))
    spot = (F.col("_all") - 1) * F.get(F.array(*[F.lit(f) for f in wanted]), F.col("_f"))
    found = _values_at(counts, (*by, "_f"), F.array(F.floor(spot), F.ceil(spot)), total="_all")
    result = found.groupBy(*by).agg(*[_interpolated(spot, F.col("_f") == i).alias(n) for i, n in enumerate(names)])
    if by:  # every group has a row, so that what is missing shows in it
        result = groups.join(result, same, "left").select(*(F.col(f"_group{i}").alias(c) for i, c in enumerate(by)), *names)
    result = cut_lineage(result)
    missing = sum((F.col(n).isNull().cast("int") for n in names), F.lit(0)) > 0
    empty = [] if by else [sketch.select("_all").scalar() > 0]  # no rows at all have no percentile
    return result if result.where(reduce(lambda a, b: a & b, [missing, *empty])).limit(1).count() == 0 else None


def _values_at(counts: DataFrame, keys: tuple[str, ...], ranks: Column, total: str | None = None) -> DataFrame:
    """``(keys, _all, _rank, _v)``: the value at every wanted rank (from 0) of every group.

    ``counts`` holds each distinct value once with its number of rows, null for rows that come
    first. The values are range-sorted and checkpointed. Totals per partition tell which
    partitions hold the wanted ranks; only those are looked at again. No task holds a whole group.
    """
    ranked = cut_lineage(counts.orderBy(*keys, F.asc_nulls_first("_v")).withColumn("_part", F.spark_partition_id()))

    # one row per group and partition: what lies before it, and which ranks fall into it
    size = [F.sum("_n").alias("_size")] + ([F.max(total).alias("_all")] if total else [])
    spans = ranked.groupBy(*keys, "_part").agg(*size)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    if total is None:
        spans = spans.withColumn("_all", F.sum("_size").over(whole))
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_size"))
    spans = spans.withColumn("_ranks", F.array_distinct(F.filter(ranks, inside))).where(F.size("_ranks") > 0)

    # running counts inside the partitions that hold a wanted rank
    at = F.struct(*keys, "_part").alias("_at")  # equal also where keys are null
    near = ranked.select(*keys, at, "_v", "_n").join(spans.select(at, "_before", "_all", "_ranks"), "_at")
    upto = Window.partitionBy("_at").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    here = F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_n")))
    return near.select(*keys, "_all", "_v", F.explode(here).alias("_rank"))


def median(df: DataFrame, value: str, by: tuple[str, ...] = (), name: str = "median", few_groups: bool | None = None) -> DataFrame:
    """Exact median (of every group); ``few_groups`` as in ``percentiles``."""
    return percentiles(df, value, {name: 0.5}, by, few_groups)


def pivot(df: DataFrame, index: str, columns: str, values: list, measure: Callable[[Column], Column]) -> DataFrame:
    """One row per ``index`` and one column per value of ``columns``.

    ``measure`` gets the condition that selects a cell's rows; all cells come from one shuffle.
    """
    return df.groupBy(index).agg(*[measure(F.col(columns) == F.lit(v)).alias(str(v)) for v in values])


def pivot_count(df: DataFrame, index: str, columns: str, values: list) -> DataFrame:
    """Row counts per cell; a cell without rows is zero."""
    return pivot(df, index, columns, values, F.count_if)


def group_sum_sorted(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Sum for every group, smallest first."""
    return by(df, key, total(value)).orderBy("value", "key")


