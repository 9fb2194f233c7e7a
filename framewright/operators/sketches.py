"""Mergeable sketches: distinct counts and quantiles from one pass, kept as a table and united without the rows.

A sketch table has a row per group and part (a day, a partition) with the sketch as binary. Parts are written as they
come; ``merge_*`` unites any of them, and the estimates are columns of the merged table. A sketch's size does not grow
with the rows behind it, partial sketches are made before the shuffle, and nothing runs while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LG_BUCKETS = 15
QUANTILE_SIZE = 2_000


def _token(df: DataFrame, name: str) -> Column:
    """A value in a type that the sketch takes; equal values have equal tokens (0.0 and -0.0, too)."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):  # a sketch does not count empty ones
        return F.concat(F.lit("=").cast(kind), value)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return (value.cast("double") + F.lit(0.0)).cast("string")
    return value.cast("string")


def distinct_error(lg_buckets: int = LG_BUCKETS) -> float:
    """Relative standard error of a distinct count; two of three estimates are within it, all but one in 300 within three times."""
    return 1.04 / 2 ** (lg_buckets / 2)


def distinct_sketches(df: DataFrame, value: str, by: tuple[str, ...] = (), lg_buckets: int = LG_BUCKETS) -> DataFrame:
    """``by`` and ``sketch``: a distinct-count sketch of ``value`` for every group. Nulls are not counted.

    A group of nulls alone has a sketch of nothing. At most 2^``lg_buckets`` bytes a sketch (4 to 21).
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(_token(df, value), lg_buckets).alias("sketch"))


def merge_distinct(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Unite the sketches of each group of ``by``, also those of different sizes (the smaller one's error holds then)."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch", True).alias("sketch"))


def distinct_estimate(sketch="sketch") -> Column:
    """The number of distinct values behind a sketch."""
    return F.hll_sketch_estimate(sketch)


def quantile_error(size: int = QUANTILE_SIZE) -> float:
    """Rank error of a quantile as a share of all rows, met by 99 of 100 quantiles (the sketch's published fit of its error)."""
    return 2.296 / size**0.9021


def quantile_sketches(df: DataFrame, value: str, by: tuple[str, ...] = (), size: int = QUANTILE_SIZE) -> DataFrame:
    """``by`` and ``sketch``: a quantile sketch of the numbers ``value`` for every group. Null and NaN are not counted.

    Values go through double. Up to ``size`` rows (8 to 65535) the sketch is exact.
    """
    number = F.col(f"`{value}`").cast("double")
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.when(~F.isnan(number), number), size).alias("sketch"))


def merge_quantiles(sketches: DataFrame, by: tuple[str, ...] = (), size: int = QUANTILE_SIZE) -> DataFrame:
    """Unite the quantile sketches of each group of ``by``."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))


def quantile(fraction: float, sketch="sketch") -> Column:
    """The value with ``fraction`` of the rows up to it, within ``quantile_error`` ranks; null if there are no rows."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(fraction))))


def rank_of(value, sketch="sketch") -> Column:
    """The share of rows up to ``value``, within ``quantile_error``; null if there are no rows."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_rank_double(sketch, value))


def sketched_rows(sketch="sketch") -> Column:
    """The number of rows behind a quantile sketch."""
    return F.kll_sketch_get_n_double(sketch)
