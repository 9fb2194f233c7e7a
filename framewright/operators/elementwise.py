"""Arithmetic, comparison, rounding and letter case on a column, an array or a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import numbers
from framewright.functions.formatting import WHOLE
from framewright.operators.aggregate import numeric_columns
from framewright.operators.select import COMPARE, condition

ARITHMETIC = ("add", "sub", "mul", "div", "mod", "pow")


def arithmetic(c: Column, dtype: T.DataType, op: str, n, whole_exponent: bool = False) -> Column:
    """``c op n``; on text ``add`` appends and ``mul`` repeats.

    ``n`` may be a Column; as the exponent of a whole number it gives a whole number if ``whole_exponent``.
    """
    if isinstance(dtype, T.StringType):
        if op == "add":
            return F.concat(c, numbers.as_column(n))
        if op == "mul":
            return F.repeat(c, numbers.as_column(n))
        raise TypeError(f"{op} does not work on text")
    whole = isinstance(dtype, WHOLE)
    if op == "add":
        return c + n
    if op == "sub":
        return c - n
    if op == "mul":
        return c * n
    if op == "div":
        return numbers.true_div(c, n)
    if op == "mod":
        return numbers.floor_mod(c, n)
    if op == "pow":
        return numbers.power(c, n, integral=whole and (whole_exponent if isinstance(n, Column) else isinstance(n, int) and n >= 0))
    raise ValueError(f"unknown operator {op!r}")


def binary(c: Column, dtype: T.DataType, op: str, n, whole_exponent: bool = False) -> Column:
    """Arithmetic, or a comparison that gives a boolean Column (null where ``c`` is null)."""
    if op in ARITHMETIC:
        return arithmetic(c, dtype, op, n, whole_exponent)
    if op in COMPARE or op in ("eq", "ne"):
        return condition(c, dtype, op, n)
    raise ValueError(f"unknown operator {op!r}")


def _apply(df: DataFrame, name: str, alias: str | None, block: Callable[[Column, T.DataType], Column]) -> DataFrame:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.ArrayType):
        result = F.transform(name, lambda x: block(x, dtype.elementType))
    else:
        result = block(F.col(name), dtype)
    return df.withColumn(alias or name, result)


def math(df: DataFrame, name: str, op: str, n, alias: str | None = None) -> DataFrame:
    """``name op n`` on a column or on every element of an array column; ``n`` may be a Column with a value for each row."""
    whole = isinstance(n, Column) and isinstance(df.select(n).schema[0].dataType, WHOLE)
    return _apply(df, name, alias, lambda c, dtype: binary(c, dtype, op, n, whole))


def math_all_columns(df: DataFrame, op: str, n, names: list[str] | None = None) -> DataFrame:
    """``op n`` on every numeric column (or on ``names``) in one projection."""
    chosen = names or numeric_columns(df)
    return df.select(
        *[
            binary(F.col(f.name), f.dataType, op, n).alias(f.name) if f.name in chosen else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def round_column(df: DataFrame, name: str, digits: int, alias: str | None = None) -> DataFrame:
    """Round a column (half-even on the scaled value) or the elements of an array (exact half-even)."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.ArrayType):
        return df.withColumn(alias or name, F.transform(name, lambda x: numbers.round_exact(x, digits)))
    return df.withColumn(alias or name, numbers.round_even(F.col(name), digits))


def round_all_columns(df: DataFrame, digits: int) -> DataFrame:
    """Round every floating column of a table."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.select(
        *[numbers.round_even(F.col(n), digits).alias(n) if n in floating else F.col(n) for n in df.columns]
    )


def lower(df: DataFrame, name: str, alias: str | None = None) -> DataFrame:
    return _apply(df, name, alias, lambda c, _: F.lower(c))


def upper(df: DataFrame, name: str, alias: str | None = None) -> DataFrame:
    return _apply(df, name, alias, lambda c, _: F.upper(c))
