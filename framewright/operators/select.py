"""Row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.formatting import plain_text
from framewright.functions.nested import path, walk

COMPARE = {
    "gt": Column.__gt__,
    "ge": Column.__ge__,
    "lt": Column.__lt__,
    "le": Column.__le__,
}


def typed(item):
    """Text that looks like a number becomes that number."""
    if isinstance(item, str):
        for kind in (int, float):
            try:
                return kind(item)
            except ValueError:
                continue
    return item


def items(value) -> list:
    """A list argument: a list as it is, or ``"a,b,c"`` with numbers typed."""
    return list(value) if isinstance(value, (list, tuple, set)) else [typed(x) for x in str(value).split(",")]


def comparable(dtype: T.DataType, value) -> bool:
    """Whether a literal can equal a value of this column type at all."""
    if value is None or isinstance(value, Column):
        return True
    if isinstance(dtype, T.StringType):
        return isinstance(value, str)
    if isinstance(dtype, T.NumericType):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(dtype, T.BooleanType):
        return isinstance(value, (bool, int, float))
    return True


def field_type(df: DataFrame, field) -> T.DataType:
    return df.select(path(field)).schema[0].dataType


def condition(c: Column, dtype: T.DataType, op: str, value) -> Column:
    """``c op value`` as a boolean Column, for the operators eq ne gt ge lt le in nin has.

    ``ne`` and ``nin`` keep nulls, the others drop them. A literal of another type is never equal.
    """
    if op in ("in", "nin"):
        wanted = items(value)
        usable = [v for v in wanted if v is not None and comparable(dtype, v)]
        found = c.isin(usable) if usable else F.lit(False)
        # a missing value is in the list only if the list holds one
        found = F.when(c.isNull(), F.lit(None in wanted)).otherwise(found)
        if op == "nin":
            return ~found
        return c.isin(usable) if usable and None not in wanted else found
    if op == "has":
        if isinstance(dtype, T.StringType):
            return c.contains(str(value))
        return plain_text(c, dtype).contains(str(value)) & c.isNotNull()
    if op not in COMPARE and op not in ("eq", "ne"):
        raise ValueError(f"unknown operator {op!r}")
    if not comparable(dtype, value):
        if op in COMPARE:
            raise TypeError(f"cannot order {dtype.simpleString()} and {value!r}")
        return F.lit(op == "ne")
    other = value if isinstance(value, Column) else F.lit(value)
    if op == "eq":
        return c == other
    if op == "ne":
        return ~c.eqNullSafe(other)
    return COMPARE[op](c, other)


def where(df: DataFrame, field, op: str, value) -> DataFrame:
    """Keep the rows whose ``field`` compares with ``value``.

    ``field`` is a name, a path, a name with dots in backticks, or a Column. ``value`` is a literal, a list, another Column, or a one-value frame turned into a Column with
    ``frame.scalar()``. Plain comparisons stay plain, so they reach the file scan.
    """
    return df.where(condition(path(field), field_type(df, field), op, value))


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type in which values of both types compare as numbers, times or texts; raises if there is none."""
    if left == right:
        return left
    if isinstance(left, T.NumericType) and isinstance(right, T.NumericType):
        if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
            return T.LongType()
        if isinstance(left, T.FractionalType) and isinstance(right, T.FractionalType) and not (
            isinstance(left, T.DecimalType) and isinstance(right, T.DecimalType)
        ):
            return T.DoubleType()
        whole, scale = (max(k) for k in zip(_digits(left), _digits(right), strict=True))
        if whole is None or whole + scale > 38:
            return T.DoubleType()
        return T.DecimalType(whole + scale, scale)
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(left, times) and isinstance(right, times):
        return T.TimestampType()
    if isinstance(left, T.StringType) and isinstance(right, T.StringType):
        return T.StringType()
    raise TypeError(f"{left.simpleString()} and {right.simpleString()} have no values in common")


def _digits(dtype: T.DataType) -> tuple[int, int]:
    """Digits before and after the point that hold every value; a float needs more than a decimal has."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision - dtype.scale, dtype.scale
    return (20, 0) if isinstance(dtype, T.IntegralType) else (38, 38)


def same_key(key: Column, other: Column, types: tuple[T.DataType, T.DataType] | None = None) -> Column:
    """Join condition between rows and a side that was grouped by its key before; null equals null.

    ``types`` are the types of both sides; where they differ, both are cast to a common one first, so that an
    ``int`` key meets a ``bigint`` or a ``double`` one. The hash, a second join key, makes Spark shuffle the
    grouped side anew. Only between two plain shuffles can AQE split the partition of a hot key.
    """
    lost = F.lit(False)
    if types is not None and types[0] != types[1]:
        if isinstance(common_type(*types), T.DoubleType) and any(isinstance(t, T.IntegralType) for t in types):
            # Beyond 2^53 a double would stand for several whole numbers; one that is whole is a 64-bit number exactly.
            (key, lost_key), (other, lost_other) = _whole(key, types[0]), _whole(other, types[1])
            lost = lost_key | lost_other
        else:
            shared = common_type(*types)
            key, other = key.cast(shared), other.cast(shared)
    same = key.eqNullSafe(other) & (F.xxhash64(key) == F.xxhash64(other))
    return same & ~lost if types is not None and types[0] != types[1] else same


def _whole(c: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """A number as a 64-bit whole one, and whether it is a number that is none."""
    if isinstance(dtype, T.IntegralType):
        return c.cast("bigint"), F.lit(False)
    number = c.cast("double")
    fits = (number >= -(2.0**63)) & (number < 2.0**63) & (F.rint(number) == number)
    return F.when(fits, number.cast("bigint")), c.isNotNull() & ~F.coalesce(fits, F.lit(False))


def where_in_table(df: DataFrame, field: str, table: DataFrame, key: str | None = None, negate: bool = False) -> DataFrame:
    """Keep the rows whose ``field`` is (not) among the values held in ``table``.

    Numbers of different types compare by value; values of types that cannot be equal raise a TypeError.
    A semi or anti join on the distinct values: Spark broadcasts them when their measured size
    allows it and otherwise joins by key, splitting partitions that a hot key makes too large.
    """
    wanted = table.select(F.col(key or field).alias("_wanted")).where(F.col("_wanted").isNotNull()).distinct()
    types = (field_type(df, field), wanted.schema["_wanted"].dataType)
    return df.join(wanted, same_key(path(field), F.col("_wanted"), types), "left_anti" if negate else "left_semi")


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Keep the rows for which ``predicate`` is true."""
    return df.where(predicate)


def filter_array(df: DataFrame, name: str, predicate) -> DataFrame:
    """Keep the elements of array column ``name`` for which ``predicate(element)`` is true."""
    return df.withColumn(name, F.filter(name, predicate))


def where_items(df: DataFrame, name: str, field, op: str, value) -> DataFrame:
    """Keep the elements of array column ``name`` whose ``field`` compares with ``value``.

    The field ``it`` is the element itself, otherwise a path into the element.
    """
    steps = [] if field == "it" else str(field).split(".")
    inside = df.select(walk(F.get(name, F.lit(0)), steps).alias("_f")).schema["_f"].dataType
    return filter_array(df, name, lambda x: condition(walk(x, steps), inside, op, value))


def drop_null(df: DataFrame, *names: str) -> DataFrame:
    """Remove the rows with a null in any of ``names`` (in any column if none is given)."""
    return df.dropna("any", subset=list(names) or None)


def drop_value(df: DataFrame, name: str, value) -> DataFrame:
    """Remove the rows whose ``name`` equals ``value``; null removes nulls, otherwise they stay."""
    return df.where(F.col(name).isNotNull() if value is None else condition(F.col(name), df.schema[name].dataType, "ne", value))


def mask_value(df: DataFrame, value) -> DataFrame:
    """Make every cell equal to ``value`` null; rows stay. A null value drops incomplete rows."""
    if value is None:
        return drop_null(df)
    return df.select(
        *[
            F.nullif(F.col(f.name), F.lit(value)).alias(f.name) if comparable(f.dataType, value) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def all_of(*predicates: Column) -> Column:
    return reduce(Column.__and__, predicates)
