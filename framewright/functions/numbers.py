"""Arithmetic and rounding rules as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a 53-bit double into two 26-bit halves, so that a half times a power of ten is exact.
SPLITTER = float(2**27 + 1)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def round_even(c: Column, digits: int) -> Column:
    """Column rounding: half-even on the scaled value."""
    c = c.cast("double")
    if digits < 0:
        return F.rint(c / F.lit(10.0**-digits)) * F.lit(10.0**-digits)
    return F.rint(c * F.lit(10.0**digits)) / F.lit(10.0**digits)


def rint_scaled(c: Column, digits: int) -> Column:
    """The integer nearest to ``c * 10^digits``, ties to even, judged on the exact product.

    The floating product can land on a tie that the exact product misses by a hair; the part lost
    in the multiplication tells on which side the exact product lies.
    """
    if digits == 0:
        return F.rint(c)
    scale = F.lit(10.0**digits)
    product = c * scale
    high = c * F.lit(SPLITTER) - (c * F.lit(SPLITTER) - c)
    lost = (high * scale - product) + (c - high) * scale
    floor = product - F.pmod(product, F.lit(1.0))
    tie = (product - floor) == F.lit(0.5)
    return (
        F.when(tie & (lost < 0), floor)
        .when(tie & (lost > 0), floor + F.lit(1.0))
        .otherwise(F.rint(product))
    )


def round_exact(c: Column, digits: int) -> Column:
    """Scalar rounding: half-even on the exact binary value of the number."""
    c = c.cast("double")
    if digits < 0:
        return round_even(c, digits)
    scale = F.lit(10.0**digits)
    # a large number has few binary digits after the point; they scale without an error
    whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")
    return (
        F.when(F.abs(c) < F.lit(2.0**52 / 10.0**digits), rint_scaled(c, digits) / scale)
        .when(F.abs(c) < F.lit(2.0**53), whole + F.rint((c - whole) * scale) / scale)
        .otherwise(c)
    )


def floor_mod(a: Column, n) -> Column:
    """Remainder with the sign of the divisor; a zero divisor gives null."""
    n = as_column(n)
    rest = F.try_mod(a, n)
    return F.when((rest != 0) & ((rest < 0) != (n < 0)), rest + n).otherwise(rest)


def true_div(a: Column, n, strict: bool = False) -> Column:
    """Division of any two numbers as doubles; a zero divisor gives null unless ``strict``."""
    a, n = a.cast("double"), as_column(n).cast("double")
    return a / n if strict else F.try_divide(a, n)


def power(a: Column, n, integral: bool = False) -> Column:
    """``a`` to the power ``n``; with ``integral`` the result is a whole number, exact for every exponent, a column too.

    Repeated squaring on ``bigint``; a result that does not fit raises under ANSI rules, and so does a negative exponent of a
    whole number (a column's when it is met, a literal's at once).
    """
    if not integral:
        return F.pow(a.cast("double"), as_column(n).cast("double"))
    if isinstance(n, Column):
        return _column_power(a.cast("bigint"), n.cast("bigint"))
    if n != int(n) or n < 0:
        raise ValueError(f"a whole number to the power {n} is not whole")
    result, square, n = F.lit(1).cast("bigint"), a.cast("bigint"), int(n)
    while n:
        if n & 1:
            result = result * square
        n >>= 1
        if n:
            square = square * square
    return result


def _column_power(a: Column, n: Column) -> Column:
    """Squaring along the bits of each row's exponent; a square that the exponent does not reach is not made, so none overflows in vain."""
    bits = F.array(*(F.lit(1 << i).cast("bigint") for i in range(6)))

    def step(state: Column, bit: Column) -> Column:
        result = F.when(n.bitwiseAND(bit) != 0, state["result"] * state["square"]).otherwise(state["result"])
        square = F.when(n >= 2 * bit, state["square"] * state["square"]).otherwise(state["square"])
        return F.struct(result.alias("result"), square.alias("square"))

    one = F.lit(1).cast("bigint")
    raised = F.aggregate(bits, F.struct(one.alias("result"), a.alias("square")), step, lambda state: state["result"])
    small = F.when((a == 1) | (n == 0), one).when(a == 0, F.lit(0).cast("bigint")).when(a == -1, F.when(n % 2 == 0, 1).otherwise(-1).cast("bigint"))
    return (
        F.when(a.isNull() | n.isNull(), F.lit(None).cast("bigint"))
        .when(n < 0, F.raise_error(F.lit("a whole number to a negative power is not whole")).cast("bigint"))
        .when(a.between(-1, 1) | (n == 0), small)
        .when(n > 63, F.raise_error(F.lit("the power does not fit 64 bits")).cast("bigint"))
        .otherwise(raised)
    )
