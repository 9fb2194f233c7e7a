"""Numbers and rows as text: print format, number formats and templates."""

from __future__ import annotations

import re
from decimal import Decimal
from string import Formatter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.numbers import rint_scaled

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType, T.DecimalType)


def _unusual(c: Column, text: Column) -> Column:
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(c == F.lit(float("inf")), F.lit("inf"))
        .when(c == F.lit(float("-inf")), F.lit("-inf"))
        .otherwise(text)
    )


def fixed_decimals(c: Column, digits: int, grouped: bool = False) -> Column:
    """``c`` with exactly ``digits`` decimals, rounded half-even on its exact binary value."""
    c = c.cast("double")
    size = F.abs(c)
    negative_zero = (c == 0) & c.cast("string").startswith("-")
    sign = F.when((c < 0) | negative_zero, F.lit("-")).otherwise(F.lit(""))
    if digits == 0:
        whole = F.rint(size).cast("bigint")
        text = F.format_number(whole, 0) if grouped else whole.cast("string")
        exact = size < F.lit(2.0**62)
    else:
        steps = rint_scaled(size, digits).cast("bigint")
        if grouped:
            front = F.format_number(F.floor(steps / F.lit(10**digits)), 0)
            text = F.concat(front, F.lit("."), F.lpad((steps % F.lit(10**digits)).cast("string"), digits, "0"))
        else:
            text = (steps.cast("decimal(17,0)") * F.lit(Decimal(1).scaleb(-digits))).cast("string")
        exact = size < F.lit(2.0**53 / 10.0**digits)
    # beyond that, what follows the point has few binary digits and scales without an error
    base = F.floor(size)
    rest = F.rint((size - base.cast("double")) * F.lit(10.0**digits)).cast("bigint")
    front = F.format_number(base, 0) if grouped else base.cast("string")
    large = F.concat(front, F.lit("."), F.lpad(rest.cast("string"), digits, "0")) if digits else front
    huge = F.format_string(f"%{',' if grouped else ''}.{digits}f", size)
    text = F.when(exact, text).when(size < F.lit(2.0**62), large).otherwise(huge)
    return F.when(c.isNotNull(), _unusual(c, F.concat(sign, text)))


def number_text(c: Column) -> Column:
    """Print format of a floating number: six decimals at most, no trailing zeros."""
    text = F.rtrim(F.rtrim(fixed_decimals(c, 6), F.lit("0")), F.lit("."))
    return F.when(F.isnan(c), F.lit("nan")).otherwise(text)


def shortest_text(c: Column) -> Column:
    """The shortest decimal text that reads back as the same number (``2.5``, ``3.0``, ``1e+16``)."""
    c = c.cast("double")
    size = F.abs(c)
    text = c.cast("string")
    large = F.when((size >= 1e7) & (size < 1e16), c).cast("decimal(38,16)").cast("string")
    small = F.when((size >= 1e-4) & (size < 1e-3), c).cast("decimal(38,28)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(F.coalesce(large, small), "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1)
    digits = F.regexp_replace(power, "-", "")
    scientific = F.concat(
        mantissa,
        F.when(power.startswith("-"), F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits),
    )
    return _unusual(
        c,
        F.when(large.isNotNull() | small.isNotNull(), trimmed)
        .when(text.contains("E"), scientific)
        .otherwise(text),
    )


def value_text(c: Column, dtype: T.DataType) -> Column:
    """Print format of any value: lists and pairs are joined by a blank, null is ``None``."""
    if isinstance(dtype, FLOATING):
        text = number_text(c)
    elif isinstance(dtype, T.BooleanType):
        text = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    elif isinstance(dtype, T.ArrayType):
        text = F.array_join(F.transform(c, lambda x: value_text(x, dtype.elementType)), " ")
    elif isinstance(dtype, T.StructType):
        text = F.concat_ws(" ", *[value_text(c[f.name], f.dataType) for f in dtype.fields])
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("None"))


def plain_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a value as written in a program: floating numbers keep their shortest form."""
    return shortest_text(c) if isinstance(dtype, FLOATING) else value_text(c, dtype)


def padded(text: Column, width: int, align: str, fill: str = " ") -> Column:
    """Pad to ``width`` without ever cutting; centring puts the odd blank on the right."""
    if align == ">":
        wide = F.lpad(text, width, fill)
    elif align == "<":
        wide = F.rpad(text, width, fill)
    else:
        left = F.floor((F.lit(width) - F.length(text)) / F.lit(2)).cast("int")
        wide = F.rpad(F.concat(F.repeat(F.lit(fill), left), text), width, fill)
    return F.when(F.length(text) < width, wide).otherwise(text)


SPEC = re.compile(
    r"(?:(?P<fill>.)?(?P<align>[<>^=]))?(?P<sign>[-+ ])?(?P<zero>0)?(?P<width>\d+)?(?P<mark>[,_])?(?:\.(?P<digits>\d+))?(?P<kind>[dfFeEgG%s])?"
)


def significant_digits(c: Column, spec: str) -> Column:
    """``c`` under a format of kind ``e`` or ``g``: so many significant digits of its exact binary value, ties to even.

    The value of a double has up to 767 digits; no built-in expression has them, so batches of values go through an
    Arrow function. Whole numbers go through double, as they do in any such format.
    """

    @F.arrow_udf("string")
    def formatted(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else format(v, spec) for v in values.to_pylist()], pa.string())

    return formatted(c.cast("double"))


def spec_text(c: Column, dtype: T.DataType, spec: str) -> Column:
    """``c`` under a number or text format: ``.2f``, ``,``, ``_d``, ``+.1f``, ``05d``, ``.1%``, ``.3e``, ``g``, ``>8``, ``=+9.2f``."""
    if not spec:
        return value_text(c, dtype)
    parts = SPEC.fullmatch(spec)
    if parts is None:
        raise ValueError(f"unsupported format {spec!r}")
    number = isinstance(dtype, WHOLE + FLOATING)
    kind, mark = parts["kind"], parts["mark"]
    comma = bool(mark)
    if (kind not in (None, "s") or comma or parts["sign"] or parts["align"] == "=") and not number:
        raise ValueError(f"format {spec!r} needs a number, not {dtype.simpleString()}")
    if kind == "d" and not isinstance(dtype, WHOLE):
        raise ValueError(f"format {spec!r} needs a whole number")
    if kind == "s" and number:
        raise ValueError(f"format {spec!r} needs a text, not {dtype.simpleString()}")
    if kind in ("e", "E", "g", "G"):
        return significant_digits(c, spec)
    if kind in ("f", "F"):
        text = fixed_decimals(c, int(parts["digits"] or 6), comma)
        text = F.upper(text) if kind == "F" else text
    elif kind == "%":
        text = F.concat(fixed_decimals(c.cast("double") * F.lit(100.0), int(parts["digits"] or 6), comma), F.lit("%"))
    elif parts["digits"] and number:
        raise ValueError(f"format {spec!r}: give a kind, such as f")
    elif comma and isinstance(dtype, WHOLE):
        text = F.format_number(c, 0)
    elif comma:
        short = plain_text(c, dtype)
        usual = F.abs(c.cast("double")) < F.lit(1e16)
        parted = F.concat(
            F.when(short.startswith("-"), F.lit("-")).otherwise(F.lit("")),
            F.format_number(F.floor(F.when(usual, F.abs(c.cast("double")))), 0),
            F.lit("."),
            F.substring_index(short, ".", -1),
        )
        text = F.when(usual & ~short.contains("e"), parted).otherwise(short)
    else:
        text = plain_text(c, dtype)
        if parts["digits"]:
            text = F.left(text, F.lit(int(parts["digits"])))
    if mark == "_":
        text = F.translate(text, ",", "_")
    if parts["sign"] in ("+", " "):
        text = F.when(text.startswith("-"), text).otherwise(F.concat(F.lit(parts["sign"]), text))
    if not parts["width"]:
        return text
    width, align, fill = int(parts["width"]), parts["align"], parts["fill"]
    if parts["zero"]:
        align, fill = align or ("=" if number else "<"), fill or "0"
    fill = fill or " "
    if align == "=":
        sign = F.regexp_extract(text, "^[-+ ]", 0)
        body = F.substr(text, F.length(sign) + 1)
        if mark and fill == "0" and parts["zero"]:
            return F.concat(sign, _grouped_zeros(body, F.lit(width) - F.length(sign), mark))
        return F.concat(sign, F.repeat(F.lit(fill), F.greatest(F.lit(width) - F.length(text), F.lit(0))), body)
    return padded(text, width, align or (">" if number else "<"), fill)


def _grouped_zeros(body: Column, width: Column, mark: str) -> Column:
    """Zeros in front of a grouped number up to ``width``, grouped too; a mark never comes first, so it may get one wider."""
    whole = F.regexp_extract(body, rf"^[0-9{mark}]*", 0)
    behind = F.substr(body, F.length(whole) + 1)
    room = F.greatest(width - F.length(behind), F.length(whole))
    digits = room - F.floor(room / 4).cast("int") + F.when(room % 4 == 0, 1).otherwise(0)  # a mark in front takes a digit before it
    filled = F.lpad(F.regexp_replace(whole, mark, ""), digits, F.lit("0"))
    grouped = F.reverse(F.regexp_replace(F.reverse(filled), r"(\d{3})(?=\d)", "$1" + mark))
    plain = F.regexp_replace(body, "[0-9].*", "") != ""  # inf and nan have no groups
    return F.when(plain, F.lpad(body, F.greatest(width, F.length(body)), F.lit("0"))).otherwise(F.concat(grouped, behind))


def _filled(text: str, piece) -> Column:
    """One ``concat`` of the literal parts of ``text`` and ``piece(name, spec)`` for its fields."""
    pieces: list[Column] = []
    automatic = 0
    for literal, name, spec, conversion in Formatter().parse(text):
        if conversion or (name and ("." in name or "[" in name)):
            raise ValueError(f"field {name!r}: conversions and parts of values are not supported")
        if literal:
            pieces.append(F.lit(literal))
        if name is None:
            continue
        if name == "":
            name, automatic = str(automatic), automatic + 1
        pieces.append(piece(name, spec or ""))
    return F.concat(*pieces) if pieces else F.lit("")


def template(text: str, schema: T.StructType, fields: list[str] | None = None) -> Column:
    """A row filled into ``text``: ``{0}`` is the first of ``fields``, ``{name}`` a column."""
    fields = fields or schema.names

    def piece(name: str, spec: str) -> Column:
        column = fields[int(name)] if name.isdigit() else name
        return spec_text(F.col(f"`{column}`"), schema[column].dataType, spec)

    return _filled(text, piece)


def items_template(text: str, items: Column, dtype: T.ArrayType) -> Column:
    """An array filled into ``text``: ``{0}`` is its first element."""
    return _filled(text, lambda name, spec: spec_text(F.get(items, F.lit(int(name))), dtype.elementType, spec))
