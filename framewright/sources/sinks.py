"""Writers and report lines.

Every writer leaves a folder of part files, written by all tasks at once; part names sort in row
order, so an ordered table keeps its order. The frame is handed back for the next step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.formatting import FLOATING, fixed_decimals, template, value_text

# Fixed values of the aligned table: decimals shown, and when a column goes over to powers of ten.
SHOWN_DECIMALS, LONGEST_FIXED, LARGE = 6, 12, 1e6


def save_csv(df: DataFrame, folder: str) -> DataFrame:
    """The table as CSV with a header. Blanks and line breaks in cells are kept; ``readers.csv`` reads the latter with
    ``multi_line``."""
    df.write.mode("overwrite").csv(
        folder, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return df


def value_lines(df: DataFrame, sep: str = " ", alias: str = "line", keep=()) -> DataFrame:
    """Every row as one text, its values in print format and joined by ``sep``."""
    shown = [f for f in df.schema.fields if f.name not in keep]
    parts = [value_text(F.col(f"`{f.name}`"), f.dataType) for f in shown]
    return df.select(*keep, F.concat_ws(sep, *parts).alias(alias))


def key_value_lines(df: DataFrame, key: str = "key", value: str = "value", sep: str = ": ", keep=()) -> DataFrame:
    """``key: value`` lines of a key/value frame."""
    return value_lines(df.select(*keep, key, value), sep, keep=keep)


def fmt(df: DataFrame, text: str, alias: str = "line", fields: list[str] | None = None, keep=()) -> DataFrame:
    """Every row filled into a template."""
    return df.select(*keep, template(text, df.schema, fields).alias(alias))


def save_lines(df: DataFrame, folder: str) -> DataFrame:
    """One line per row, values in print format."""
    value_lines(df, alias="value").write.mode("overwrite").text(folder)
    return df


def save_key_values(df: DataFrame, folder: str, key: str = "key", value: str = "value") -> DataFrame:
    """``key,value`` lines without a header."""
    key_value_lines(df, key, value, sep=",").write.mode("overwrite").text(folder)
    return df


def scalar_lines(df: DataFrame) -> DataFrame:
    """The print line of a table of one value; a null prints nothing: no line."""
    return value_lines(df.where(F.col(f"`{df.columns[0]}`").isNotNull()))


def save_scalar(df: DataFrame, folder: str) -> DataFrame:
    """The single value of ``df`` (one row, one column) in print format, without a line end; null is saved as ``None``.

    One part file holds exactly the value's bytes. Spark's own writer commits it or leaves nothing: it ends a text with
    whatever stands for the line end, which here is the value's last character. The value goes through the driver.
    """
    value = value_lines(df).first()["line"]
    rows = [(value[:-1],)] if value else []
    line_end = {"lineSep": value[-1]} if value else {}
    df.sparkSession.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").options(**line_end).text(folder)
    return df


def _shown(f: T.StructField, i: int) -> Column:
    """A cell of an aligned table, from the columns that ``table_lines`` has put together."""
    c = F.col(f"v{i}")
    if not isinstance(f.dataType, FLOATING):
        return value_text(c, f.dataType)
    usual, text, stats = F.col(f"u{i}"), F.col(f"t{i}"), F.col("stats")[f"f{i}"]
    return (
        F.when(c.isNull() | F.isnan(c), F.lit("NaN"))
        .when(usual & stats["powers"], F.format_string(f"%.{SHOWN_DECIMALS}e", c))
        .when(usual, F.left(text, F.length(text) - stats["spare"]))
        .otherwise(text)
    )


def table_lines(df: DataFrame, seq: str) -> DataFrame:
    """The table as aligned lines (``at``, ``line``) without ``seq``: at 0 the names, then the rows in the order of ``at``.

    Columns are as wide as their widest cell or name (the name of numbers and truth values with a blank in front),
    right-aligned and parted by a blank. Floating columns show as many
    decimals as their values need, 1 to 6, and go over to powers of ten where a value is too small for them, or large ones get
    long; missing numbers are ``NaN``, other missing values ``None``. One aggregate finds decimals and a second one widths
    (a row each, no job while the plan is built); then every row is a line of its own. ``at`` of a row is its ``seq``, which
    must be above 0.
    """
    fields = [f for f in df.schema.fields if f.name != seq]
    floating = [i for i, f in enumerate(fields) if isinstance(f.dataType, FLOATING)]
    names = [f" {f.name}" if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else f.name for f in fields]

    # Every number's text is made once; the single rows of the two aggregates come in as one column each.
    values = df.select(
        F.col(f"`{seq}`").cast("long").alias("at"),
        *(F.col(f"`{f.name}`").cast("double" if i in floating else f.dataType).alias(f"v{i}") for i, f in enumerate(fields)),
    )
    texts = values.select(
        "*",
        *((F.abs(F.col(f"v{i}")) < float("inf")).alias(f"u{i}") for i in floating),  # false for NaN, too
        *(fixed_decimals(F.col(f"v{i}"), SHOWN_DECIMALS).alias(f"t{i}") for i in floating),
    )
    measures = []
    for i in floating:
        usual, text, size = F.col(f"u{i}"), F.col(f"t{i}"), F.abs(F.col(f"v{i}"))
        length = F.when(usual, F.length(text))
        zeros = length - F.length(F.rtrim(text, F.lit("0")))
        spare = F.coalesce(F.min(F.least(zeros, F.lit(SHOWN_DECIMALS - 1))), F.lit(SHOWN_DECIMALS - 1))
        small = F.coalesce(F.max(usual & (size > 0) & (size < 10.0**-SHOWN_DECIMALS)), F.lit(False))
        longest = F.coalesce(F.max(length), F.lit(0)) - spare
        large = F.coalesce(F.max(usual & (size > LARGE)), F.lit(False)) & (longest > LONGEST_FIXED)
        measures.append(F.struct(spare.alias("spare"), (small | large).alias("powers")).alias(f"f{i}"))
    if measures:
        texts = texts.withColumn("stats", texts.agg(F.struct(*measures).alias("s")).scalar())
    shown = texts.select("at", *(_shown(f, i).alias(f"c{i}") for i, f in enumerate(fields)))
    widths = shown.agg(F.struct(*(F.greatest(F.coalesce(F.max(F.length(f"c{i}")), F.lit(0)), F.lit(len(n))).alias(f"w{i}") for i, n in enumerate(names))).alias("w"))

    def line(texts: list[Column]) -> Column:
        return F.concat_ws(" ", *(F.lpad(t, F.col(f"wide.w{i}"), F.lit(" ")) for i, t in enumerate(texts))).alias("line")

    head = df.sparkSession.range(1).withColumn("wide", widths.scalar()).select(F.lit(0).cast("long").alias("at"), line([F.lit(n) for n in names]))
    return head.unionByName(shown.withColumn("wide", widths.scalar()).select("at", line([F.col(f"c{i}") for i in range(len(fields))])))
