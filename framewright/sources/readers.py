"""Tables from files, texts, ranges and literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import text as texts
from framewright.operators.select import items
from framewright.sources import ranges

# Cell texts that a CSV reader takes for a missing value.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def csv(spark: SparkSession, path, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV files with a header. Dates stay text; the usual words for a missing value become null.

    Blanks around a cell are part of it. ``multi_line`` reads cells with line breaks, as ``save_csv`` may write
    them: the files are read twice, and still split across tasks (``ranges``). With a ``schema`` the files
    are read once otherwise. Without one, a first distributed pass finds for
    every column whether all its values are whole numbers, numbers or truth values.
    """
    kept = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    names = spark.read.csv(path, multiLine=multi_line, **kept).columns if schema is None else None
    as_text = (
        T.StructType([T.StructField(n, T.StringType()) for n in names])
        if names is not None
        else T.StructType([T.StructField(f.name, T.StringType()) for f in _schema(schema).fields])
    )
    if multi_line:
        # A record at a time goes through the same parser; line ends inside a cell stay as they are.
        options = {k: str(v) for k, v in kept.items() if k != "header"} | {"multiLine": "true", "lineSep": "\n"}
        raw = ranges.records(spark, path).select(F.from_csv("text", _ddl(as_text), options).alias("r")).select("r.*")
    else:
        raw = spark.read.csv(path, schema=as_text, **kept)
    cells = {n: F.when(~F.col(f"`{n}`").isin(MISSING), F.col(f"`{n}`")) for n in raw.columns}
    if schema is not None:
        return raw.select(*[_typed(cells[f.name], f.dataType).alias(f.name) for f in _schema(schema).fields])
    clean = raw.select(*[c.alias(n) for n, c in cells.items()])
    kinds = clean.agg(*[_kind(F.col(f"`{n}`")).alias(n) for n in clean.columns]).first()
    return clean.select(*[_typed(F.col(f"`{n}`"), T.StructType.fromDDL(f"c {kinds[n]}")[0].dataType).alias(n) for n in clean.columns])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def _typed(c: Column, dtype: T.DataType) -> Column:
    return c if isinstance(dtype, T.StringType) else F.btrim(c).cast(dtype)


def _schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _kind(c: Column) -> Column:
    """Name of the narrowest type that holds every value of a text column; nulls make numbers floating."""
    filled, missing = c.isNotNull(), F.count_if(c.isNull()) > 0

    def every(test: Column) -> Column:
        return F.count_if(filled & ~F.coalesce(test, F.lit(False))) == 0

    return (
        F.when(every(c.rlike(r"^\s*[+-]?\d+\s*$") & F.btrim(c).try_cast("bigint").isNotNull()), F.when(missing, "double").otherwise("bigint"))
        .when(every(c.rlike(r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$")), "double")
        .when(every(c.isin("True", "False", "TRUE", "FALSE", "true", "false")) & ~missing, "boolean")
        .otherwise("string")
    )


def read_text(spark: SparkSession, path) -> DataFrame:
    """Every file as one text: ``(path, value)``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Files as lines: ``value``. Large files are split across tasks."""
    return spark.read.text(path)


def lines(df: DataFrame, name: str, *keep: str) -> DataFrame:
    """One row per line of text column ``name``: the columns ``keep``, ``line_no`` (from 1) and ``line``."""
    return df.select(*keep, F.posexplode(texts.lines(F.col(name))).alias("_at", "line")).select(
        *keep, (F.col("_at") + 1).alias("line_no"), "line"
    )


def words(df: DataFrame, name, *keep: str) -> DataFrame:
    """One row per word of a text column: the columns ``keep``, ``word_no`` (from 1) and ``word``."""
    c = F.col(name) if isinstance(name, str) else name
    return df.select(*keep, F.posexplode(texts.words(c)).alias("_at", "word")).select(
        *keep, (F.col("_at") + 1).alias("word_no"), "word"
    )


def reading_order(text_id: str, part_no: str) -> Column:
    """One number that orders parts by text and place: any 64-bit id, any place in an array.

    A single decimal keeps ``min`` in the hash aggregate; a pair of columns would need a sort.
    """
    places = F.lit(2**31).cast("decimal(10,0)")
    return F.col(text_id).cast("decimal(19,0)") * places + F.col(part_no).cast("decimal(10,0)")


def json_files(spark: SparkSession, path, schema=None) -> DataFrame:
    """JSON files holding one value each: an array gives one row per record."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path, multiLine=True)


def json_values(spark: SparkSession, path, element: str = "bigint") -> DataFrame:
    """JSON files holding a list of plain values: one row per value."""
    files = read_text(spark, path)
    return files.select("path", F.explode(F.from_json("value", f"array<{element}>")).alias("value"))


def json_lines(spark: SparkSession, paths, schema) -> DataFrame:
    """Result rows from one or more JSON-lines files, as one table."""
    return spark.read.schema(schema).json(paths)


def parse_json(df: DataFrame, name: str, schema: str, alias: str | None = None) -> DataFrame:
    """JSON text of a column as nested values."""
    return df.withColumn(alias or name, F.from_json(name, schema))


def parse_json_any(df: DataFrame, name: str, alias: str | None = None) -> DataFrame:
    """JSON text of a column as a value of any shape; ``variant_get`` walks into it."""
    return df.withColumn(alias or name, F.parse_json(F.col(name)))


def upto(spark: SparkSession, n: int) -> DataFrame:
    """The numbers 1 to ``n`` as ``value``, made on the executors."""
    return spark.range(1, n + 1).select(F.col("id").alias("value"))


def literal_list(value) -> Column:
    """``"1,2.5,x"`` as an array: numbers stay numbers, a mix of kinds becomes text."""
    found = items(value)
    kinds = {type(x) for x in found}
    if kinds <= {int}:
        return F.array(*[F.lit(x).cast("bigint") for x in found])
    if kinds <= {int, float}:
        return F.array(*[F.lit(float(x)) for x in found])
    return F.array(*[F.lit(str(x)) for x in found])
