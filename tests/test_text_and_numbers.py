"""Text, rounding and number formats, each against Python's own rules on random values."""

import math
import random
import re
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import formatting, numbers, text

ALPHABET = "ab\n\r\v\f\x1c\x1d\x1e\x1f\x85   \xa0　é12.-'_²٣́"


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(3)
    values = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 9))) for _ in range(5000)]
    return spark.createDataFrame([(v,) for v in values], "v string")


@pytest.mark.parametrize(
    "rule, python",
    [
        (text.lines, str.splitlines),
        (text.words, lambda v: re.findall(r"[\w']+", v)),
        (text.strip, str.strip),
        (text.non_blank_lines, lambda v: [x for x in v.splitlines() if x.strip()]),
        (lambda c: text.split_on(c, "."), lambda v: v.split(".")),
        (lambda c: text.slice_text(c, -3, -1), lambda v: v[-3:-1]),
        (lambda c: text.slice_text(c, 1, -2), lambda v: v[1:-2]),
        (lambda c: text.slice_text(c, -4, 3), lambda v: v[-4:3]),
        (lambda c: text.slice_text(c, 2, 5), lambda v: v[2:5]),
        (lambda c: text.slice_text(c, 3, 1), lambda v: v[3:1]),
    ],
)
def test_text_rule_equals_python(texts, rule, python):
    rows = texts.select("v", rule(F.col("v")).alias("got")).collect()
    assert [r for r in rows if r.got != python(r.v)] == []


@pytest.fixture(scope="module")
def doubles(spark):
    rnd = random.Random(1)
    values = [0.0, 0.5, 1.5, 2.5, 0.125, 2.675, 2.135, 1.005, 8.345, 1e-7, -1e-7, 0.0000005, 1e15, 12345678901.123]
    values += [4503599627.3704966, 9007199254.740993, 999999.9999996, 0.9999995, 100.0, 1e7, 0.00012, -2.5]
    for _ in range(5000):
        values += [
            round(rnd.uniform(-1e4, 1e4), rnd.randint(0, 8)),
            rnd.randint(-(10**9), 10**9) / 2 ** rnd.randint(0, 12),
            rnd.uniform(-1, 1) * 10 ** rnd.randint(-8, 14),
            rnd.randint(0, 10**7) / 1000 + 0.0005,
            struct.unpack("d", struct.pack("q", rnd.randint(0x3E00000000000000, 0x4200000000000000)))[0],
        ]
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(8).cache()
    frame.count()
    return frame


@pytest.mark.parametrize(
    "rule, python",
    [
        (formatting.number_text, lambda x: f"{x:.6f}".rstrip("0").rstrip(".")),
        (lambda c: formatting.fixed_decimals(c, 0), lambda x: f"{x:.0f}"),
        (lambda c: formatting.fixed_decimals(c, 2), lambda x: f"{x:.2f}"),
        (lambda c: formatting.fixed_decimals(c, 2, True), lambda x: f"{x:,.2f}"),
        (formatting.shortest_text, str),
        (lambda c: numbers.round_exact(c, 2), lambda x: round(x, 2)),
        (lambda c: numbers.round_exact(c, 0), lambda x: float(round(x))),
        *[
            (lambda c, s=spec: formatting.spec_text(c, T.DoubleType(), s), lambda x, s=spec: format(x, s))
            for spec in (
                ".3f", ".1%", ",", ",.0f", "012.3f", ">14", "*^15", "<9", "e", ".0e", "+.3E", ".17e", ".40g", "g", "G", " .4g", "_.2f", "_", "+", " .1f",
                "+012.2f", "=+14.3f", "x=12.1f", "014,.2f", "015_.1f", "+016,.0f", "013,.0f", "_g", "020,.3e", ".1F",
            )
        ],
    ],
)
def test_number_rule_equals_python(doubles, rule, python):
    rows = doubles.select("v", rule(F.col("v")).alias("got")).collect()
    assert [(r.v, r.got, python(r.v)) for r in rows if r.got != python(r.v)][:5] == []


@pytest.mark.parametrize("spec", ["e", ".3e", ".25e", "g", ".3g", ".30g", "+.1f", ".2f", "_.3f", "", "08.1f", "+010,.1f", "010,.1f", ".1%", "F", "G"])
def test_odd_doubles_equal_python(spark, spec):
    rnd = random.Random(9)
    values = [-0.0, 0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1e-9, 0.5, 1.5, 2.5, math.inf, -math.inf, math.nan, 1e16, 123456.5]
    if "e" in spec or "g" in spec or "G" in spec:
        values += [struct.unpack("d", struct.pack("Q", rnd.getrandbits(64)))[0] for _ in range(300)]
    else:
        values = [v for v in values if abs(v) < 1e15 or math.isinf(v) or math.isnan(v)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v double")
    for row in frame.select("i", formatting.spec_text(F.col("v"), T.DoubleType(), spec).alias("t")).collect():
        if row["i"] == len(values):
            assert row["t"] == ("None" if spec == "" else None)
        else:
            v = values[row["i"]]
            want = format(v, spec) if spec else f"{v:.6f}".rstrip("0").rstrip(".")
            assert row["t"] == want, (v, spec)


def test_whole_number_formats_equal_python(spark):
    rnd = random.Random(3)
    values = [0, -1, 7, 999, 1000, -1000, 2**63 - 1, -(2**63)] + [rnd.randint(-(10**9), 10**9) >> rnd.randint(0, 29) for _ in range(80)]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    for spec in ("+d", " d", "_d", "+,d", "012,d", "+012_d", "05d", "=+8d", "*=9d", "<08d", ",", "_", "+", ".2e", "g", ".3g", "011,"):
        if spec in (".2e", "g", ".3g"):
            some = frame.where(F.abs(F.col("v").cast("double")) < 2.0**53)
        else:
            some = frame
        for row in some.select("v", formatting.spec_text(F.col("v"), T.LongType(), spec).alias("t")).collect():
            assert row["t"] == format(row["v"], spec), (row["v"], spec)


def test_formats_that_do_not_fit_the_type(spark):
    for spec, kind in (("e", T.StringType()), ("_", T.StringType()), ("+", T.StringType()), ("=5", T.StringType()), ("d", T.DoubleType()), ("s", T.LongType()), (".2", T.DoubleType())):
        with pytest.raises(ValueError):
            formatting.spec_text(F.col("v"), kind, spec)


def test_powers_of_columns(spark):
    pairs = [(a, n) for a in (-3, -1, 0, 1, 2, 3, 10) for n in (0, 1, 2, 5, 18)] + [(3, 35), (3, 39), (-3, 39), (2, 62), (-2, 63), (7, 22), (1, 10**9), (-1, 10**9 + 1), (0, 10**9), (2**31, 2), (None, 2), (2, None), (1, None)]
    frame = spark.createDataFrame(pairs, "a bigint, n bigint")
    for row in frame.select("a", "n", numbers.power(F.col("a"), F.col("n"), integral=True).alias("p")).collect():
        assert row["p"] == (None if row["a"] is None or row["n"] is None else row["a"] ** row["n"]), row
    for a, n in ((2, 63), (3, 41), (10, 64), (2, -1), (1, -1)):
        with pytest.raises(Exception, match="OVERFLOW|not fit|negative"):
            spark.createDataFrame([(a, n)], "a bigint, n bigint").select(numbers.power(F.col("a"), F.col("n"), integral=True)).collect()
    with pytest.raises(ValueError):
        numbers.power(F.col("a"), -1, integral=True)


def test_unusual_numbers_and_nulls(spark):
    frame = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (None,)], "v double")
    shown = [r[0] for r in frame.select(formatting.value_text(F.col("v"), T.DoubleType())).collect()]
    assert shown == ["nan", "inf", "-inf", "None"]


def test_floor_mod_division_and_power(spark):
    pairs = [(7, 4), (7, -4), (-7, 4), (-7, -4), (6, 3), (0, 5)]
    frame = spark.createDataFrame(pairs, "a bigint, n bigint")
    rows = frame.select(
        "a", "n", numbers.floor_mod(F.col("a"), F.col("n")).alias("m"), numbers.true_div(F.col("a"), F.col("n")).alias("d"),
        numbers.power(F.col("a"), 3, integral=True).alias("p"),
    ).collect()
    for r in rows:
        assert (r.m, r.d, r.p) == (r.a % r.n, r.a / r.n, r.a**3)
    zero = frame.limit(1).select(numbers.true_div(F.col("a"), 0), numbers.floor_mod(F.col("a"), 0)).first()
    assert tuple(zero) == (None, None)


def test_column_rounding_is_half_even_on_the_scaled_value(spark):
    values = [0.125, 2.5, 3.5, -2.5, 1.15, 1234.0, 1250.0, 1350.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    rows = frame.select("v", numbers.round_even(F.col("v"), 1).alias("one"), numbers.round_even(F.col("v"), -2).alias("hundred"))
    expected = [(v, round(v * 10) / 10, float(round(v / 100) * 100)) for v in values]
    assert [tuple(r) for r in rows.collect()] == expected


ZEROS = [0x30, 0x660, 0x966, 0xFF10, 0x1D7CE]  # the digit zero of five scripts, one beyond 16 bits


def lines_by_rule(seed):
    """(line, other, whether they are the same): a frame of words with numbers in it, moved by a distance that is known."""
    rnd = random.Random(seed)
    words = [rnd.choice(["", "-", "a", "b c", "#", "é", "_"]) for _ in range(rnd.randint(1, 3))]
    values = [rnd.randint(-10_000, 10_000) / 16 for _ in words[1:]]
    far = rnd.random() < 0.4 and bool(values)
    moved = [v + rnd.choice([0, 0.004, -0.004]) for v in values]
    if far:
        moved[rnd.randrange(len(moved))] += rnd.choice([-1, 1]) * rnd.choice([0.03, 7])
    other_words = list(words)
    if changed := rnd.random() < 0.2:
        other_words[rnd.randrange(len(words))] += "z"

    def shown(parts, numbers, zero):
        text = parts[0]
        for part, v in zip(parts[1:], numbers):
            text += " " + f"{v:.{rnd.randint(4, 6)}f}".translate({0x30 + i: zero + i for i in range(10)}) + " " + part
        return rnd.choice(["", " "]) + text + rnd.choice(["", "\t"])

    return shown(words, values, rnd.choice(ZEROS)), shown(other_words, moved, rnd.choice(ZEROS)), not (far or changed)


def test_same_line(spark):
    cases = [lines_by_rule(seed) for seed in range(600)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    for row in frame.select("i", text.same_line(F.col("a"), F.col("b")).alias("same")).collect():
        assert row["same"] is cases[row["i"]][2], cases[row["i"]]


def test_lines_with_a_number_more_or_a_literal_mark(spark):
    frame = spark.createDataFrame([("5 x 5", "5 x"), ("# of 8", "8 of #")], "a string, b string")
    assert [r[0] for r in frame.select(text.same_line(F.col("a"), F.col("b"))).collect()] == [False, True]


@pytest.mark.parametrize("a, b, same", [("\n \nup 7\ndown 8\n", "up 7.00\n\ndown 8", True), ("up 7\ndown 8", "up 7", False), (" \n", "", True)])
def test_same_output(spark, a, b, same):
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    assert frame.select(text.same_output(F.col("a"), F.col("b"))).first()[0] is same


@pytest.mark.parametrize(
    "answer, code",
    [
        ("Sure:\n```sql\nselect 1\n```\nDone", "select 1"),
        ("```\na\n```\nor\n```\nb\n```", "a"),
        ("  plain text \n", "plain text"),
        ("``` \n```", ""),
    ],
)
def test_fenced_code(spark, answer, code):
    frame = spark.createDataFrame([(answer,)], "a string")
    assert frame.select(text.fenced_code(F.col("a"))).first()[0] == code


def test_templates(spark):
    frame = spark.createDataFrame([("x", 3, 2.5, None)], "name string, n bigint, v double, gone string")
    schema = frame.schema

    def fill(pattern, fields=None):
        return frame.select(formatting.template(pattern, schema, fields)).first()[0]

    assert fill("{0}: {2}") == "x: 2.5"
    assert fill("|{n:>4}|{name:<3}|{name:^4}|{n:03d}|") == "|   3|x  | x  |003|"
    assert fill("{v:.2f} {v:.0f} {} {{}}", ["name"]) == "2.50 2 x {}"
    assert fill("{gone}") == "None"
    assert fill("{name:>1}") == "x"
    with pytest.raises(ValueError):
        fill("{name:.2f}")
    with pytest.raises(ValueError):
        fill("{v:x}")


def test_text_of_values(spark):
    frame = spark.sql("select array(1.5D, 2D) as l, true as b, named_struct('k', 'a', 'v', 3D) as p, 7 as i")
    shown = frame.select(*[formatting.value_text(F.col(f.name), f.dataType) for f in frame.schema.fields]).first()
    assert tuple(shown) == ("1.5 2", "True", "a 3", "7")


def test_open_slices(spark):
    words = ["", "é", "lantern", "x" * 1500 + "yz"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    for start, stop in ((None, None), (-3, None), (2, None), (None, -2), (None, 4), (-4, -1), (1, 3)):
        assert [r[0] for r in frame.select(text.slice_text(F.col("w"), start, stop)).collect()] == [w[start:stop] for w in words]


def test_whole_powers_are_exact(spark):
    for base, n in ((3, 35), (97, 9), (-7, 21), (2, 0), (10, 18), (1, 500)):
        assert spark.range(1).select(numbers.power(F.lit(base).cast("bigint"), n, integral=True)).first()[0] == base**n


def test_conversions_are_refused(spark):
    for template in ("{0!r}", "{0[1]}", "{a.b}"):
        with pytest.raises(ValueError):
            formatting.template(template, spark.range(1).schema, ["id"])
