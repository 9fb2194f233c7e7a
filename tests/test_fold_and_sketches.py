"""Blocks over ordered groups and mergeable sketches against plain Python."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from framewright.operators import fold, sketches


def rows_of(seed, n=400):
    """One key has most rows, some keys are missing, and values are large, missing or equal."""
    draw = random.Random(seed)
    big = 2**53
    return [(draw.choice([1, 1, 1, 1, None, 2, 3, big + 1, big + 2]), i, draw.choice([None, big + 1, -5, 4, 4, 4]), draw.choice(["a", "a", "b", None])) for i in range(n)]


@pytest.fixture(params=[(1, 400, 8), (2, 37, 8), (3, 5, 8), (4, 0, 3)])
def case(request, spark):
    seed, n, parts = request.param
    rows = rows_of(seed, n)
    frame = spark.createDataFrame(rows, "k long, part int, v long, c string").repartition(parts)
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    return frame, groups


def test_running_total(case):
    frame, groups = case
    got = {(r["k"], r["part"]): (r["v"], r["c"], r["total"]) for r in fold.scan(frame, "k", "part", fold.running_total("v"), "total", "long").collect()}
    want = {}
    for key, rows in groups.items():
        for row, total in zip(rows, itertools.accumulate(r[2] or 0 for r in rows)):
            want[key, row[1]] = (row[2], row[3], total)
    assert got == want


def test_scan_replaces_a_column(case):
    frame, groups = case
    got = fold.scan(frame, "k", "part", fold.longest_run("c"), "c", "int")
    assert got.columns == ["k", "part", "v", "c"]
    assert got.count() == sum(map(len, groups.values()))


def test_longest_run(case):
    frame, groups = case
    got = {r["key"]: r["value"] for r in fold.fold(frame, "k", "part", fold.longest_run("c"), "long").collect()}
    assert got == {key: max(len(list(g)) for _, g in itertools.groupby(r[3] for r in rows)) for key, rows in groups.items()}


def test_lengths_so_far(case):
    frame, groups = case
    got = {(r["k"], r["part"]): r["n"] for r in fold.scan(frame, "k", "part", fold.longest_run("c"), "n", "int").collect()}
    want = {}
    for key, rows in groups.items():
        for _, run in itertools.groupby(rows, key=lambda r: r[3]):
            want |= {(key, r[1]): n for n, r in enumerate(run, 1)}
    assert got == want


def test_clamped_balance(case):
    frame, groups = case
    frame = frame.withColumn("v", F.col("v") % 7 - 3)
    scanned = {(r["k"], r["part"]): r["b"] for r in fold.scan(frame, "k", "part", fold.clamped_balance("v"), "b", "double").collect()}
    folded = {r["key"]: r["value"] for r in fold.fold(frame, "k", "part", fold.clamped_balance("v"), "double").collect()}
    values = {(r["k"], r["part"]): r["v"] for r in frame.collect()}
    for key, rows in groups.items():
        balance = 0.0
        for row in rows:
            balance = max(0.0, balance + (values[key, row[1]] or 0))
            assert scanned[key, row[1]] == balance
        assert folded[key] == balance
    assert len(folded) == len(groups)


def test_a_block_of_the_callers_own(spark):
    """The first row that repeats the value two before it: nothing a window function says."""

    def run(state, rows):
        for place, v in zip(rows["seq"].tolist(), rows["v"].tolist()):
            found, one, two, n, head = state
            found = place if found is None and n >= 2 and v == one else found
            state = (found, two, v, n + 1, (*head, (place, v))[:2])
        return state, None

    def join(left, right):
        # Rows that the right part could not judge: its first two, with the last two of the left.
        state = left
        for place, v in right[4]:
            found, one, two, n, head = state
            state = (place if found is None and n >= 2 and v == one else found, two, v, n + 1, (*head, (place, v))[:2])
        if right[3] <= 2:
            return state
        found = state[0] if state[0] is not None else right[0]
        return found, right[1], right[2], left[3] + right[3], state[4]

    draw = random.Random(6)
    rows = [(draw.choice("xxxy"), i, draw.randrange(25)) for i in range(120)]
    frame = spark.createDataFrame(rows, "k string, seq int, v int").repartition(16)
    got = {r["key"]: r["value"] for r in fold.fold(frame, "k", "seq", fold.Block((None, None, None, 0, ()), run, join, lambda s: s[0]), "int").collect()}
    for key in "xy":
        own = [r for r in rows if r[0] == key]
        assert got[key] == next((own[i][1] for i in range(2, len(own)) if own[i][2] == own[i - 2][2]), None)


def test_keys_of_doubles(spark):
    nan = float("nan")
    frame = spark.createDataFrame([(nan, 1, 1), (nan, 2, 1), (None, 3, 1), (0.5, 4, 1)], "k double, seq int, v int").repartition(3)
    got = sorted((str(r["key"]), r["value"]) for r in fold.fold(frame, "k", "seq", fold.running_total("v"), "long").collect())
    assert got == [("0.5", 1), ("None", 1), ("nan", 2)]


# ---------- sketches ----------


def test_merged_parts_equal_the_whole(spark):
    frame = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("day"), (F.col("id") * 7919 % 20_011).alias("v"))
    parts = sketches.distinct_sketches(frame, "v", ("g", "day"))
    merged = sketches.merge_distinct(parts, ("g",)).select("g", sketches.distinct_estimate().alias("n"))
    exact = {r["g"]: r["n"] for r in frame.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    for row in merged.collect():
        assert abs(row["n"] - exact[row["g"]]) <= 4 * sketches.distinct_error() * exact[row["g"]]
    whole = sketches.merge_distinct(parts).select(sketches.distinct_estimate().alias("n")).first()["n"]
    assert abs(whole - 20_011) <= 0.03 * 20_011


@pytest.mark.parametrize(("kind", "values", "distinct"), [
    ("double", [0.0, -0.0, 1.5, None, float("nan"), float("nan")], 3),
    ("string", ["a", "A", "", None], 3),
    ("decimal(9,2)", ["1.00", "1.0", "2"], 2),
    ("date", ["2020-01-01", "2020-01-01", "2021-01-01"], 2),
    ("boolean", ["true", "false", None], 2),
    ("int", ["1", None, "1"], 1),
])
def test_values_of_any_type(spark, kind, values, distinct):
    frame = spark.createDataFrame([(v,) for v in values], "`a.b` double" if kind == "double" else "`a.b` string")
    frame = frame.select(F.col("`a.b`").cast(kind).alias("a.b"))
    assert sketches.distinct_sketches(frame, "a.b").select(sketches.distinct_estimate()).first()[0] == distinct


def test_quantiles_within_their_error(spark):
    n = 40_000
    frame = spark.range(n).select((F.col("id") % 5).alias("day"), (F.col("id") * 7919 % 40_009).cast("double").alias("v"))
    parts = sketches.quantile_sketches(frame, "v", ("day",), size=400)
    values = sorted(r["v"] for r in frame.collect())
    merged = sketches.merge_quantiles(parts, size=400)
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        row = merged.select(sketches.quantile(q).alias("v"), sketches.sketched_rows().alias("n")).first()
        assert row["n"] == n
        below, upto = sum(v < row["v"] for v in values), sum(v <= row["v"] for v in values)
        error = 3 * sketches.quantile_error(400) * n
        assert below <= q * n + error and upto >= q * n - error
        share = merged.select(sketches.rank_of(row["v"]).alias("r")).first()["r"]
        assert abs(share - upto / n) <= 3 * sketches.quantile_error(400)


def test_sketches_of_nothing(spark):
    frame = spark.createDataFrame([(1, None), (2, float("nan")), (3, 4.0)], "g int, v double")
    got = {r["g"]: (r["m"], r["n"]) for r in sketches.quantile_sketches(frame, "v", ("g",)).select("g", sketches.quantile(0.5).alias("m"), sketches.sketched_rows().alias("n")).collect()}
    assert got == {1: (None, 0), 2: (None, 0), 3: (4.0, 1)}
    assert sketches.merge_distinct(sketches.distinct_sketches(frame.limit(0), "v", ("g",)), ("g",)).count() == 0
    assert sketches.distinct_sketches(frame.where("g = 1"), "v").select(sketches.distinct_estimate()).first()[0] == 0
