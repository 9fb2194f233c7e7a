"""Single operators on small tables."""

import math
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.functions import nested
from framewright.operators import aggregate, elementwise, order, select, shape


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        (1, "pen", "office", 3, 1.5, "done"),
        (2, "cap", "wear", 1, 9.0, "open"),
        (3, "pen", "office", 2, 1.5, None),
        (4, "mug", None, 5, 4.25, "done"),
        (5, "cap", "wear", 4, None, "back"),
        (6, "ink", "office", 1, 12.0, "done"),
    ]
    return spark.createDataFrame(rows, "id bigint, item string, kind string, qty bigint, price double, state string").repartition(4)


def ids(frame):
    return sorted(r.id for r in frame.collect())


def test_where_keeps_or_drops_nulls(sales):
    assert ids(select.where(sales, "state", "eq", "done")) == [1, 4, 6]
    assert ids(select.where(sales, "state", "ne", "done")) == [2, 3, 5]
    assert ids(select.where(sales, "kind", "in", "wear,office")) == [1, 2, 3, 5, 6]
    assert ids(select.where(sales, "kind", "nin", "wear")) == [1, 3, 4, 6]
    assert ids(select.where(sales, "qty", "in", "1,5,x")) == [2, 4, 6]
    assert ids(select.where(sales, "price", "gt", 4)) == [2, 4, 6]
    assert ids(select.where(sales, "price", "has", ".25")) == [4]
    assert ids(select.where(sales, "state", "has", "an")) == []


def test_where_with_other_types(sales):
    assert ids(select.where(sales, "qty", "eq", "3")) == []
    assert ids(select.where(sales, "qty", "ne", "3")) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(TypeError):
        select.where(sales, "qty", "gt", "3")
    with pytest.raises(ValueError):
        select.where(sales, "qty", "like", 3)


def test_where_with_a_computed_value(sales):
    mean = sales.agg(F.avg("qty").alias("m")).scalar()
    assert ids(select.where(sales, "qty", "gt", mean)) == [1, 4, 5]


def test_where_in_table(spark, sales):
    wanted = spark.createDataFrame([("pen",), ("pen",), (None,), ("mug",)], "w string")
    assert ids(select.where_in_table(sales, "item", wanted, "w")) == [1, 3, 4]
    assert ids(select.where_in_table(sales, "kind", wanted, "w", negate=True)) == [1, 2, 3, 4, 5, 6]


def test_drop_and_mask(sales):
    assert ids(select.drop_null(sales)) == [1, 2, 6]
    assert ids(select.drop_value(sales, "state", "done")) == [2, 3, 5]
    assert ids(select.drop_value(sales, "state", None)) == [1, 2, 4, 5, 6]
    masked = select.mask_value(sales, "done")
    assert masked.count() == 6 and masked.where(F.col("state").isNull()).count() == 4


def test_position_counts_across_partitions(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, None])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id bigint, v int").repartition(7)
    placed = order.with_position(frame, *order.ascending("v", "id")).collect()
    expected = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [(r.id, r.pos) for r in sorted(placed, key=lambda r: r.pos)] == [(r[0], i + 1) for i, r in enumerate(expected)]


def test_rows_come_out_in_order(spark):
    frame = spark.range(1000).repartition(6).withColumn("v", F.col("id") % 10)
    assert [r.id for r in order.with_position(frame, F.col("id").desc()).collect()] == list(range(999, -1, -1))
    got = [(r.v, r.id) for r in order.sort(frame, "v", "id", desc=True).collect()]
    assert got == sorted(((i % 10, i) for i in range(1000)), key=lambda p: (-p[0], p[1]))


def test_cuts_start_no_job(spark):
    frame = spark.range(500).repartition(5).withColumn("value", F.col("id") % 50)
    few = [r.id for r in order.top(frame, 60, "value", "id").collect()]
    many = order.cut_by_position(frame, order.descending("value", "id"), 60).collect()
    assert sorted(r.id for r in many) == sorted(few) and few[:3] == [49, 99, 149]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job may start")
    for n in (10, 1_000_000):
        order.top(frame, n, "value", "id")
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.id for r in order.last(frame, 3, "id").collect()] == [497, 498, 499]
    assert [r.id for r in order.first(frame, 3, "id").collect()] == [0, 1, 2]
    assert [r.id for r in order.bottom(frame, 2, "value", "id").collect()] == [0, 50]


def test_uniq_and_freq(spark):
    frame = spark.createDataFrame(list(enumerate("abacabddd")), "at bigint, x string").repartition(3)
    assert [r.x for r in order.uniq(frame, "x", "at").collect()] == ["a", "b", "c", "d"]
    assert [tuple(r) for r in order.freq(frame, "x", "at").collect()] == [("a", 3), ("d", 3), ("b", 2), ("c", 1)]


def test_group_rows(spark):
    rows = [(i, k) for i, k in enumerate("bbacbbbbcab" * 20)] + [(1000, None)]
    frame = spark.createDataFrame(rows, "at bigint, k string").repartition(4)
    got = {r.at: (r.k, r.group_pos, r.row_pos) for r in shape.group_rows(frame, "k", "at").collect()}
    seen, sizes, expected = {}, {}, {}
    for at, k in rows[:-1]:
        seen.setdefault(k, len(seen) + 1)
        sizes[k] = sizes.get(k, 0) + 1
        expected[at] = (k, seen[k], sizes[k])
    assert got == expected
    assert shape.group_rows(frame, "k", "at", keep_null=True).count() == len(rows)


def test_by_drops_null_keys_and_sums_nothing_to_zero(sales):
    sums = {r.key: r.value for r in aggregate.by(sales, "kind", aggregate.total("price")).collect()}
    assert sums == {"office": 15.0, "wear": 9.0}
    kept = {r.key: r.value for r in aggregate.by(sales, "kind", aggregate.rows(), keep_null=True).collect()}
    assert kept == {"office": 3, "wear": 2, None: 1}
    none = sales.where("id > 99").agg(aggregate.total("price").alias("s"), aggregate.rows().alias("n")).first()
    assert tuple(none) == (0.0, 0)
    assert aggregate.nuniq(sales, "state").first()[0] == 3
    assert aggregate.nuniq_rows(sales.select("item", "kind")).first()[0] == 4


@pytest.mark.parametrize("few, small, size", [(True, 100_000, 4_096), (True, 200, 400), (False, 200, 400), (True, 0, 100)])
def test_percentiles_equal_numpy(spark, monkeypatch, few, small, size):
    monkeypatch.setattr(aggregate, "SMALL_GROUP", small)
    monkeypatch.setattr(aggregate, "SKETCH_SIZE", size)
    rnd = random.Random(9)
    rows = [("hot", float(rnd.choice([1, 2, 2, 2, 5, 8]))) for _ in range(4000)]
    rows += [("wide", rnd.uniform(-5, 5)) for _ in range(1504)] + [("one", 3.5), ("none", None), ("one", math.nan)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
    wanted = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "lo": 0.0, "hi": 1.0}
    data = pd.DataFrame(rows, columns=["k", "v"]).dropna()
    for r in aggregate.percentiles(frame, "v", wanted, ("k",), few_groups=few).collect():
        for name, q in wanted.items():
            assert math.isclose(r[name], np.quantile(data[data.k == r.k].v, q), abs_tol=1e-9)
    assert {r.k for r in aggregate.median(frame, "v", ("k",), few_groups=few).collect()} == {"hot", "wide", "one"}
    whole = aggregate.percentiles(frame, "v", wanted).first()
    assert math.isclose(whole["p90"], data.v.quantile(0.9), abs_tol=1e-9)
    nothing = frame.where("v is null")
    assert aggregate.percentiles(nothing, "v", wanted, ("k",), few_groups=few).collect() == []
    assert all(r["p50"] is None for r in aggregate.percentiles(nothing, "v", wanted).collect())


def test_a_bracket_that_misses_is_made_up_for(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "SMALL_GROUP", 0)
    monkeypatch.setattr(aggregate, "quantile_error", lambda size: -0.1)  # brackets that hold nothing
    frame = spark.range(1, 1002).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    assert {r.k: r["median"] for r in aggregate.median(frame, "v", ("k",), few_groups=True).collect()} == {0: 501.0, 1: 501.0}
    assert aggregate.median(frame, "v").first()[0] == 501.0


@pytest.fixture
def counted(monkeypatch):
    """The tables of counts that percentiles are looked up in."""
    seen, values_at = [], aggregate._values_at
    monkeypatch.setattr(aggregate, "_values_at", lambda counts, *a, **k: seen.append(counts) or values_at(counts, *a, **k))
    return seen


def test_no_task_gets_the_rows_of_a_group(spark, monkeypatch, counted):
    monkeypatch.setattr(aggregate, "SMALL_GROUP", 0)
    monkeypatch.setattr(aggregate, "SKETCH_SIZE", 400)
    frame = spark.range(0, 30_000, 1, 6).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    name = "spark.sql.autoBroadcastJoinThreshold"  # the sketch of a large table is not known to be small
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "-1")
        found = aggregate.percentiles(frame, "v", {"p90": 0.9, "p25": 0.25}, ("k",), few_groups=True).collect()
        (counts,) = counted
        plan = counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert {(r.k, round(r.p90, 6), round(r.p25, 6)) for r in found} == {(k, round(26997.3 + k, 6), round(7499.25 + k, 6)) for k in range(3)}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # of the counts, none of the rows


def test_more_groups_than_are_sent_to_every_task(spark, monkeypatch, counted):
    monkeypatch.setattr(aggregate, "FEW_GROUPS", 2)
    for groups, bracketed in ((2, True), (3, False)):
        counted.clear()
        frame = spark.range(0, 3_000, 1, 4).select((F.col("id") % groups).alias("k"), F.col("id").alias("v"))
        medians = {r.k: r["median"] for r in aggregate.median(frame, "v", ("k",), few_groups=True).collect()}
        assert medians == {k: float(np.median(range(k, 3_000, groups))) for k in range(groups)}
        assert [("_f" in c.columns) for c in counted] == [bracketed]


@pytest.mark.parametrize("few", [True, False])
def test_a_missing_key_is_a_group_of_its_own(spark, monkeypatch, counted, few):
    monkeypatch.setattr(aggregate, "SMALL_GROUP", 0)
    frame = spark.range(0, 9_000, 1, 6).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 > 0, "x").alias("j"), F.col("id").alias("v")
    )
    data = pd.DataFrame({"id": range(9_000)})
    found = {r.k: r["median"] for r in aggregate.median(frame, "v", ("k",), few_groups=few).collect()}
    assert found == {k or None: g.median() for k, g in data.id.groupby(data.id % 3)}
    assert ["_f" in c.columns for c in counted] == [few]  # a bracket for every group, the general way is not called in
    found = {(r.k, r.j): r["median"] for r in aggregate.median(frame, "v", ("k", "j"), few_groups=few).collect()}
    assert found == {(k or None, "x" if j else None): g.median() for (k, j), g in data.id.groupby([data.id % 3, data.id % 2])}
    assert ["_f" in c.columns for c in counted] == [few] * 2


def test_distinct_rows_by_their_hashes(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1, 2]), rnd.choice([None, "x", ""]), rnd.choice([None, 0.0, -0.0, math.nan])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "a int, `b.c` string, d double").repartition(4)
    assert aggregate.nuniq_rows(frame).first()[0] == frame.distinct().count()
    assert aggregate.nuniq_rows(frame.limit(0)).first()[0] == 0


def test_percentile_when_one_partition_holds_all(spark):
    frame = spark.range(1, 11).select(F.col("id").alias("v")).coalesce(1)
    assert aggregate.median(frame, "v").first()[0] == 5.5


def test_block_in_pandas_merges_partials(spark):
    frame = spark.range(10_000).select((F.col("id") % 3).alias("k"), "id")

    def partial(rows):
        return rows.groupby("k").agg(s=("id", "sum"), n=("id", "size")).reset_index()

    got = aggregate.by_block(frame, partial, "k bigint, s bigint, n bigint", "k", s=F.sum("s"), n=F.sum("n"))
    want = {k: (sum(range(k, 10_000, 3)), len(range(k, 10_000, 3))) for k in range(3)}
    assert {r.k: (r.s, r.n) for r in got.collect()} == want


def test_pivot_counts(sales):
    got = {r.kind: (r.done, r.open) for r in aggregate.pivot_count(sales, "kind", "state", ["done", "open"]).collect()}
    assert got == {"office": (2, 0), "wear": (0, 1), None: (1, 0)}


def test_elementwise(spark, sales):
    def values(op, n, name="qty"):
        return [r.r for r in elementwise.math(sales, name, op, n, "r").orderBy("id").collect()]

    assert values("add", 1) == [4, 2, 3, 6, 5, 2]
    assert values("div", 2) == [1.5, 0.5, 1.0, 2.5, 2.0, 0.5]
    assert values("mod", -2) == [-1, -1, 0, -1, 0, -1]
    assert values("pow", 2) == [9, 1, 4, 25, 16, 1]
    assert values("le", 2) == [False, True, True, False, False, True]
    assert values("add", "s", "item")[:2] == ["pens", "caps"]
    assert values("mul", 2, "item")[0] == "penpen"
    with pytest.raises(TypeError):
        values("sub", 1, "item")
    arrays = spark.sql("select array(1, 2, 3) as a, array('A', 'b') as t, array(1.234D, 5.675D) as d")
    assert elementwise.math(arrays, "a", "mul", 10).first().a == [10, 20, 30]
    assert elementwise.upper(arrays, "t").first().t == ["A", "B"]
    assert elementwise.round_column(arrays, "d", 2).first().d == [round(1.234, 2), round(5.675, 2)]
    assert elementwise.math_all_columns(sales.select("id", "item"), "add", 1).agg(F.sum("id")).first()[0] == 27


def test_array_forms(spark):
    frame = spark.sql(
        "select array(40, 8, 26) as a, array(named_struct('n', 'x', 'q', 2), named_struct('n', 'y', 'q', 5)) as r, map('k', 1) as m"
    )
    a = F.col("a")
    row = frame.select(
        nested.top_items(a, 2).alias("top"), nested.array_sum(a).alias("sum"), nested.array_mean(a).alias("mean"),
        nested.last_items(a, 2).alias("last"), nested.first_items(a, 5).alias("first"), nested.drop_item(a, 40).alias("drop"),
        nested.sort_items(a, desc=True).alias("desc"), nested.path("r.-1.n").alias("n"), nested.path("a.7").alias("gone"),
    ).first()
    assert row.asDict() == {
        "top": [40, 26], "sum": 74.0, "mean": 74 / 3, "last": [8, 26], "first": [40, 8, 26], "drop": [8, 26],
        "desc": [40, 26, 8], "n": "y", "gone": None,
    }
    stable = spark.sql("select array('bb', 'a', null, 'cc', 'ddd') as w")
    ordered = stable.select(nested.sort_items(F.col("w"), F.length), nested.sort_items(F.col("w"), F.length, desc=True)).first()
    assert list(ordered) == [["a", "bb", "cc", "ddd", None], ["ddd", "bb", "cc", "a", None]]
    assert [x.n for x in select.where_items(frame, "r", "q", "gt", 2).first().r] == ["y"]
    assert shape.each_nested(frame, "r", "q").first().r == [2, 5]
    assert shape.set_nested(frame, "r", "d", lambda r: r["q"] * 2).first().r[1].d == 10
    assert [tuple(x) for x in shape.pick_nested(frame, "r", "q").first().r] == [(2,), (5,)]
    assert shape.keys(frame, "m").first().m == ["k"] and shape.vals(frame, "m").first().m == [1]
    assert [(r.key, r.value) for r in shape.pairs(frame, "m").collect()] == [("k", 1)]
    assert shape.map_map(frame, "m", lambda v: v + 1).first().m == {"k": 2}
    assert shape.map_array(frame, "a", lambda x: x + 1).first().a == [41, 9, 27]
    words = spark.sql("select array('u', 'v', 'u', null, 'w', 'v', 'u') as w, array(9007199254740993L, 2L, null) as k, 'abc' as t")
    w, k = F.col("w"), F.col("k")
    made = words.select(
        nested.freq_items(w).alias("freq"), nested.uniq_items(w).alias("uniq"), nested.nuniq_items(w).alias("kinds"), nested.count_items(w).alias("n"),
        nested.join_items(w, "-").alias("joined"), nested.reversed_items(F.col("t")).alias("text"), nested.reversed_items(k).alias("back"),
        nested.array_sum(k, "bigint").alias("sum"), nested.count_characters(F.col("t")).alias("chars"), nested.sort_items(w, n=2).alias("two"),
    ).first()
    assert [tuple(x) for x in made.freq] == [("u", 3), ("v", 2), (None, 1), ("w", 1)] and made.uniq == ["u", "v", None, "w"]
    assert (made.kinds, made.n, made.joined, made.text, made.back) == (3, 7, "u-v-u-w-v-u", "cba", [None, 2, 9007199254740993])
    assert (made.sum, made.chars, made.two) == (9007199254740995, 3, ["u", "u"])
    said = spark.createDataFrame([(1, "a", "x"), (3, "a", "z"), (2, "a", "y"), (4, "b", "w")], "at int, who string, t string")
    assert {tuple(r) for r in shape.join_rows(said, "who", "t", "at", "+").collect()} == {("a", "x+y+z"), ("b", "w")}


def test_membership_of_mixed_types(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int")
    for kind, values in (("bigint", [2, 3]), ("double", [2.0, 3.0, 3.5]), ("decimal(9,2)", [Decimal(2), Decimal(3)]), ("smallint", [2, 3])):
        table = spark.createDataFrame([(v,) for v in values], f"k {kind}")
        assert sorted(r.id for r in select.where_in_table(ids, "id", table, "k").collect()) == [2, 3]
        assert {r.id for r in select.where_in_table(ids, "id", table, "k", negate=True).collect()} == {1, None}
    with pytest.raises(TypeError):
        select.where_in_table(ids, "id", spark.createDataFrame([("2",)], "k string"), "k")
    large = spark.createDataFrame([(2**53 + 1,), (2**53,)], "id bigint")
    exact = spark.createDataFrame([(Decimal(2**53 + 1),)], "k decimal(18,0)")
    assert [r.id for r in select.where_in_table(large, "id", exact, "k").collect()] == [2**53 + 1]


def test_missing_values_in_lists(spark):
    frame = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    pick = lambda op, items: {r.x for r in select.where(frame, "x", op, items).collect()}
    assert pick("in", [1]) == {1} and pick("in", [1, None]) == {1, None} and pick("in", [None]) == {None}
    assert pick("nin", [1]) == {2, None} and pick("nin", [1, None]) == {2} and pick("nin", [None]) == {1, 2}


def test_whole_table_measures_keep_types(spark):
    frame = spark.createDataFrame([(2**53 + 1, "a"), (5, "b")], "n bigint, t string")
    assert tuple(aggregate.wide_columns(frame, F.max).first()) == (2**53 + 1, "b")


def test_pick_each_set(sales):
    assert shape.pick(sales, "qty,id").columns == ["qty", "id"]
    total = shape.set_column(sales, "total", F.col("qty") * F.col("price"))
    assert {r.total for r in shape.each(total, "total").collect()} == {4.5, 9.0, 3.0, 21.25, None, 12.0}
    assert sorted(r.item for r in shape.slice_column(sales, "item", 0, 2).collect())[:2] == ["ca", "ca"]


def test_a_hot_key_is_split_in_joins(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "400KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id") % 5000)
        frame = spark.range(0, 600_000, 1, 16).select("id", hot.alias("k"), F.md5(F.col("id").cast("string")).alias("t"))
        wanted = frame.select("k").where("k >= 0")
        for negate in (False, True):
            kept = select.where_in_table(frame, "k", wanted, negate=negate).agg(F.max("t"), F.count("id").alias("n"))
            assert kept.collect()[0].n == frame.where(f"{'not' if negate else ''} (k >= 0)").count()
            assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def test_whole_keys_meet_doubles_by_value(spark):
    big = 2**53
    ids = spark.createDataFrame([(1, big), (2, big + 1), (3, None), (4, 7), (5, 2**63 - 1)], "id int, k bigint")
    for values, hits in (([float(big)], {1}), ([7.0, 7.5], {4}), ([7.5, math.nan, math.inf, 2.0**63, None], set()), ([-0.0], set())):
        table = spark.createDataFrame([(v,) for v in values], "w double")
        assert {r.id for r in select.where_in_table(ids, "k", table, "w").collect()} == hits
        assert {r.id for r in select.where_in_table(ids, "k", table, "w", negate=True).collect()} == {1, 2, 3, 4, 5} - hits
    floats = spark.createDataFrame([(1, 7.0), (2, 7.5), (3, None), (4, float(big)), (5, math.nan)], "id int, k double")
    wanted = spark.createDataFrame([(7,), (big + 1,), (None,)], "w bigint")
    assert {r.id for r in select.where_in_table(floats, "k", wanted, "w").collect()} == {1}


def test_fields_with_dots_and_columns(spark):
    frame = spark.createDataFrame([(1, [4, 5], ("x",)), (2, [6], ("y",))], "`a.b` int, `c.d` array<int>, e struct<`f.g`: string>")
    assert [r[0] for r in select.where(frame, "`a.b`", "eq", 2).collect()] == [2]
    assert [r[0] for r in select.where(frame, "`c.d`.0", "gt", 4).collect()] == [2]
    assert [r[0] for r in select.where(frame, "e.`f.g`", "eq", "x").collect()] == [1]
    assert [r[0] for r in select.where(frame, F.col("`a.b`") + 1, "eq", 2).collect()] == [1]
