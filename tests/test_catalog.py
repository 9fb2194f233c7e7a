"""Every registered query against its SQL, and the shape of important plans."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from framewright import catalog
from framewright.operators import aggregate

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql(testdata):
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"create view {table} as select * from '{testdata}/{table}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    value = value.item() if hasattr(value, "item") else value
    return bool(value) if isinstance(value, bool) else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    found = [tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(found, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sql, testdata, name):
    got = catalog.QUERIES[name](spark, testdata).toPandas()
    want = sql.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("where_eq", "EqualTo(event_type,view)"),
        ("where_gt", "GreaterThan(o_totalprice,112946.26)"),
        ("where_in", "In(event_type, ["),
        ("where_has", "StringContains(p_name,ring)"),
        ("best_customers", "EqualTo(o_orderstatus,F)"),
    ],
)
def test_filters_reach_the_scan(spark, testdata, capsys, name, pushed):
    catalog.QUERIES[name](spark, testdata).explain("formatted")
    line = next(x for x in capsys.readouterr().out.splitlines() if x.startswith("PushedFilters"))
    assert pushed in line


def test_no_query_pairs_all_rows(spark, testdata):
    for name, query in catalog.QUERIES.items():
        text = plan(query(spark, testdata))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


@pytest.mark.parametrize("name", ["by_median", "stat_percentile"])
def test_grouped_percentiles_shuffle_no_rows(spark, testdata, monkeypatch, name):
    seen, values_at = [], aggregate._values_at
    monkeypatch.setattr(aggregate, "_values_at", lambda counts, *a, **k: seen.append(plan(counts)) or values_at(counts, *a, **k))
    setting = "spark.sql.autoBroadcastJoinThreshold"  # the sketch of a large table is not known to be small
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "-1")
        entry.queries()[name](spark, testdata)
    finally:
        spark.conf.set(setting, before)
    assert len(seen) == 1 and "BroadcastHashJoin" in seen[0] and "SortMergeJoin" not in seen[0]


def test_top_k_is_a_heap_per_task(spark, testdata):
    assert "TakeOrderedAndProject" in plan(entry.queries()["top_pairs"](spark, testdata))


def test_entry_gives_rows(spark, testdata):
    assert entry.entry(spark).count() == 5
