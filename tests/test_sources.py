"""Readers and writers."""

import csv
import glob
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright import session
from framewright.sources import readers, sinks


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def test_csv_types_and_missing_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'day,n,x,name,ok,gap\n2026-01-02,1,1.5,"a, ""b""",True,1\n2026-01-03,-20,2,NA,False,\n2026-02-01,3,null,c,True,3\n'
    )
    frame = readers.csv(spark, str(tmp_path / "a.csv"))
    assert dict(frame.dtypes) == {"day": "string", "n": "bigint", "x": "double", "name": "string", "ok": "boolean", "gap": "double"}
    assert [tuple(r) for r in frame.collect()] == [
        ("2026-01-02", 1, 1.5, 'a, "b"', True, 1.0),
        ("2026-01-03", -20, 2.0, None, False, None),
        ("2026-02-01", 3, None, "c", True, 3.0),
    ]
    declared = readers.csv(spark, str(tmp_path / "a.csv"), "day string, n bigint, x double, name string, ok boolean, gap double")
    assert declared.collect() == frame.collect()


def test_text_json_and_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("red fox\nold owl", encoding="utf-8")
    whole = readers.read_text(spark, str(tmp_path / "t.txt"))
    assert [r.value for r in whole.collect()] == ["red fox\nold owl"]
    assert [(r.line_no, r.line) for r in readers.lines(whole, "value").collect()] == [(1, "red fox"), (2, "old owl")]
    assert [r.word for r in readers.words(whole, "value").collect()] == ["red", "fox", "old", "owl"]
    assert [r.value for r in readers.read_lines(spark, str(tmp_path / "t.txt")).collect()] == ["red fox", "old owl"]
    (tmp_path / "d.json").write_text("[7, 11, 20]")
    assert readers.json_values(spark, str(tmp_path / "d.json")).agg(F.sum("value")).first()[0] == 38
    (tmp_path / "r.json").write_text('[{"a": {"b": [1, 2]}},\n {"a": {"b": [3]}}]')
    nested = readers.json_files(spark, str(tmp_path / "r.json"))
    assert [r[0] for r in nested.select("a.b").collect()] == [[1, 2], [3]]
    text = spark.createDataFrame([("[8, 13]",)], "j string")
    assert readers.parse_json(text, "j", "array<bigint>").first().j == [8, 13]
    assert readers.parse_json_any(text, "j").select(F.variant_get("j", "$[1]", "int")).first()[0] == 13


def test_json_lines_from_several_files(spark, tmp_path):
    for name, ok in (("a", "true"), ("b", "false")):
        (tmp_path / f"{name}.jsonl").write_text(f'{{"id": "{name}", "ok": {ok}}}\n')
    frame = readers.json_lines(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], "id string, ok boolean")
    assert {tuple(r) for r in frame.collect()} == {("a", True), ("b", False)}


def test_made_values(spark):
    assert [r.value for r in readers.upto(spark, 3).collect()] == [1, 2, 3]
    for value, items in (("1,2", [1, 2]), ("1,2.5", [1.0, 2.5]), ("1,2.5,x", ["1", "2.5", "x"])):
        assert spark.range(1).select(readers.literal_list(value)).first()[0] == items


def test_writers_keep_order_and_pass_the_table_on(spark, folder):
    frame = spark.range(100).select((99 - F.col("id")).alias("key"), (F.col("id") / 4).alias("value")).repartition(4).orderBy("key")
    assert sinks.save_csv(frame, folder("csv")) is frame
    assert readers.csv(spark, folder("csv")).count() == 100
    sinks.save_key_values(frame, folder("kv"))
    lines = [r.value for r in spark.read.text(folder("kv")).collect()]
    assert sorted(lines)[:2] == ["0,24.75", "1,24.5"]
    sinks.save_lines(frame.select("value"), folder("lines"))
    assert {r.value for r in spark.read.text(folder("lines")).collect()} >= {"24.75", "0", "0.5"}


def test_report_lines(spark):
    frame = spark.createDataFrame([("done", 2.50, None)], "key string, value double, more string")
    assert sinks.key_value_lines(frame).first()[0] == "done: 2.5"
    assert sinks.value_lines(frame).first()[0] == "done 2.5 None"
    assert sinks.fmt(frame, "{0} ({1:.1f})", keep=["key"]).first().line == "done (2.5)"


def test_the_shared_folder_comes_from_the_session(spark):
    folder = session.shared_folder(spark)
    assert folder == spark.sparkContext.getCheckpointDir() == session.shared_folder(spark)
    assert session.scratch_path(spark).startswith(folder)


def test_scratch_tables_go_when_they_are_done_with(spark, folder):
    outside = session.scratch_path(spark)
    spark.range(3).write.parquet(outside)
    with session.scratch(spark):
        inside = session.scratch_path(spark)
        spark.range(5).write.parquet(inside)
        spark.read.parquet(inside).write.parquet(folder("kept"))
    local = [p.removeprefix("file:") for p in (outside, inside)]
    assert [os.path.exists(p) for p in local] == [True, False] and spark.read.parquet(folder("kept")).count() == 5


def test_csv_gives_back_what_was_saved(spark, folder):
    rows = [(1234567890123456789, "  a "), (1234567890123456788, 'two\nlines "and" quotes, commas'), (-5, "\ttab"), (7, "plain")]
    frame = spark.createDataFrame(rows, "id bigint, t string").repartition(2)
    sinks.save_csv(frame, folder("texts"))
    declared = readers.csv(spark, folder("texts"), frame.schema, multi_line=True)
    assert sorted(tuple(r) for r in declared.collect()) == sorted(rows)
    found = readers.csv(spark, folder("texts"), multi_line=True)
    assert dict(found.dtypes) == {"id": "bigint", "t": "string"} and sorted(tuple(r) for r in found.collect()) == sorted(rows)


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of some hundred bytes, so that one small file is many tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cells(seed):
    draw = random.Random(seed)
    parts = ["a", "b c", "\n", "\r\n", '"', ",", "é", " ", "\t", "x" * 40, "\n\n", '"\n"', "\n,\n"]
    return [(i, "".join(draw.choice(parts) for _ in range(draw.choice([0, 1, 4, 30, 200 if i % 50 == 7 else 5]))), draw.choice([None, "z", "\n"])) for i in range(160)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2])
def test_one_file_with_line_breaks_is_read_by_many_tasks(spark, tmp_path, small_ranges, seed, end):
    rows = cells(seed)
    with open(tmp_path / "t.csv", "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
        writer.writerow(["n", "text", "more\nname"])
        writer.writerows(rows)
        out.write(end + end)
    frame = readers.csv(spark, str(tmp_path / "t.csv"), "n long, text string, `more\nname` string", multi_line=True)
    want = [(n, t or None, m) for n, t, m in rows]
    assert sorted(tuple(r) for r in frame.collect()) == sorted(want, key=lambda r: r[0])
    assert spark.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions() > 10
    assert frame.rdd.getNumPartitions() > 10


def test_several_files_and_what_is_odd_about_them(spark, tmp_path, small_ranges):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.csv").write_text('k,v\n1,"one\ntwo"\n\n2,x')
    (tmp_path / "f" / "b.csv").write_text('k,v\n3,"' + "long\n" * 400 + '"\n4,y\n')
    (tmp_path / "f" / "c.csv").write_text('k,v\n5,"never\nclosed\n')
    (tmp_path / "f" / "d.csv").write_text("k,v\n")
    (tmp_path / "f" / "e.csv").write_text("")
    got = {r["k"]: r["v"] for r in readers.csv(spark, str(tmp_path / "f"), "k int, v string", multi_line=True).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4)} == {1: "one\ntwo", 2: "x", 3: "long\n" * 400, 4: "y"}
    assert set(got) == {1, 2, 3, 4, 5} and got[5].lstrip('"').startswith("never\nclosed")


@pytest.mark.parametrize("value, text", [(2.5, "2.5"), (-0.0, "-0"), ("two\nlines é", "two\nlines é"), ("x", "x"), ("é", "é"), (None, "None"), ("", "")])
def test_a_saved_scalar_has_no_line_end(spark, folder, value, text):
    kind = "string" if isinstance(value, str) else "double"
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    for _ in range(2):  # saved over itself
        assert sinks.save_scalar(frame, folder("one")) is frame
        parts = glob.glob(folder("one") + "/part-*")
        assert b"".join(open(p, "rb").read() for p in parts) == text.encode() and len(parts) <= 1
    assert [r.line for r in sinks.scalar_lines(frame).collect()] == ([] if value is None else [text])


@pytest.mark.parametrize("columns", [
    {"a": [1, -22], "name": ["x", "long é"], "v": [1.5, None], "t": [True, False], "n": [None, "q"], "whole": [2.0, 3.0], "wide header": [1, 2]},
    {"v": [0.1234567, 2.5], "w": [1234567.25, 0.1]},
    {"s": [1e-9, 5.0], "big": [123456789.125, 2.5], "none": [None, None]},
    {"zero": [0.0, -0.0], "inf": [float("inf"), 1.25], "z": [1e-7, 0.0]},
])
def test_aligned_tables_equal_those_of_pandas(spark, columns):
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    ddl = ", ".join(f"`{c}` {kinds[type(next((x for x in v if x is not None), 0.0))]}" for c, v in columns.items())
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*columns.values()), 1)], f"seq int, {ddl}").repartition(3)
    lines = [r.line for r in sinks.table_lines(frame, "seq").orderBy("at").collect()]
    want = pd.DataFrame({c: [float("nan") if x is None and ddl.split(f"`{c}` ")[1].startswith("double") else x for x in v] for c, v in columns.items()})
    assert lines == want.to_string(index=False).split("\n")


def test_an_aligned_table_without_rows_has_its_names(spark):
    frame = spark.createDataFrame([], "seq int, a double, bc string")
    assert [tuple(r) for r in sinks.table_lines(frame, "seq").collect()] == [(0, " a bc")]
