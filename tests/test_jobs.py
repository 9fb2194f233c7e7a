"""Reports, curation and evaluation jobs against plain Python on small tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from framewright.functions import text
from framewright.operators import aggregate, order
from framewright.plans import curation, evaluation, reports


# ---------- reports ----------


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [("a", 3, 0), ("b", 5, 1), ("c", 3, 2), ("d", 9, 3), ("e", 1, 4)]
    return spark.createDataFrame(rows, "key string, value bigint, first_seen bigint").repartition(3)


def test_shapes(pairs):
    def shape(name, **options):
        return [r.key for r in reports.shaped(pairs, name, **options).collect()]

    assert shape("by_key") == list("abcde")
    assert shape("top", n=3) == ["d", "b", "a"]
    assert shape("bottom", n=2) == ["e", "a"]
    assert shape("largest_first") == ["d", "b", "a", "c", "e"]
    assert shape("threshold", at_least=4) == ["b", "d"]


@pytest.mark.parametrize("n, largest, tied", [(1, True, False), (2, True, False), (3, True, True), (1, False, False), (2, False, True), (9, True, True), (None, True, True)])
def test_ties(pairs, n, largest, tied):
    assert reports.has_ties(pairs, n, largest).first()[0] is tied


def test_no_ties_at_all(pairs):
    assert reports.has_ties(pairs.where("key != 'c'")).first()[0] is False
    assert reports.has_ties(pairs.limit(0)).first()[0] is False


def test_fragments_equal_a_plain_search(spark):
    names = ["coffee", "tea", "hat", "shoes", "coffee", "9v cell", "tee", "o", "ébène"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    reserved = ["of", "ea"]
    values = sorted(set(names))
    found = {v[i : i + n] for v in values for n in (1, 2, 3) for i in range(len(v) - n + 1)}
    found = {f for f in found if f.isalpha() and (len(f) > 1 or f in reports.SINGLE_LETTERS) and f not in reserved}
    counts = {f: sum(f in v for v in values) for f in found}
    limit = max(1, int(0.85 * len(values)))
    expected = {f: n for f, n in counts.items() if n <= limit}
    assert {r.fragment: r.n for r in reports.fragments(frame, "n", reserved).collect()} == expected


@pytest.mark.parametrize("value, whole, cut", [(1234.0, False, 1230.0), (149.6, False, 150.0), (42.4, False, 42.0), (7.0, False, 7.0), (7.26, False, 7.3), (2.6, True, 3.0)])
def test_nice_cut(spark, value, whole, cut):
    assert spark.range(1).select(reports.nice_cut(F.lit(value), whole)).first()[0] == cut


def test_sales_report(spark):
    rows = [
        (1, "2026-01-02", "ann", "x", 10.0, "done"), (2, "2026-01-09", "bob", "y", 5.5, "done"),
        (3, "2026-02-01", "ann", "y", 2.25, "done"), (4, "2026-02-01", "cid", "z", 99.0, "back"),
    ]
    facts = spark.createDataFrame(rows, "id int, day string, who string, kind string, v double, state string")
    done, back = F.col("state") == "done", F.col("state") == "back"
    got = {(r.section, r.key): r.value for r in reports.sales_report(facts, done, back, F.col("v"), "kind", "who", "day").collect()}
    assert got == {
        ("completed", ""): 3.0, ("revenue", ""): 17.75, ("average", ""): 5.92, ("returned_share", ""): 25.0,
        ("by_group", "x"): 10.0, ("by_group", "y"): 7.75, ("by_customer", "ann"): 12.25, ("by_customer", "bob"): 5.5,
        ("by_month", "2026-01"): 15.5, ("by_month", "2026-02"): 2.25,
    }


def test_shares_and_classes(spark):
    facts = spark.createDataFrame([(i, "ab"[i % 3 > 0], float(i)) for i in range(9)], "id bigint, k string, v double")
    assert {r.key: r.value for r in reports.share_in_group(facts, "k", F.col("v") > 4).collect()} == {"a": 33.3, "b": 50.0}
    assert {r.key: r.value for r in reports.share_of_total(facts, "k", aggregate.total("v")).collect()} == {"a": 25.0, "b": 75.0}
    sizes = reports.classify(facts, F.col("v"), [("ge", 7), ("ge", 3)], ["l", "m", "s"], "id").collect()
    assert [(r.key, r.value) for r in sizes] == [("m", 4), ("s", 3), ("l", 2)]
    labels = reports.label_groups(facts, "k", F.max("v"), [("lt", 7)], ["low", "high"])
    assert {r.key: r.value for r in labels.collect()} == {"a": "low", "b": "high"}


# ---------- curation ----------


def test_keep_first(spark):
    rows = [(i, random.Random(i).choice("abc")) for i in range(300)] + [(300, None), (301, None)]
    frame = spark.createDataFrame(rows, "id bigint, t string").repartition(5)
    seen, expected = set(), []
    for i, t in rows:
        if t not in seen:
            seen.add(t)
            expected.append(i)
    assert sorted(r.id for r in curation.keep_first(frame, F.col("t"), "id").collect()) == expected


def one_by_one(rows):
    a_seen, b_seen, kept = set(), set(), []
    for i, a, b in sorted(rows):
        if a not in a_seen and b not in b_seen:
            a_seen.add(a)
            b_seen.add(b)
            kept.append(i)
    return kept


def test_two_keys_equal_going_one_by_one(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 60), rnd.randint(0, 60)) for i in range(400)]
    rows += [(1000 + i, 0, rnd.randint(0, 500)) for i in range(300)]  # a hot key
    rows += [(2000 + i, 900 + i // 2, 900 + (i + 1) // 2) for i in range(12)]  # a chain: each shares a key with the next
    frame = spark.createDataFrame(rows, "id bigint, a bigint, b bigint").repartition(6)
    got = curation.keep_first_in_turn(frame, F.col("a"), F.col("b"), "id")
    assert sorted(r.id for r in got.collect()) == one_by_one(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rows = [(i, i // 2, (i + 1) // 2) for i in range(10_000)]  # each row shares a key with the one before
    rows += [(20_000 + i, -1 - i // 2, -1 - (i + 1) // 2) for i in range(9, -1, -1)]
    rows += [(30_000 + i, i % 700, 10_000 + i % 90) for i in range(900)]  # rows that lean on many of the chain
    frame = spark.createDataFrame(rows, "id bigint, a bigint, b bigint").repartition(4)
    cuts = []
    monkeypatch.setattr(curation, "cut_lineage", lambda df, cut=curation.cut_lineage: cuts.append(1) or cut(df))
    got = curation.keep_first_in_turn(frame.where("id < 20000"), F.col("a"), F.col("b"), "id")
    assert sorted(r.id for r in got.collect()) == list(range(0, 10_000, 2))
    assert len(cuts) <= 24  # 3 plain rounds, then 4 and the doubling steps
    got = curation.keep_first_in_turn(frame, F.col("a"), F.col("b"), "id")
    assert sorted(r.id for r in got.collect()) == one_by_one(rows)


@pytest.mark.parametrize("seed", range(4))
def test_chains_that_meet(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 40), rnd.randint(0, 40)) for i in rnd.sample(range(1000), 150)]
    rows += [(2000 + i, 100 + i // 2 + rnd.randint(0, 1), 100 + (i + 1) // 2) for i in range(60)]
    monkeypatch.setattr(curation, "PLAIN_ROUNDS", seed % 2)
    frame = spark.createDataFrame(rows, "id bigint, a bigint, b bigint").repartition(4)
    got = curation.keep_first_in_turn(frame, F.col("a"), F.col("b"), "id")
    assert sorted(r.id for r in got.collect()) == one_by_one(rows)


def test_two_keys_of_no_rows(spark):
    frame = spark.createDataFrame([], "id bigint, a bigint, b bigint")
    assert curation.keep_first_in_turn(frame, F.col("a"), F.col("b"), "id").collect() == []


def test_hash_split(spark):
    tasks = [f"task {i} é" for i in range(400)]
    frame = spark.createDataFrame([(t,) for t in tasks], "t string")
    for r in curation.hash_split(frame, F.col("t")).collect():
        bucket = int(hashlib.md5(r.t.encode()).hexdigest(), 16) % 100
        assert (r.bucket, r.split) == (bucket, "test" if bucket < 4 else "val" if bucket < 8 else "train")


OFF = (0.0, 0.004, -0.006, 0.02, -3.0)  # the first three are within the tolerance


def answers_by_rule(rnd, words, count):
    """Answers with a frame and numbers kept apart, so that equality is known from how they were made."""
    made = []
    for _ in range(count):
        shape = tuple(rnd.choice(words) for _ in range(rnd.randint(1, 3)))
        made.append((shape, [rnd.choice((rnd.randint(-9, 9), round(rnd.uniform(-50, 50), 2))) for _ in shape]))
    return made


def written(shape, values, blank=""):
    return blank + f"\n{blank}".join(f"{word} is {value!r}" for word, value in zip(shape, values)) + blank


def test_leaks_are_told_by_how_they_were_made(spark):
    rnd = random.Random(23)
    banned = answers_by_rule(rnd, ("alpha", "beta", "gamma"), 120)
    shown, leaking = [], set()
    for shape, values in banned:
        for off in OFF:
            moved = [v + off for v in values] if off else values
            if abs(off) < 0.01:
                leaking.add(len(shown))
            shown.append(written(shape, moved, rnd.choice(("", " ", "\n"))))
    for shape, values in answers_by_rule(rnd, ("delta", "epsilon"), 80):
        shown.append(written(shape, values))
    shown += ["", "\n", written(banned[0][0], banned[0][1]) + "\nand more"]
    # a moved answer may come near another banned one with the same words
    for at, text_ in enumerate(shown):
        own = re.findall(r"(\w+) is (-?[\d.]+(?:e-?\d+)?)", text_)
        for shape, values in banned:
            if tuple(w for w, _ in own) == shape and "more" not in text_ and all(abs(float(x) - v) < 0.01 for (_, x), v in zip(own, values)):
                leaking.add(at)
    frame = spark.createDataFrame(list(enumerate(shown)), "id bigint, a string")
    against = spark.createDataFrame([(written(*b),) for b in banned], "b string")
    assert {r.id for r in curation.without_leaks(frame, "a", against, "b", negate=False).collect()} == leaking
    assert {r.id for r in curation.without_leaks(frame, "a", against, "b").collect()} == set(range(len(shown))) - leaking
    marked = curation.mark_leaks(frame, "a", against, "b")
    assert {r.id for r in marked.collect() if r.leaked} == leaking and marked.count() == len(shown)
    assert 300 < len(leaking) < 500


def test_row_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "n int, t string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "n int, t string")
    assert {tuple(r) for r in curation.row_differences(a, b).collect()} == {(1, "x", 2, 1), (3, "z", 0, 1)}
    assert curation.row_differences(a, a).isEmpty()
    plan = curation.row_differences(a, a)
    assert plan.collect() == [] and "HashAggregate" in plan._jdf.queryExecution().executedPlan().toString()


def test_equal_tables_whatever_their_order(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice([None, 1, 2]), rnd.choice([None, "x", "y"]), rnd.choice([None, 0.0, 1.5, float("nan")])) for _ in range(500)]
    ddl = "a int, `b.c` string, d double"
    one = spark.createDataFrame(rows, ddl)
    shuffled = rnd.sample(rows, len(rows))
    two = spark.createDataFrame([(a, b, -0.0 if d == 0.0 else d) for a, b, d in shuffled], ddl).repartition(5)
    assert curation.equal_rows(one, two).first()["equal"]
    for other in (rows[1:], rows + rows[:1], rows[1:] + rows[1:2], [*rows[1:], (None, "z", None)], [(1, None, None), *rows[1:]] if rows[0] != (1, None, None) else rows[1:]):
        assert not curation.equal_rows(one, spark.createDataFrame(other, ddl)).first()["equal"]
    # Nulls keep their columns apart, and two equal rows do not cancel out.
    assert not curation.equal_rows(spark.createDataFrame([(1, None)], "a int, b int"), spark.createDataFrame([(None, 1)], "a int, b int")).first()["equal"]
    assert not curation.equal_rows(spark.createDataFrame([(1,), (1,)], "a int"), spark.createDataFrame([(2,), (2,)], "a int")).first()["equal"]
    assert curation.equal_rows(one.limit(0), two.limit(0)).first()["equal"]
    assert curation.equal_rows(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "a bigint")).first()["equal"]


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_order_breaks_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(curation, "ORDER_BLOCK", block)
    values = [1, 2, 2, 5, 4, 6, 1, 1, 9, 8]
    frame = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "pos bigint, v int").repartition(4)
    assert curation.order_breaks(frame, "v").first()[0] == 3
    assert curation.order_breaks(frame, "v", desc=True).first()[0] == 4
    words = spark.createDataFrame([(1, "9"), (2, "10"), (3, "a"), (4, "b")], "pos bigint, v string")
    assert curation.order_breaks(words, "v").first()[0] == 0


def test_table_check(spark):
    want = spark.createDataFrame([(2, "b"), (1, "a"), (2, "c")], "n int, t string")
    placed = order.with_position(want, "n", "t")
    assert tuple(curation.table_check(placed, want, "n").first()) == (True, "")
    assert tuple(curation.table_check(order.with_position(want, F.desc("n")), want, "n").first()) == (False, "wrong order")
    assert tuple(curation.table_check(order.with_position(want, F.desc("n")), want, "n", desc=True).first()) == (True, "")
    assert curation.table_check(placed.where("t != 'c'"), want, "n").first().note == "different rows"
    assert curation.table_check(placed.withColumnRenamed("t", "u"), want, "n").first().note == "header n,u"


def test_audits(spark):
    rows = [("p", "train", "x"), ("p", "test", "x"), ("q", "train", "y"), ("r", "val", "y"), ("r", "val", "z")]
    frame = spark.createDataFrame(rows, "task string, split string, grp string")
    audit = {r.key: (r.splits, r.n) for r in curation.overlap_audit(frame, F.col("task"), "split").collect()}
    assert audit == {hashlib.md5(b"p").hexdigest(): (2, 2), hashlib.md5(b"r").hexdigest(): (1, 2)}
    held = {r.split: (r.n, r.held_out_rows) for r in curation.held_out_audit(frame, "grp", "x", "split").collect()}
    assert held == {"train": (2, 1), "test": (1, 1), "val": (2, 0)}
    cover = curation.coverage(frame, "task", {"p": "p", "r": "[qr]"}, 0.5, "split").collect()
    assert {(r.split, r.pattern): r.enough for r in cover} == {
        ("train", "p"): True, ("train", "r"): True, ("test", "p"): True, ("test", "r"): False, ("val", "p"): False, ("val", "r"): True,
    }
    domain = curation.domain_check(frame, {"grp": ["x", "y", "w"], "split": ["train", "val", "test"]})
    assert {r.column: (r.undeclared, r.not_found) for r in domain.collect()} == {"grp": (1, 1), "split": (0, 0)}
    with pytest.raises(ValueError):
        curation.domain_check(frame, {"nothing": []})


def test_prompt_rows(spark):
    examples = spark.createDataFrame([("t1", " count rows ", "n"), ("t2", "sum", "s")], "tab string, task string, answer string")
    about = spark.createDataFrame([("t1", "a table\n"), ("t2", "")], "tab string, description string")
    rows = curation.prompt_rows(examples, about, "tab", "task", "answer", F.lit("Rules\n"), "Code only.").collect()
    assert {r.tab: (r.prompt, r.completion) for r in rows} == {
        "t1": ("Rules\n\n# Data\n\na table\n\n# Task\n\ncount rows\n\nCode only.\n", "n"),
        "t2": ("Rules\n\n# Task\n\nsum\n\nCode only.\n", "s"),
    }
    mixed = spark.createDataFrame([(3, "go", "x")], "tab int, task string, answer string")
    named = spark.createDataFrame([(3.0, "three")], "tab double, description string")
    made = curation.prompt_rows(mixed, named, "tab", "task", "answer", F.lit("Do."), "End.", headings=("About", "Job")).first()
    assert made.prompt == "Do.\n\nAbout\n\nthree\n\nJob\n\ngo\n\nEnd.\n"


def test_two_keys_in_batches(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", "x"), (5, None, "z"), (6, None, "w")]
    frame = spark.createDataFrame(rows, "id bigint, a string, b string")
    assert sorted(r.id for r in curation.keep_first_of_two(frame, F.col("a"), F.col("b"), "id").collect()) == [1, 3, 5]


# ---------- evaluation ----------


def results(spark, rows):
    return spark.createDataFrame(rows, "run string, set string, id string, ok boolean, tokens bigint")


def test_scores_and_sizes(spark):
    """Expected values by arithmetic: run k answers k of 8 questions of the first set, each with 25 * k tokens."""
    rows = [(f"run{k}", "first", f"q{i}", i < k, 25 * k) for k in (1, 2, 6) for i in range(8)]
    rows += [("run6", "second", "p0", True, 1500), ("lone", "second", "p1", True, 12000), ("run1", "first", "q9", False, None)]
    got = {r.run: r for r in evaluation.comparison(results(spark, rows), "run", "set", ["first", "second", "third"], "first", F.col("ok"), F.col("tokens")).collect()}
    assert [got[f"run{k}"].first for k in (2, 6)] == ["2/8 (25%)", "6/8 (75%)"] and got["run1"].first == "1/9 (11%)"
    assert (got["lone"].first, got["lone"].second, got["lone"].third) == ("", "1/1 (100%)", "")
    assert got["run2"].mean_size == "50" and got["run2"].size_per_correct == str(8 * 50 // 2)
    assert got["lone"].mean_size == got["lone"].size_per_correct == "12,000"
    pivoted = {r.run: r for r in evaluation.pivoted_scores(results(spark, rows), "run", "set", ["first", "third"], F.col("ok")).collect()}
    assert pivoted["run6"].first == "6/8 (75%)" and pivoted["lone"].first == "" and {r.third for r in pivoted.values()} == {""}
    rolled = {r.set: r for r in evaluation.rollup(results(spark, rows), "set", F.col("ok"), F.col("tokens")).collect()}
    assert (rolled["second"].ok, rolled["second"].total, rolled["second"].mean_size) == (2, 2, 6750.0)
    assert (rolled["first"].ok, rolled["first"].total, rolled["first"].score) == (9, 25, "9/25 (36%)")


def test_fair_labels_and_left_out(spark):
    rows = [("m", "gen", "q1", True, 1), ("m", "gen", "q2", False, 1), ("m", "new", "q3", False, 1), ("m", "new", "q4", True, 1), ("m", "new", "q4", True, 1)]
    frame = results(spark, rows)
    flagged = spark.createDataFrame([("q3",)], "id string")
    labelled = spark.createDataFrame([("q2",), ("q3",)], "id string")
    assert sorted(r.id for r in evaluation.fair(frame, flagged, "id").collect()) == ["q1", "q2", "q4", "q4"]
    assert tuple(evaluation.label_split(frame, labelled, flagged, "id", F.col("ok")).first()) == ("3/3 (100%)", "0/1 (0%)")
    numbers_ = spark.createDataFrame([(i, i % 3 > 0) for i in range(9)], "id int, ok boolean")
    some = spark.createDataFrame([(1,), (2,), (7,)], "id bigint")
    doubles = spark.createDataFrame([(0.0,), (2.0,)], "id double")
    assert sorted(r.id for r in evaluation.fair(numbers_, some, "id").collect()) == [0, 3, 4, 5, 6, 8]
    assert tuple(evaluation.label_split(numbers_, some, doubles, "id", F.col("ok")).first()) == ("3/5 (60%)", "2/2 (100%)")
    only = evaluation.label_split(frame, labelled, flagged, "id", F.col("ok"), sets=("set", ["gen"]))
    assert tuple(only.first()) == ("1/1 (100%)", "0/1 (0%)")
    assert {tuple(r) for r in evaluation.left_out(frame, flagged, "id", "set").collect()} == {("gen", 2, 0), ("new", 2, 1)}


def test_last_k_mean(spark):
    log = spark.createDataFrame([(i, float(i) if i % 2 else None) for i in range(20)], "step bigint, loss double")
    assert tuple(evaluation.last_k_mean(log, "step", "loss", 3).first()) == (17.0, 19)


def test_text_size(spark):
    frame = spark.createDataFrame([("a", "one two\nthree"), ("a", " x\n"), ("b", "four words are here")], "v string, t string")
    got = {r.v: (r.chars, r.lines, r.words, r.ratio) for r in evaluation.text_size(frame, "t", "v", "a").collect()}
    assert got == {"a": (14, 3, 4, "1.0×"), "b": (19, 1, 4, "1.4×"), "all": (33, 4, 8, "2.4×")}
