"""Analytic queries over a table of facts: every function keeps to one pass and one shuffle if it can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.numbers import round_even, true_div
from framewright.functions.text import slice_text
from framewright.operators.aggregate import by, by_many, percentiles, rows, share, total
from framewright.operators.order import ascending, bottom, counted, descending, sort, top
from framewright.session import cut_lineage

# A fragment is one to three letters; single letters come from this set only.
SINGLE_LETTERS = list("eiukcdflmhjwzv")
FRAGMENT_SIZES = (1, 2, 3)
FRAGMENT_SHARE = 0.85


def month_of(date: Column) -> Column:
    """``YYYY-MM`` of a date: the first seven characters of its text."""
    return slice_text(date.cast("string"), 0, 7)


def shaped(pairs: DataFrame, shape: str, n: int | None = None, at_least=None) -> DataFrame:
    """Order or cut a key/value frame: by_key, top, bottom, largest_first or threshold."""
    if shape == "by_key":
        return pairs.orderBy("key")
    if shape == "top":
        return top(pairs, n, "value", _seen(pairs))
    if shape == "bottom":
        return bottom(pairs, n, "value", _seen(pairs))
    if shape == "largest_first":
        return sort(pairs, "value", _seen(pairs), desc=True)
    if shape == "threshold":
        return pairs.where(F.col("value") >= F.lit(at_least)).orderBy("key")
    raise ValueError(f"unknown shape {shape!r}")


def _seen(pairs: DataFrame) -> str:
    return "first_seen" if "first_seen" in pairs.columns else "key"


def grouped(facts: DataFrame, key, measure: Column, where: Column | None = None, seq: str | None = None) -> DataFrame:
    """A measure for every group, over the rows that meet a condition."""
    return by(facts if where is None else facts.where(where), key, measure, seq)


def share_in_group(facts: DataFrame, key, condition: Column, seq: str | None = None) -> DataFrame:
    """Percentage of the rows of every group that meet a condition, one decimal."""
    return by(facts, key, share(condition), seq)


def ratio(facts: DataFrame, key, upper: Column, lower: Column, digits: int = 2) -> DataFrame:
    """One measure divided by another, for every group."""
    both = by_many(facts, key, upper=upper, lower=lower)
    return both.select("key", round_even(true_div(F.col("upper"), F.col("lower")), digits).alias("value"))


def share_of_total(facts: DataFrame, key, measure: Column) -> DataFrame:
    """Every group's percentage of the sum over all groups, one decimal.

    The grand total is a one-value subquery over the groups: no join, and no second pass over the
    facts, since both read the same shuffle.
    """
    part = by(facts, key, measure)
    grand = part.agg(total("value")).scalar()
    return part.select("key", round_even(true_div(F.col("value"), grand) * 100, 1).alias("value"))


def classes(value: Column, cuts: list[tuple[str, object]], names: list[str]) -> Column:
    """Class name of a value: the first cut ``(operator, limit)`` that holds decides, else the last name."""
    tests = {
        "ge": Column.__ge__, "gt": Column.__gt__, "lt": Column.__lt__, "le": Column.__le__,
    }
    chain = F
    for (op, limit), name in zip(cuts, names):
        chain = chain.when(tests[op](value, limit), F.lit(name))
    return chain.otherwise(F.lit(names[-1]))


def classify(facts: DataFrame, value: Column, cuts, names, seq: str) -> DataFrame:
    """Number of rows in every class, most numerous first, ties as first seen."""
    return sort(
        counted(facts.select(seq, classes(value, cuts, names).alias("class")), "class", seq),
        "value", "first_seen", desc=True,
    )


def label_groups(facts: DataFrame, key, measure: Column, cuts, names) -> DataFrame:
    """A class name for every group, judged by a measure of the group."""
    return by(facts, key, measure).select("key", classes(F.col("value"), cuts, names).alias("value"))


def scaled(facts: DataFrame, key, measure: Column, factor: float, digits: int = 2) -> DataFrame:
    """A measure for every group times a factor, rounded."""
    return by(facts, key, round_even(measure.cast("double") * F.lit(float(factor)), digits))


def distinct_values(facts: DataFrame, name: str) -> DataFrame:
    """The distinct values of a column, in ascending order."""
    return facts.select(name).distinct().orderBy(name)


def export(facts: DataFrame, where: Column, names: list[str], by_column: str, seq: str | None = None, desc: bool = False):
    """The rows that meet a condition, sorted and cut to the columns of an export file."""
    order = (descending if desc else ascending)(by_column, seq)
    return facts.where(where).orderBy(*order).select(*names)


def has_ties(pairs: DataFrame, n: int | None = None, largest: bool = True) -> DataFrame:
    """Whether equal values make the first ``n`` entries, or the whole order, depend on tie-breaking.

    With ``n`` the entry after the cut is looked at too.
    """
    if n is not None:
        pairs = top(pairs, n + 1) if largest else bottom(pairs, n + 1)
        return pairs.agg((F.count_distinct("value") < F.count("value")).alias("tied"))
    repeated = pairs.groupBy("value").agg(rows().alias("_n"))
    return repeated.agg(F.coalesce(F.max("_n") > 1, F.lit(False)).alias("tied"))


def nice_cut(value: Column, whole: bool = False) -> Column:
    """A threshold that reads well: tens from 300 on, whole numbers from 10 on, else one decimal."""
    if whole:
        return F.rint(value)
    size = F.abs(value)
    return (
        F.when(size >= 300, round_even(value, -1))
        .when((size >= 10) | (value == F.rint(value)), F.rint(value))
        .otherwise(round_even(value, 1))
    )


def class_cuts(facts: DataFrame, value: str, fractions: dict[str, float], whole: bool = False) -> DataFrame:
    """Exact quantiles of a column as readable thresholds, one column each."""
    exact = percentiles(facts, value, fractions)
    return exact.select(*[nice_cut(F.col(name), whole).alias(name) for name in fractions])


def fragments(names: DataFrame, name: str, reserved: list[str] = ()) -> DataFrame:
    """Fragments of one to three letters that match some, but not nearly all, distinct values.

    A value gives each of its fragments once, so the count is one aggregate over ``(fragment)``.
    """
    values = names.select(F.col(name).alias("_v")).distinct()

    def of_size(size: int) -> Column:
        starts = F.when(F.length("_v") >= size, F.sequence(F.lit(1), F.length("_v") - size + 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.substring("_v", i, F.lit(size)))

    pieces = F.array_distinct(F.concat(*[of_size(n) for n in FRAGMENT_SIZES]))
    pieces = F.filter(
        pieces,
        lambda f: f.rlike(r"^\p{L}+$") & ((F.length(f) > 1) | f.isin(SINGLE_LETTERS)) & ~f.isin(list(reserved)),
    )
    matched = values.select(F.explode(pieces).alias("fragment")).groupBy("fragment").agg(rows().alias("n"))
    limit = values.agg(F.greatest(F.lit(1), F.floor(rows() * F.lit(FRAGMENT_SHARE))).alias("limit")).scalar()
    return matched.where(F.col("n") <= limit)


def sales_report(facts: DataFrame, done: Column, returned: Column, value: Column, group: str, customer: str, date: str):
    """Report lines ``(section, key, value)``: counts and money, then three group reports.

    The facts are read once: one grouping-sets aggregate, checkpointed, holds the figures of all
    sections, one row per group, customer and month.
    """
    sides = {"by_group": "_group", "by_customer": "_customer", "by_month": "_month"}
    marked = facts.select(
        done.alias("_done"), returned.alias("_returned"), F.when(done, value).alias("_money"),
        F.col(group).cast("string").alias("_group"), F.col(customer).cast("string").alias("_customer"),
        month_of(F.col(date)).alias("_month"),
    )
    columns = [F.col(c) for c in sides.values()]
    figures = cut_lineage(
        marked.groupingSets([[c] for c in columns] + [[]], *columns).agg(
            F.count_if("_done").alias("_n"),
            total("_money").alias("_sum"),
            share(F.col("_returned")).alias("_share"),
            *[F.grouping(c).alias(f"_all{c}") for c in sides.values()],
        )
    )
    over_all = F.lit(True)
    for c in sides.values():
        over_all = over_all & (F.col(f"_all{c}") == 1)
    head = figures.where(over_all).select(
        F.col("_n").cast("double").alias("completed"),
        round_even(F.col("_sum"), 2).alias("revenue"),
        round_even(true_div(F.col("_sum"), F.nullif("_n", F.lit(0))), 2).alias("average"),
        F.col("_share").alias("returned_share"),
    )
    head = head.unpivot([], head.columns, "section", "value")
    report = head.select("section", F.lit("").alias("key"), "value")
    for section, c in sides.items():
        own = figures.where((F.col(f"_all{c}") == 0) & F.col(c).isNotNull() & (F.col("_n") > 0))
        lines = own.select(F.lit(section).alias("section"), F.col(c).alias("key"), round_even(F.col("_sum"), 2).alias("value"))
        report = report.unionByName(top(lines, 3, "value", "key") if section == "by_customer" else lines)
    return report
