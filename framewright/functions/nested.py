"""Paths into nested values, arrays and maps as Column builders."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


_STEPS = re.compile(r"`((?:[^`]|``)*)`|([^.]+)")


def path(name: str | int | Column) -> Column:
    """``a.0.b`` walks into column ``a``; a whole number as a step indexes a list. A name with dots is quoted: ```x.y`.0``.

    On a key/value frame the fields ``0`` and ``1`` are the key and the value. A Column is taken as it is.
    """
    if isinstance(name, Column):
        return name
    if isinstance(name, int):
        return F.col(("key", "value")[name])
    steps = [quoted.replace("``", "`") if quoted else plain for quoted, plain in _STEPS.findall(str(name))]
    first, *rest = steps
    return walk(F.col(f"`{first.replace('`', '``')}`"), rest)


def walk(c: Column, steps: list[str]) -> Column:
    """Follow the steps of a path from ``c``; a step past the end of a list gives null."""
    return reduce(step_into, steps, c)


def step_into(c: Column, step: str | int) -> Column:
    """A field of a record, or an element of a list: 0 is the first, -1 the last."""
    try:
        index = int(step)
    except ValueError:
        return c[step]
    return F.try_element_at(c, F.lit(index + 1 if index >= 0 else index))


def first_items(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def last_items(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - F.lit(n), F.lit(0)) + 1, F.lit(n))


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once: inside a lambda an outer expression would be worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sort_items(items: Column, key=lambda x: x, desc: bool = False, n: int | None = None) -> Column:
    """Sort an array by ``key(element)``; equal keys keep their order, missing keys come last. ``n``: the first so many only."""

    def mark(x: Column, i: Column) -> Column:
        known = key(x).isNotNull() if desc else key(x).isNull()
        return F.struct(known.alias("known"), key(x).alias("key"), (-i if desc else i).alias("at"))

    def sort(whole: Column) -> Column:
        places = F.sort_array(F.transform(whole, mark), asc=not desc)
        if n is not None:
            places = F.slice(places, 1, n)
        return F.transform(places, lambda p: F.get(whole, -p["at"] if desc else p["at"]))

    return let(items, sort)


def top_items(items: Column, n: int) -> Column:
    """The ``n`` largest elements of an array, largest first."""
    return F.slice(F.sort_array(items, asc=False), 1, n)


def array_sum(items: Column, kind: str = "double") -> Column:
    """Sum of an array as type ``kind`` (``bigint`` keeps whole numbers exact); nulls are skipped, the empty array gives zero."""
    zero = F.lit(0).cast(kind)
    return F.aggregate(items, zero, lambda total, x: total + F.coalesce(x.cast(kind), zero))


def join_items(items: Column, sep: str, show=lambda x: x.cast("string")) -> Column:
    """The elements as texts, joined by ``sep``; ``show`` makes the text of an element, nulls are passed over."""
    return F.array_join(F.transform(items, show), sep)


def reversed_items(c: Column) -> Column:
    """A text or an array, last character or element first."""
    return F.reverse(c)


def uniq_items(items: Column) -> Column:
    """Distinct elements in order of first appearance."""
    return F.array_distinct(items)


def count_items(items: Column) -> Column:
    """Number of elements, nulls included; a null array has none to count."""
    return F.size(items).cast("bigint")


def count_characters(text: Column) -> Column:
    return F.length(text).cast("bigint")


def nuniq_items(items: Column) -> Column:
    """Number of distinct elements that are not null."""
    return F.size(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).cast("bigint")


def freq_items(items: Column) -> Column:
    """``(key, value)`` of every distinct element and how often it occurs, most frequent first, ties as first seen.

    The elements are sorted with their places, so that equal ones stand together; a run ends where the next begins.
    """

    def begins(places: Column) -> Column:
        def first(p: Column, j: Column) -> Column:
            return (j == 0) | ~p["key"].eqNullSafe(F.get(places, j - 1)["key"])

        marked = F.transform(places, lambda p, j: F.struct(p["key"].alias("key"), p["at"].alias("at"), j.alias("from"), first(p, j).alias("first")))
        return F.filter(marked, lambda p: p["first"])

    def runs(starts: Column, size: Column) -> Column:
        def counted(p: Column, m: Column) -> Column:
            n = (F.coalesce(F.get(starts, m + 1)["from"], size) - p["from"]).cast("bigint")
            return F.struct((-n).alias("less"), p["at"].alias("at"), p["key"].alias("key"), n.alias("value"))

        ordered = F.sort_array(F.transform(starts, counted))
        return F.transform(ordered, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))

    def whole(xs: Column) -> Column:
        placed = F.sort_array(F.transform(xs, lambda x, i: F.struct(x.alias("key"), i.alias("at"))))
        return let(let(placed, begins), lambda starts: runs(starts, F.size(xs)))

    return let(items, whole)


def array_mean(items: Column) -> Column:
    present = F.filter(items, lambda x: x.isNotNull())
    return F.try_divide(array_sum(present), F.size(present))


def drop_item(items: Column, value) -> Column:
    """All elements but those equal to ``value``; nulls stay unless ``value`` is null."""
    return F.filter(items, lambda x: x.isNotNull() if value is None else ~x.eqNullSafe(F.lit(value)))
