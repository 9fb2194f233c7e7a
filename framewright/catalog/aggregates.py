"""Aggregates, groups, statistics and pivots."""

import pandas as pd
from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.functions import nested
from framewright.functions.numbers import round_even, round_exact
from framewright.operators import aggregate as agg
from framewright.operators import elementwise

VALUES = "(select event_id, event_type, user_id, nullif(value, 12.31) as value from events)"


def values(t):
    return t.events.select("event_id", "event_type", "user_id", F.nullif("value", F.lit(12.31)).alias("value"))


@query(f"select round_even(coalesce(sum(value), 0), 2) as value from {VALUES}")
def agg_sum(t):
    return agg.summarise(values(t), value=round_even(agg.total("value"), 2))


@query(f"select coalesce(sum(value), 0)::double as value from {VALUES} where event_type = 'nothing'")
def agg_sum_of_nothing(t):
    return agg.summarise(values(t).where(F.col("event_type") == "nothing"), value=agg.total("value"))


@query(f"select round_even(avg(value), 4) as value from {VALUES}")
def agg_mean(t):
    return agg.summarise(values(t), value=round_even(F.avg("value"), 4))


@query(f"select max(value) as value from {VALUES}")
def agg_max(t):
    return agg.summarise(values(t), value=F.max("value"))


@query(f"select min(value) as value from {VALUES}")
def agg_min(t):
    return agg.summarise(values(t), value=F.min("value"))


@query(f"select count(*) as value from {VALUES}")
def agg_count(t):
    return agg.summarise(values(t), value=agg.rows())


@query("select doc_id, length(text)::bigint as chars, len(string_split(text, ' '))::bigint as items from documents")
def count_items(t):
    return t.documents.select(
        "doc_id",
        nested.count_characters(F.col("text")).alias("chars"),
        nested.count_items(F.split("text", " ")).alias("items"),
    )


@query("""select vec_id, round_even(list_sum(embedding::double[]), 5) as total, round_even(list_avg(embedding::double[]), 6) as mean,
  list_max(embedding)::double as largest, list_min(embedding)::double as smallest, len(embedding)::bigint as n from embeddings""")
def array_agg(t):
    e = F.col("embedding")
    return t.embeddings.select(
        "vec_id",
        round_even(nested.array_sum(e), 5).alias("total"),
        round_even(nested.array_mean(e), 6).alias("mean"),
        F.array_max(e).cast("double").alias("largest"),
        F.array_min(e).cast("double").alias("smallest"),
        F.size(e).cast("bigint").alias("n"),
    )


# keys moved above 2^53, where doubles are too coarse
@query("""select doc_id, sum(9007199254740992 + k)::bigint as total, count(distinct k) as kinds
from (select doc_id, unnest([doc_id, 1, doc_id]) as k from documents) group by doc_id""")
def array_agg_whole(t):
    keys = F.array("doc_id", F.lit(1).cast("bigint"), "doc_id")
    large = F.transform(keys, lambda k: F.lit(9007199254740992) + k)
    return t.documents.select("doc_id", nested.array_sum(large, "bigint").alias("total"), nested.nuniq_items(keys).alias("kinds"))


@query("""select max(o_orderkey + 9007199254740992)::bigint as o_orderkey, max(o_custkey + 9007199254740992)::bigint as o_custkey,
  max(o_orderstatus) as o_orderstatus, max(o_orderpriority) as o_orderpriority from orders""")
def max_all_columns_exact(t):
    moved = [(F.col(c).cast("bigint") + F.lit(9007199254740992)).alias(c) for c in ("o_orderkey", "o_custkey")]
    return agg.wide_columns(t.orders.select(*moved, "o_orderstatus", "o_orderpriority"), F.max)


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _all_columns(name, spark_fn, sql_fn, digits):
    parts = [f"select '{c}' as \"column\", round_even({sql_fn}({c}), {digits}) as value from lineitem" for c in LINE_COLUMNS]

    @query(" union all ".join(parts), name=name)
    def run(t):
        every = agg.agg_all_columns(t.lineitem, spark_fn, LINE_COLUMNS)
        return every.withColumn("value", round_even(F.col("value"), digits))


_all_columns("agg_all_columns", agg.total, "sum", 1)
_all_columns("mean_all_columns", F.avg, "avg", 3)
_all_columns("max_all_columns", F.max, "max", 2)
_all_columns("min_all_columns", F.min, "min", 2)


@query(f"select count(distinct value) as value from {VALUES}")
def agg_nuniq(t):
    return agg.nuniq(values(t), "value")


@query("select count(*) as value from (select distinct l_orderkey, l_linenumber from lineitem)")
def nuniq_rows(t):
    return agg.nuniq_rows(t.lineitem.select("l_orderkey", "l_linenumber"))


GROUPED = f"(select * replace (nullif(event_type, 'error') as event_type) from {VALUES}) where event_type is not null"


def grouped_values(t):
    return values(t).withColumn("event_type", F.nullif("event_type", F.lit("error")))


def _by(name, measure, sql):
    @query(f"select event_type as key, {sql} as value from {GROUPED} group by event_type", name=name)
    def run(t):
        return agg.by(grouped_values(t), "event_type", measure())


_by("by_count", lambda: agg.rows(), "count(*)")
_by("by_sum", lambda: round_even(agg.total("value"), 2), "round_even(sum(value), 2)")
_by("by_mean", lambda: round_even(F.avg("value"), 4), "round_even(avg(value), 4)")
_by("by_max", lambda: F.max("value"), "max(value)")
_by("by_min", lambda: F.min("value"), "min(value)")
_by("by_nuniq", lambda: F.count_distinct("user_id"), "count(distinct user_id)")
_by("by_share", lambda: agg.share(F.col("value") > 50), "round_even(count(*) filter (where value > 50) * 1.0 / count(*) * 100, 1)")


@query(f"select nullif(event_type, 'error') as key, count(*) as value from {VALUES} group by 1")
def by_keep_null(t):
    return agg.by(grouped_values(t), "event_type", agg.rows(), keep_null=True)


@query("""select user_id, sum(k)::bigint as total, max(k) as largest, count(*) as n
from (select user_id, json_extract(props, '$.k')::bigint as k from events) group by user_id""")
def by_apply(t):
    """A block in pandas over a column of numbers; its partial results are merged, so no user's rows come together."""

    def partial(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("user_id")["k"].agg(total="sum", largest="max", n="size").reset_index()

    numbers = t.events.select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return agg.by_block(
        numbers, partial, "user_id bigint, total bigint, largest bigint, n bigint", "user_id",
        total=F.sum("total"), largest=F.max("largest"), n=F.sum("n"),
    )


@query("select l_returnflag, round_even(median(l_extendedprice), 3) as median from lineitem group by l_returnflag")
def by_median(t):
    found = agg.median(t.lineitem, "l_extendedprice", ("l_returnflag",), few_groups=True)
    return found.withColumn("median", round_even(F.col("median"), 3))


@query("select l_orderkey, l_linenumber, round_even(l_extendedprice * (1 - l_discount), 1) as rev from lineitem")
def round_col(t):
    lines = t.lineitem.withColumn("rev", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return elementwise.round_column(lines, "rev", 1).select("l_orderkey", "l_linenumber", "rev")


@query("select event_id, printf('%.1f', value * 1.15)::double as value from events")
def round_scalar(t):
    return t.events.select("event_id", round_exact(F.col("value") * 1.15, 1).alias("value"))


@query("select round_even(stddev_pop(l_extendedprice), 2) as value from lineitem")
def stat_std(t):
    return agg.summarise(t.lineitem, value=round_even(F.stddev_pop("l_extendedprice"), 2))


@query("""select l_returnflag, round_even(quantile_cont(l_extendedprice, 0.9), 3) as p90, round_even(quantile_cont(l_extendedprice, 0.25), 3) as p25
from lineitem group by l_returnflag""")
def stat_percentile(t):
    found = agg.percentiles(t.lineitem, "l_extendedprice", {"p90": 0.9, "p25": 0.25}, ("l_returnflag",), few_groups=True)
    return found.select("l_returnflag", *[round_even(F.col(c), 3).alias(c) for c in ("p90", "p25")])


@query("select round_even(median(l_extendedprice), 3) as median from lineitem")
def stat_median(t):
    return agg.median(t.lineitem, "l_extendedprice").select(round_even(F.col("median"), 3).alias("median"))


@query("""select round_even((avg(v * v * v) - 3 * avg(v) * avg(v * v) + 2 * pow(avg(v), 3)) / pow(var_pop(v), 1.5), 4) as value
from (select value / 100 as v from events)""")
def stat_skew(t):
    return agg.summarise(t.events, value=round_even(F.skewness(F.col("value") / 100), 4))


@query("""select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as "F",
  count(*) filter (where o_orderstatus = 'O') as "O", count(*) filter (where o_orderstatus = 'P') as "P",
  count(*) filter (where o_orderstatus = 'X') as "X" from orders group by o_orderpriority""")
def pivot_count(t):
    return agg.pivot_count(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P", "X"])


@query("""select o_orderpriority, round_even(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'F'), 0), 2) as "F",
  round_even(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'O'), 0), 2) as "O" from orders group by o_orderpriority""")
def pivot_sum(t):
    def money(cell):
        return round_even(agg.total(F.when(cell, F.col("o_totalprice"))), 2)

    return agg.pivot(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O"], money)


@query("select o_orderpriority as key, round_even(sum(o_totalprice), 2) as value from orders group by o_orderpriority")
def group_sum_sorted(t):
    sums = agg.group_sum_sorted(t.orders, "o_orderpriority", F.col("o_totalprice"))
    return sums.withColumn("value", round_even(F.col("value"), 2))
