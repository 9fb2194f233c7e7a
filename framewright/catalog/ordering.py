"""Order, limits, top-k, distinct values and frequencies.

A ``pos`` column carries the order, so that it can be checked in a result without one.
"""

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.functions import nested
from framewright.operators import aggregate as agg
from framewright.operators import order

PLACED_VALUES = "(select event_id, nullif(value, 12.31) as value from events)"


def placed_values(t):
    return t.events.select("event_id", F.nullif("value", F.lit(12.31)).alias("value"))


@query(f"select event_id, value, row_number() over (order by value asc nulls last, event_id) as pos from {PLACED_VALUES}")
def sort_asc(t):
    return order.with_position(placed_values(t), *order.ascending("value", "event_id"))


@query(f"select event_id, value, row_number() over (order by value desc nulls last, event_id) as pos from {PLACED_VALUES}")
def sort_desc(t):
    return order.with_position(placed_values(t), *order.descending("value", "event_id"))


@query("""select event_id, event_type, value, row_number() over (order by event_type nulls last, value nulls last, event_id) as pos from events""")
def sort_rows(t):
    ordered = order.sort(t.events.select("event_id", "event_type", "value"), ["event_type", "value"], "event_id")
    return order.numbered(ordered)


@query("""select event_type as key, round_even(sum(value), 2) as value,
  row_number() over (order by round_even(sum(value), 2), event_type) as pos from events group by event_type""")
def sort_values(t):
    sums = agg.by(t.events, "event_type", agg.round_even(agg.total("value"), 2))
    return order.with_position(sums, *order.ascending("value", "key"))


@query("""select vec_id, unnest(s)::double as x, generate_subscripts(s, 1)::bigint as i
from (select vec_id, list_sort(embedding) as s from embeddings)""")
def array_sort(t):
    ordered = t.embeddings.select("vec_id", F.posexplode(nested.sort_items(F.col("embedding"))).alias("i", "x"))
    return ordered.select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), F.col("x").cast("double").alias("x"))


TOTALS = "(select o_custkey as key, count(*) as value, min(o_orderkey) as first_seen from orders group by o_custkey)"


def order_counts(t):
    return agg.by(t.orders, "o_custkey", agg.rows(), seq="o_orderkey")


@query(f"select key, value from {TOTALS} order by value desc, first_seen limit 5")
def top_pairs(t):
    return order.top(order_counts(t), 5, "value", "first_seen").select("key", "value")


@query(f"select key, value from {TOTALS} order by value, first_seen limit 5")
def bottom_pairs(t):
    return order.bottom(order_counts(t), 5, "value", "first_seen").select("key", "value")


@query("select value from events order by value desc limit 10")
def top_values(t):
    return order.top(t.events.select("value"), 10)


@query("select vec_id, round_even(list_sum(list_sort(embedding, 'DESC')[1:3]::double[]), 5) as top3 from embeddings")
def array_top(t):
    best = nested.top_items(F.col("embedding"), 3)
    return t.embeddings.select("vec_id", agg.round_even(nested.array_sum(best), 5).alias("top3"))


@query("select event_id, event_type from events order by event_id limit 3")
def first_n(t):
    return order.first(t.events.select("event_id", "event_type"), 3, "event_id")


@query("select event_id, event_type from events order by event_id limit (select count(*) // 2 from events)")
def first_half(t):
    half = t.events.count() // 2
    placed = order.with_position(t.events.select("event_id", "event_type"), "event_id")
    return placed.where(F.col("pos") <= half).drop("pos")


@query("select event_id, event_type from events order by event_id desc limit 3")
def last_n(t):
    return order.last(t.events.select("event_id", "event_type"), 3, "event_id")


@query("select event_id, row_number() over (order by event_id desc) as pos from events")
def rev_rows(t):
    return order.with_position(t.events.select("event_id"), F.col("event_id").desc())


@query("select p_partkey, reverse(p_name) as p_name from part")
def reverse_text(t):
    return t.part.select("p_partkey", nested.reversed_items(F.col("p_name")).alias("p_name"))


@query("""select o_custkey, row_number() over (order by min(o_orderkey)) as pos from orders group by o_custkey""")
def uniq_first_seen(t):
    seen = order.first_seen(t.orders, "o_custkey", "o_orderkey")
    return order.with_position(seen, "first_seen").select("o_custkey", "pos")


@query("select p_name, row_number() over (order by min(p_partkey)) as pos from part group by p_name")
def uniq_values(t):
    return order.numbered(order.uniq(t.part, "p_name", "p_partkey"))


@query("select vec_id, len(list_distinct(list_transform(embedding, lambda x: round_even(x::double, 1))))::bigint as n from embeddings")
def array_uniq(t):
    rounded = F.transform("embedding", lambda x: agg.round_even(x.cast("double"), 1) + F.lit(0.0))
    return t.embeddings.select("vec_id", nested.count_items(nested.uniq_items(rounded)).alias("n"))


@query("""with w as (select p_partkey, u.w, u.i from (select p_partkey, string_split(p_name, '') as ws from part), unnest(ws) with ordinality as u(w, i)),
c as (select p_partkey, w, count(*) as n, min(i) as first from w group by p_partkey, w)
select p_partkey, string_agg(w || n, '|' order by n desc, first) as counts from c group by p_partkey""")
def array_freq(t):
    pairs = nested.freq_items(F.split("p_name", ""))
    shown = nested.join_items(pairs, "|", lambda p: F.concat(p["key"], p["value"].cast("string")))
    return t.part.select("p_partkey", shown.alias("counts"))


@query("""select o_custkey as key, count(*) as value,
  row_number() over (order by count(*) desc, min(o_orderkey)) as pos from orders group by o_custkey""")
def freq(t):
    counted = order.counted(t.orders, "o_custkey", "o_orderkey")
    return order.with_position(counted, *order.descending("value", "first_seen")).select("key", "value", "pos")


@query("""select p_name as key, count(*) as value, row_number() over (order by count(*) desc, min(p_partkey)) as pos
from part group by p_name""")
def freq_table(t):
    return order.numbered(order.freq(t.part, "p_name", "p_partkey"))


@query("select event_id, value from events order by value desc, event_id limit 7")
def sort_head(t):
    return order.cut(t.events.select("event_id", "value"), order.descending("value", "event_id"), 7)


@query("""select doc_id, array_to_string(list_transform(list_sort(list_transform(w, lambda x, i: {'k': -length(x), 'i': i, 'w': x}))[1:3],
  lambda r: r.w), '|') as longest, array_to_string(w[1:2], '|') as head, array_to_string(w[-2:], '|') as tail
from (select doc_id, string_split(text, ' ') as w from documents)""")
def array_sort_by(t):
    w = F.col("w")
    longest = nested.sort_items(w, F.length, desc=True, n=3)
    return t.documents.select("doc_id", F.split("text", " ").alias("w")).select(
        "doc_id",
        F.array_join(longest, "|").alias("longest"),
        F.array_join(nested.first_items(w, 2), "|").alias("head"),
        F.array_join(nested.last_items(w, 2), "|").alias("tail"),
    )
