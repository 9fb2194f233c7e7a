"""Analytic queries."""

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.functions.numbers import round_even
from framewright.operators import aggregate as agg
from framewright.operators import order, select
from framewright.plans import reports
from framewright.session import cut_lineage, scratch_path
from framewright.sources import readers, sinks

REV_SQL = "l_extendedprice * (1 - l_discount)"
MONTH_SQL = "substr(l_shipdate::varchar, 1, 7)"
NUMBER_SQL = "regexp_replace(printf('%.6f', {0}), '\\.?0+$', '')"



def rev():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query(f"""select key || ': ' || {NUMBER_SQL.format('value')} as line from (
  select o_custkey as key, round_even(sum(o_totalprice), 2) as value, min(o_orderkey) as seen
  from orders where o_orderstatus = 'F' group by o_custkey order by value desc, seen limit 5)""")
def best_customers(t):
    done = select.where(t.orders, "o_orderstatus", "eq", "F")
    sums = agg.by(done, "o_custkey", round_even(agg.total("o_totalprice"), 2), seq="o_orderkey")
    return sinks.fmt(order.top(sums, 5, "value", "first_seen"), "{0}: {1}", fields=["key", "value"])


@query(f"""select l_linestatus as key, round_even(sum({REV_SQL}), 1) as value from lineitem
where l_returnflag = 'A' and l_quantity >= 10 group by l_linestatus""")
def q_grouped(t):
    wanted = (F.col("l_returnflag") == "A") & (F.col("l_quantity") >= 10)
    return reports.grouped(t.lineitem, "l_linestatus", round_even(agg.total(rev()), 1), wanted)


def _measure(name, measure, sql):
    @query(f"select l_suppkey as key, {sql} as value from lineitem group by l_suppkey", name=f"q_grouped_{name}")
    def run(t):
        return reports.grouped(t.lineitem, "l_suppkey", measure())


_measure("count", lambda: agg.rows(), "count(*)")
_measure("mean", lambda: round_even(F.avg("l_quantity"), 3), "round_even(avg(l_quantity), 3)")
_measure("max_product", lambda: round_even(F.max(rev()), 1), f"round_even(max({REV_SQL}), 1)")
_measure("distinct", lambda: F.count_distinct("l_partkey"), "count(distinct l_partkey)")


COUNTS_SQL = "(select o_custkey as key, count(*) as value, min(o_orderkey) as seen from orders group by o_custkey)"


def counts(t):
    return agg.by(t.orders, "o_custkey", agg.rows(), seq="o_orderkey")


def _shape(shape, sql, **options):
    @query(sql, name=f"q_shapes_{shape}")
    def run(t):
        return reports.shaped(counts(t), shape, **options).select("key", "value")


_shape("by_key", f"select key, value from {COUNTS_SQL}")
_shape("top", f"select key, value from {COUNTS_SQL} order by value desc, seen limit 4", n=4)
_shape("bottom", f"select key, value from {COUNTS_SQL} order by value, seen limit 4", n=4)
_shape("largest_first", f"select key, value from {COUNTS_SQL}")
_shape("threshold", f"select key, value from {COUNTS_SQL} where value >= 12", at_least=12)


@query(f"select round_even(avg({REV_SQL}), 3) as value from lineitem where l_returnflag = 'R' and l_discount > 0.02")
def q_scalar(t):
    wanted = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.02))
    return agg.summarise(wanted, value=round_even(F.avg(rev()), 3))


@query("select p_brand, row_number() over (order by p_brand) as pos from (select distinct p_brand from part where p_size >= 10)")
def q_distinct(t):
    brands = reports.distinct_values(t.part.where(F.col("p_size") >= 10), "p_brand")
    return order.with_position(brands, "p_brand")


EXPORT_SQL = """select strftime(o_orderdate, '%Y-%m-%d') as o_date, o_custkey, o_orderpriority from orders where o_orderstatus = 'P'"""


@query(EXPORT_SQL)
def q_export(t):
    dated = t.orders.withColumn("o_date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = reports.export(
        dated, F.col("o_orderstatus") == "P", ["o_date", "o_custkey", "o_orderpriority"], "o_date", "o_orderkey"
    )
    folder = scratch_path(t.spark)
    sinks.save_csv(rows, folder)
    return readers.csv(t.spark, folder, "o_date string, o_custkey bigint, o_orderpriority string")


@query("""select o_orderpriority as key, round_even(count(*) filter (where o_orderstatus = 'F') * 1.0 / count(*) * 100, 1) as value
from orders group by o_orderpriority""")
def q_share(t):
    return reports.share_in_group(t.orders, "o_orderpriority", F.col("o_orderstatus") == "F")


@query("""select l_returnflag as key, round_even(sum(l_quantity) / count(distinct l_orderkey), 2) as value
from lineitem group by l_returnflag""")
def q_ratio(t):
    return reports.ratio(t.lineitem, "l_returnflag", agg.total("l_quantity"), F.count_distinct("l_orderkey"))


@query("""select l_returnflag as key, round_even(sum(l_quantity) / (select sum(l_quantity) from lineitem) * 100, 1) as value
from lineitem group by l_returnflag""")
def q_total_share(t):
    return reports.share_of_total(t.lineitem, "l_returnflag", agg.total("l_quantity"))


CUTS, NAMES = [("ge", 50_000), ("ge", 20_000)], ["large", "medium", "small"]
CLASS_SQL = "case when {0} >= 50000 then 'large' when {0} >= 20000 then 'medium' else 'small' end"


@query(f"""select {CLASS_SQL.format('o_totalprice / 5')} as key, count(*) as value, min(o_orderkey) as first_seen
from orders where o_orderstatus = 'F' group by 1""")
def q_classify(t):
    done = t.orders.where(F.col("o_orderstatus") == "F")
    return reports.classify(done, F.col("o_totalprice") / 5, CUTS, NAMES, "o_orderkey")


@query("""select l_suppkey as key, case when avg(l_quantity) < 25 then 'low' when avg(l_quantity) < 26 then 'medium' else 'high' end as value
from lineitem group by l_suppkey""")
def q_label(t):
    cuts = [("lt", 25), ("lt", 26)]
    return reports.label_groups(t.lineitem, "l_suppkey", F.avg("l_quantity"), cuts, ["low", "medium", "high"])


@query("select p_brand as key, round_even(max(p_retailprice) * 1.15::double, 2) as value from part group by p_brand")
def q_scaled(t):
    return reports.scaled(t.part, "p_brand", F.max("p_retailprice"), 1.15)


@query(f"select {MONTH_SQL} as key, round_even(sum({REV_SQL}), 1) as value from lineitem group by 1")
def q_month_revenue(t):
    return reports.grouped(t.lineitem, reports.month_of(F.col("l_shipdate")), round_even(agg.total(rev()), 1))


@query(f"""select count(distinct value) < count(value) as tied from (select value from {COUNTS_SQL} order by value desc limit 6)""")
def q_has_ties(t):
    return reports.has_ties(counts(t), 5)


@query(f"""select coalesce(max(n) > 1, false) as tied from (select value, count(*) as n from
  (select o_custkey, sum(o_totalprice) as value from orders group by 1) group by value)""")
def q_has_ties_anywhere(t):
    return reports.has_ties(agg.by(t.orders, "o_custkey", agg.total("o_totalprice")))


@query("""with v as (select distinct p_name as v from part),
f as (select distinct v, substr(v, i, n) as fragment from v, (select unnest([1, 2, 3]) as n),
  lateral (select unnest(range(1, length(v) - n + 2)) as i))
select fragment, count(*) as n from f
where regexp_matches(fragment, '^\\pL+$') and (length(fragment) > 1 or contains('eiukcdflmhjwzv', fragment))
  and fragment not in ('as', 'or', 'old')
group by fragment having count(*) <= greatest(1, floor((select count(*) from v) * 0.85))""")
def q_fragments(t):
    return reports.fragments(t.part, "p_name", ["as", "or", "old"])


@query("""with done as (select *, substr(o_orderdate::varchar, 1, 7) as month from orders where o_orderstatus = 'F')
select 'completed' as section, '' as key, count(*)::double as value from done
union all select 'revenue', '', round_even(sum(o_totalprice), 2) from done
union all select 'average', '', round_even(avg(o_totalprice), 2) from done
union all select 'returned_share', '', round_even(count(*) filter (where o_orderstatus = 'P') * 1.0 / count(*) * 100, 1) from orders
union all select 'by_group', o_orderpriority, round_even(sum(o_totalprice), 2) from done group by o_orderpriority
union all select 'by_month', month, round_even(sum(o_totalprice), 2) from done group by month
union all (select 'by_customer', o_custkey::varchar, round_even(sum(o_totalprice), 2) as v from done group by o_custkey
  order by v desc, o_custkey::varchar limit 3)""")
def q_sales_report(t):
    status = F.col("o_orderstatus")
    return reports.sales_report(
        t.orders, status == "F", status == "P", F.col("o_totalprice"), "o_orderpriority", "o_custkey", "o_orderdate"
    )


WORDS_SQL = """(select doc_id * 16777216 + i as seq, word from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i
  from (select doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_'']+') as w from documents)) where word <> 'the')"""


def lower_words(t):
    """Lower-case words but ``the``, numbered in reading order."""
    words = readers.words(t.documents, F.lower("text"), "doc_id").where(F.col("word") != "the")
    return words.select(readers.reading_order("doc_id", "word_no").alias("seq"), "word")


@query(f"""select word || ' (' || n || 'x)' as line
from (select word, count(*) as n, min(seq) as seen from {WORDS_SQL} group by word order by n desc, seen limit 3)""")
def q_word_freq(t):
    best = order.top(order.counted(lower_words(t), "word", "seq"), 3, "value", "first_seen")
    return sinks.fmt(best, "{0} ({1}x)", fields=["key", "value"])


@query(f"""select word as key, count(*) as value, row_number() over (order by count(*) desc, min(seq)) as pos
from {WORDS_SQL} group by word""")
def q_word_ranking(t):
    counted = order.counted(lower_words(t), "word", "seq")
    return order.with_position(counted, *order.descending("value", "first_seen")).select("key", "value", "pos")


@query("""select sum(l_quantity) as value from lineitem join part on l_partkey = p_partkey
where p_type in ('PROMO', 'LARGE') and contains(p_name, 'e') and l_returnflag = 'R'""")
def q_in_and_has(t):
    parts = select.where(select.where(t.part, "p_type", "in", "PROMO,LARGE"), "p_name", "has", "e")
    returned = select.where(t.lineitem, "l_returnflag", "eq", "R")
    return agg.summarise(select.where_in_table(returned, "l_partkey", parts, "p_partkey"), value=agg.total("l_quantity"))


CUT_SQL = """case when abs({0}) >= 300 then round_even({0} / 10, 0) * 10 when abs({0}) >= 10 or {0} = round_even({0}, 0)
  then round_even({0}, 0) else round_even({0}, 1) end"""


@query(f"""select {CUT_SQL.format('a')} as low, {CUT_SQL.format('b')} as high from (
  select quantile_cont(l_extendedprice, 0.3) as a, quantile_cont(l_extendedprice, 0.75) as b from lineitem)""")
def class_cuts(t):
    return reports.class_cuts(t.lineitem, "l_extendedprice", {"low": 0.3, "high": 0.75})


@query(f"""with c as (select {CUT_SQL.format('a')} as low, {CUT_SQL.format('b')} as high from (
  select quantile_cont(value, 0.3) as a, quantile_cont(value, 0.75) as b from events))
select case when value >= high then 'high' when value >= low then 'medium' else 'low' end as key, count(*) as value,
  min(event_id) as first_seen from events, c group by 1""")
def q_classify_by_quantile(t):
    cuts = cut_lineage(reports.class_cuts(t.events, "value", {"low": 0.3, "high": 0.75}))
    limits = [("ge", cuts.select("high").scalar()), ("ge", cuts.select("low").scalar())]
    return reports.classify(t.events, F.col("value"), limits, ["high", "medium", "low"], "event_id")
