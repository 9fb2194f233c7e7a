"""Readers, generators, writers and report lines."""

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.functions.text import slice_text
from framewright.operators import aggregate as agg
from framewright.operators import shape
from framewright.session import scratch_path
from framewright.sources import readers, sinks

ORDER_ROWS = """
select o_orderkey, nullif(o_orderstatus, 'P') as o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') as o_date
from orders"""


def order_rows(t):
    return t.orders.select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        "o_totalprice",
        slice_text(F.col("o_orderdate").cast("string"), 0, 10).alias("o_date"),
    )


@query(ORDER_ROWS)
def src_csv(t):
    folder = scratch_path(t.spark)
    sinks.save_csv(order_rows(t).na.fill("NA", ["o_orderstatus"]), folder)
    return readers.csv(t.spark, folder)


@query(ORDER_ROWS)
def src_csv_declared(t):
    folder = scratch_path(t.spark)
    sinks.save_csv(order_rows(t).na.fill("n/a", ["o_orderstatus"]), folder)
    return readers.csv(t.spark, folder, "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_date string")


@query("select o_orderkey + 1000000000000000000 as id, o_custkey - 1000000000000000000 as other from orders")
def src_csv_large_ids(t):
    folder = scratch_path(t.spark)
    large = F.lit(1_000_000_000_000_000_000)
    sinks.save_csv(t.orders.select((F.col("o_orderkey") + large).alias("id"), (F.col("o_custkey") - large).alias("other")), folder)
    return readers.csv(t.spark, folder)


@query("""select doc_id, '  ' || replace(text, 'e', '"') || chr(10) || ' end ' as text from documents""")
def sink_csv_texts(t):
    folder = scratch_path(t.spark)
    framed = F.concat(F.lit("  "), F.regexp_replace("text", "e", '"'), F.lit("\n end "))
    kept = sinks.save_csv(t.documents.select("doc_id", framed.alias("text")), folder)
    return readers.csv(t.spark, folder, kept.schema, multi_line=True)


@query(ORDER_ROWS)
def sink_csv_roundtrip(t):
    folder = scratch_path(t.spark)
    kept = sinks.save_csv(order_rows(t), folder)
    return readers.csv(t.spark, folder, kept.schema)


@query("select role, sum(length(text) + 1)::bigint as chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::bigint as n_lines from conversations group by role")
def src_read_text(t):
    folder = scratch_path(t.spark)
    t.conversations.select("role", "text").write.partitionBy("role").text(folder)
    files = readers.read_text(t.spark, folder)
    role = F.regexp_extract("path", r"role=([^/]+)/", 1)
    counted = files.select(
        role.alias("role"), F.length("value").alias("chars"), F.size(readers.texts.lines(F.col("value"))).alias("n_lines")
    )
    return counted.groupBy("role").agg(F.sum("chars").alias("chars"), F.sum("n_lines").alias("n_lines"))


@query("select c_custkey, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer")
def src_json(t):
    folder = scratch_path(t.spark)
    record = F.struct("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # a file holds one list; 100,000 records at most go into one
    batch = F.floor(F.col("c_custkey") / 100_000)
    lists = t.customer.groupBy(batch.alias("batch")).agg(F.to_json(F.collect_list(record)).alias("value"))
    lists.write.partitionBy("batch").text(folder)
    return readers.json_files(
        t.spark, f"{folder}/batch=*", "c_custkey bigint, c_nationkey bigint, c_acctbal double, c_mktsegment string"
    )


@query("select doc_id, quality, toxic from labels")
def src_jsonl(t):
    folders = [scratch_path(t.spark), scratch_path(t.spark)]
    for toxic, folder in enumerate(folders):
        t.labels.where(F.col("toxic") == toxic).write.json(folder)
    return readers.json_lines(t.spark, folders, "doc_id bigint, quality int, toxic int")


@query("select p_partkey, unnest(generate_series(1, p_size))::bigint as value from part")
def gen_upto(t):
    return t.part.select("p_partkey", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("p_size").cast("bigint"))).alias("value"))


@query("select n as value, (n % 7 = 0) as seventh from (select unnest(generate_series(1, (select count(*) from part))) as n)")
def gen_upto_table(t):
    # 1 to the number of rows of a table
    return readers.upto(t.spark, t.part.count()).withColumn("seventh", F.col("value") % 7 == 0)


@query("""select event_id, case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 else 0 end::bigint as place
from events""")
def gen_list(t):
    wanted = readers.literal_list("view,click,purchase")
    return t.events.select("event_id", F.array_position(wanted, F.col("event_type")).alias("place"))


@query("""select doc_id, line_no::bigint as line_no, line from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no
  from documents)""")
def text_lines(t):
    return readers.lines(t.documents, "text", "doc_id").withColumn("line_no", F.col("line_no").cast("bigint"))


@query("""select doc_id, word_no::bigint as word_no, word from (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as word_no
  from (select doc_id, regexp_extract_all(text, '[\\pL\\pN_'']+') as w from documents))""")
def text_words(t):
    return readers.words(t.documents, "text", "doc_id").withColumn("word_no", F.col("word_no").cast("bigint"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def json_parse(t):
    parsed = readers.parse_json(t.events, "props", "k bigint")
    return shape.each(parsed, "props.k", keep=["event_id"], alias="k")


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def json_parse_any(t):
    parsed = readers.parse_json_any(t.events, "props")
    return parsed.select("event_id", F.variant_get("props", "$.k", "bigint").alias("k"))


@query("select c_nationkey::bigint as nation, count(*) as n, sum(c_custkey)::bigint as total from customer group by c_nationkey")
def src_json_values(t):
    folder = scratch_path(t.spark)
    # a file holds the customer numbers of one nation, 100,000 at most
    part = F.floor(F.col("c_custkey") / 100_000).alias("part")
    lists = t.customer.groupBy(F.col("c_nationkey").alias("nation"), part).agg(F.to_json(F.collect_list("c_custkey")).alias("value"))
    lists.write.partitionBy("nation", "part").text(folder)
    values = readers.json_values(t.spark, f"{folder}/nation=*/part=*")
    nation = F.regexp_extract("path", r"nation=(\d+)/", 1).cast("bigint").alias("nation")
    return values.groupBy(nation).agg(F.count("value").alias("n"), F.sum("value").alias("total"))


KEY_VALUES = """
select o_custkey || '{sep}' || regexp_replace(printf('%.6f', round_even(sum(o_totalprice), 2)), '\\.?0+$', '') as line
from orders group by o_custkey"""


def customer_totals(t):
    return shape.map_values(agg.by(t.orders, "o_custkey", agg.total("o_totalprice")), lambda v: agg.round_even(v, 2))


@query(KEY_VALUES.format(sep=","))
def sink_kv_lines(t):
    folder = scratch_path(t.spark)
    sinks.save_key_values(customer_totals(t), folder)
    return readers.read_lines(t.spark, folder).select(F.col("value").alias("line"))


@query(KEY_VALUES.format(sep=": "))
def report_kv_lines(t):
    return sinks.key_value_lines(customer_totals(t))


LIST_LINES = """
select event_type || ' ' || regexp_replace(printf('%.6f', value), '\\.?0+$', '') || ' ' || user_id as line from events"""


@query(LIST_LINES)
def sink_lines(t):
    folder = scratch_path(t.spark)
    sinks.save_lines(t.events.select("event_type", "value", "user_id"), folder)
    return readers.read_lines(t.spark, folder).select(F.col("value").alias("line"))


@query(LIST_LINES)
def report_list_lines(t):
    return sinks.value_lines(t.events.select("event_type", "value", "user_id"))


@query("""select event_id, regexp_replace(printf('%.6f', value / 7), '\\.?0+$', '') as shown,
  regexp_replace(printf('%.6f', value * 1000), '\\.?0+$', '') as large from events""")
def fmt_value(t):
    wide = t.events.select("event_id", (F.col("value") / 7).alias("shown"), (F.col("value") * 1000).alias("large"))
    return wide.select("event_id", *[sinks.value_text(F.col(f.name), f.dataType).alias(f.name) for f in wide.schema.fields[1:]])


TABLE_LINES = """
with cells as (
  select o_orderkey as pos, o_orderkey::varchar as a, o_orderstatus as b, printf('%.2f', o_totalprice) as c, o_custkey::varchar as d from orders
), w as (
  select greatest(max(length(a)), 11) as a, greatest(max(length(b)), 13) as b, greatest(max(length(c)), 13) as c, greatest(max(length(d)), 10) as d from cells
)
select 0::bigint as "at", lpad('o_orderkey', w.a::int, ' ') || ' ' || lpad('o_orderstatus', w.b::int, ' ') || ' ' || lpad('o_totalprice', w.c::int, ' ') || ' ' || lpad('o_custkey', w.d::int, ' ') as line from w
union all
select pos, lpad(cells.a, w.a::int, ' ') || ' ' || lpad(cells.b, w.b::int, ' ') || ' ' || lpad(cells.c, w.c::int, ' ') || ' ' || lpad(cells.d, w.d::int, ' ') from cells, w
"""


@query(TABLE_LINES)
def report_table_lines(t):
    """All orders as an aligned table, in the order of their keys."""
    return sinks.table_lines(t.orders.select(F.col("o_orderkey").alias("at"), "o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey"), "at")


@query("select 'saved' as how, printf('%.1f', round_even(sum(o_totalprice), 1)) as text, 1::bigint as parts from orders")
def sink_scalar(t):
    """One total, saved without a line end and read back whole: its text and the number of files that hold it."""
    folder = scratch_path(t.spark)
    sinks.save_scalar(t.orders.agg(F.format_string("%.1f", agg.round_even(F.sum("o_totalprice"), 1)).alias("v")), folder)
    files = readers.read_text(t.spark, folder).where("length(value) > 0")
    return files.agg(F.lit("saved").alias("how"), F.max("value").alias("text"), F.count(F.lit(1)).alias("parts"))
