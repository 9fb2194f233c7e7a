"""Filters and predicates."""

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.functions import nested
from framewright.operators import aggregate as agg
from framewright.operators import select

WITH_NULLS = "(select event_id, nullif(event_type, 'error') as event_type, value, user_id from events)"


def events_with_nulls(t):
    return t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("event_type"), "value", "user_id")


@query("select event_id, event_type from events where event_type = 'view'")
def where_eq(t):
    return select.where(t.events, "event_type", "eq", "view").select("event_id", "event_type")


@query(f"select event_id, event_type from {WITH_NULLS} where event_type is distinct from 'view'")
def where_ne(t):
    return select.where(events_with_nulls(t), "event_type", "ne", "view").select("event_id", "event_type")


def _ordering(op, sign):
    @query(f"select o_orderkey, o_totalprice from orders where o_totalprice {sign} 112946.26", name=f"where_{op}")
    def run(t):
        return select.where(t.orders, "o_totalprice", op, 112946.26).select("o_orderkey", "o_totalprice")


for _op, _sign in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _ordering(_op, _sign)


@query("select event_id, event_type from events where event_type in ('view', 'click')")
def where_in(t):
    return select.where(t.events, "event_type", "in", "view,click").select("event_id", "event_type")


@query(f"select event_id, event_type from {WITH_NULLS} where event_type not in ('view', 'click') or event_type is null")
def where_nin(t):
    return select.where(events_with_nulls(t), "event_type", "nin", "view,click").select("event_id", "event_type")


@query("select p_partkey, p_size from part where p_size in (1, 7, 49)")
def where_in_numbers(t):
    return select.where(t.part, "p_size", "in", "1,7,49,x").select("p_partkey", "p_size")


@query("select doc_id from documents where doc_id in (select doc_id from labels where toxic = 1)")
def where_in_table(t):
    toxic = select.where(t.labels, "toxic", "eq", 1)
    return select.where_in_table(t.documents.select("doc_id"), "doc_id", toxic)


def _mixed_orders(t, kind):
    """Keys of returned items as another number type than the orders have."""
    picked = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").cast(kind).alias("key"))
    return t.orders.select(F.col("o_orderkey").cast("int").alias("o_orderkey")), picked


RETURNED = "(select l_orderkey from lineitem where l_returnflag = 'R')"


@query(f"""select kind, o_orderkey from orders, (values ('bigint'), ('double'), ('decimal(12,2)')) as k(kind) where o_orderkey in {RETURNED}""")
def where_in_table_mixed(t):
    parts = []
    for kind in ("bigint", "double", "decimal(12,2)"):
        orders, picked = _mixed_orders(t, kind)
        found = select.where_in_table(orders, "o_orderkey", picked, "key")
        parts.append(found.select(F.lit(kind).alias("kind"), F.col("o_orderkey").cast("bigint").alias("o_orderkey")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""select kind, o_orderkey from orders, (values ('bigint'), ('double')) as k(kind) where o_orderkey not in {RETURNED}""")
def where_nin_table_mixed(t):
    parts = []
    for kind in ("bigint", "double"):
        orders, picked = _mixed_orders(t, kind)
        found = select.where_in_table(orders, "o_orderkey", picked, "key", negate=True)
        parts.append(found.select(F.lit(kind).alias("kind"), F.col("o_orderkey").cast("bigint").alias("o_orderkey")))
    return parts[0].unionByName(parts[1])


@query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def where_nin_table(t):
    toxic = select.where(t.labels, "toxic", "eq", 1)
    return select.where_in_table(t.documents.select("doc_id"), "doc_id", toxic, negate=True)


@query("select p_partkey, p_name from part where contains(p_name, 'ring')")
def where_has(t):
    return select.where(t.part, "p_name", "has", "ring").select("p_partkey", "p_name")


@query("select event_id, value from events where contains(value::varchar, '.5')")
def where_has_number(t):
    return select.where(t.events, "value", "has", ".5").select("event_id", "value")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > (select max(o_totalprice) * 0.9 from orders)")
def where_scalar_var(t):
    limit = t.orders.agg((F.max("o_totalprice") * 0.9).alias("v")).scalar()
    return select.where(t.orders, "o_totalprice", "gt", limit).select("o_orderkey", "o_totalprice")


@query("select event_id, json_extract(props, '$.k')::bigint as k from events where json_extract(props, '$.k')::bigint >= 50")
def where_nested(t):
    parsed = t.events.select("event_id", F.from_json("props", "k bigint").alias("props"))
    return select.where(parsed, "props.k", "ge", 50).select("event_id", F.col("props.k").alias("k"))


@query("select event_type as key, count(*) as value from events group by event_type having count(*) >= 2000")
def where_list(t):
    pairs = agg.by(t.events, "event_type", agg.rows())
    return select.where(pairs, 1, "ge", 2000)


@query("select event_id from events where value > user_id")
def filter_expr(t):
    return select.filter_rows(t.events, F.col("value") > F.col("user_id")).select("event_id")


@query("select o_custkey as key, count(*) as value from orders group by o_custkey having count(*) >= 12")
def having(t):
    return select.filter_rows(agg.by(t.orders, "o_custkey", agg.rows()), F.col("value") >= 12)


@query("""select vec_id, unnest(kept)::double as x, generate_subscripts(kept, 1)::bigint as i
from (select vec_id, list_filter(embedding, lambda x: x > 0.2) as kept from embeddings)""")
def array_filter(t):
    kept = select.filter_array(t.embeddings, "embedding", lambda x: x > F.lit(0.2).cast("float"))
    return kept.select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", (F.col("i") + 1).cast("bigint").alias("i"), F.col("x").cast("double").alias("x")
    )


@query(f"select event_id, event_type, value from {WITH_NULLS} where event_type is not null and nullif(value, 12.31) is not null")
def drop_null(t):
    frame = events_with_nulls(t).select("event_id", "event_type", F.nullif("value", F.lit(12.31)).alias("value"))
    return select.drop_null(frame)


@query(f"select event_id, event_type from {WITH_NULLS} where event_type is distinct from 'view'")
def drop_value(t):
    return select.drop_value(events_with_nulls(t), "event_type", "view").select("event_id", "event_type")


@query("select o_orderkey, nullif(o_orderstatus, 'F') as o_orderstatus, o_orderpriority from orders")
def mask_value(t):
    return select.mask_value(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "F")


@query("""select doc_id, len(list_filter(string_split(text, ' '), lambda w: w <> 'the'))::bigint as kept from documents""")
def array_drop(t):
    words = t.documents.select("doc_id", F.split("text", " ").alias("w"))
    return words.select("doc_id", F.size(nested.drop_item(F.col("w"), "the")).cast("bigint").alias("kept"))


@query("""select p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 5), '|') as long_words,
  array_to_string(list_filter(string_split(p_name, ' '), lambda w: contains(w, 'e')), '|') as e_words from part""")
def where_items(t):
    record = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("word"), F.length(w).alias("size")))
    frame = t.part.select("p_partkey", record.alias("long"), F.split("p_name", " ").alias("e"))
    kept = select.where_items(select.where_items(frame, "long", "size", "ge", 5), "e", "it", "has", "e")
    return kept.select(
        "p_partkey", F.array_join("long.word", "|").alias("long_words"), F.array_join("e", "|").alias("e_words")
    )
