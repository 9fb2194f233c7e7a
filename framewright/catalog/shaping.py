"""Projection, derived columns, key/value frames and maps."""

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.functions import nested
from framewright.operators import aggregate as agg
from framewright.operators import order, shape


@query("select o_orderdate::varchar as o_date, o_orderkey, o_custkey from orders")
def pick(t):
    frame = t.orders.withColumn("o_date", F.col("o_orderdate").cast("string"))
    return shape.pick(frame, "o_date,o_orderkey,o_custkey")


@query("select event_type from events")
def each_col(t):
    return shape.each(t.events, "event_type")


def line_records(t):
    """Per part: its name's words as records ``{word, size}``."""
    word = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("word"), F.length(w).alias("size")))
    return t.part.select("p_partkey", word.alias("records"))


RECORDS = "(select p_partkey, list_transform(string_split(p_name, ' '), lambda w: {'word': w, 'size': length(w)}) as records from part)"


@query(f"select p_partkey, array_to_string(list_transform(records, lambda r: r.word), '|') as words from {RECORDS}")
def each_nested(t):
    words = shape.each_nested(line_records(t), "records", "word")
    return words.select("p_partkey", F.array_join("records", "|").alias("words"))


@query(f"select p_partkey, array_to_string(list_transform(records, lambda r: r.word || ':' || (r.size * 2)), '|') as words from {RECORDS}")
def set_nested(t):
    twice = shape.set_nested(line_records(t), "records", "twice", lambda r: r["size"] * 2)
    kept = shape.pick_nested(twice, "records", "word,twice")
    shown = F.transform("records", lambda r: F.concat(r["word"], F.lit(":"), r["twice"].cast("string")))
    return kept.select("p_partkey", F.array_join(shown, "|").alias("words"))


@query("select p_partkey, string_split(p_name, ' ')[2] as second from part")
def get_field(t):
    split = t.part.select("p_partkey", F.split("p_name", " ").alias("words"))
    return shape.each(split, "words.1", keep=["p_partkey"], alias="second")


@query("select l_orderkey, l_linenumber, l_extendedprice * l_quantity as rev from lineitem")
def set_col(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    with_rev = shape.set_column(lines, "rev", F.col("l_extendedprice") * F.col("l_quantity"))
    return with_rev.select("l_orderkey", "l_linenumber", "rev")


@query("select event_id, value * 2 as value from events")
def map_col(t):
    return shape.map_values(t.events.select("event_id", "value"), lambda v: v * 2)


@query("""select vec_id, unnest(list_transform(embedding, lambda x: round_even(x::double * 10, 4))) as x,
  generate_subscripts(embedding, 1)::bigint as i from embeddings""")
def array_map(t):
    scaled = shape.map_array(t.embeddings, "embedding", lambda x: agg.round_even(x.cast("double") * 10, 4))
    return scaled.select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", (F.col("i") + 1).cast("bigint").alias("i"), "x"
    )


@query("select event_type as key, count(*) * 10 as value from events group by event_type")
def map_values(t):
    return shape.map_values(agg.by(t.events, "event_type", agg.rows()), lambda v: v * 10)


def props(t):
    """Event properties as a map, with one more entry made from the row."""
    parsed = F.map_concat(F.from_json("props", "map<string,bigint>"), F.create_map(F.lit("user"), F.col("user_id")))
    return t.events.select("event_id", parsed.alias("props"))


@query("""select event_id, 'k' as key, json_extract(props, '$.k')::bigint as value from events
union all select event_id, 'user', user_id from events""")
def map_pairs(t):
    return shape.pairs(props(t), "props")


@query("select event_id, 'k|user' as names from events")
def map_keys(t):
    return shape.keys(props(t), "props").select("event_id", F.array_join("props", "|").alias("names"))


@query("select event_id, json_extract(props, '$.k')::bigint || '|' || user_id as vals from events")
def map_vals(t):
    kept = shape.vals(props(t), "props")
    return kept.select("event_id", F.array_join("props", "|").alias("vals"))


@query("""select event_id, 'k' as key, json_extract(props, '$.k')::bigint + 1 as value from events
union all select event_id, 'user', user_id + 1 from events""")
def map_map(t):
    return shape.pairs(shape.map_map(props(t), "props", lambda v: v + 1), "props")


@query("""select event_type as key, row_number() over (order by min(event_id)) as pos from events group by event_type""")
def keys_first_seen(t):
    pairs = agg.by(t.events, "event_type", agg.rows(), seq="event_id")
    return order.with_position(pairs, "first_seen").select("key", "pos")


@query("select count(*) as value from orders group by o_custkey")
def vals_of_groups(t):
    return shape.vals(agg.by(t.orders, "o_custkey", agg.rows()))


@query("""select event_id, event_type, dense_rank() over (order by first_seen) as group_pos,
  row_number() over (partition by event_type order by event_id) as row_pos
from (select *, min(event_id) over (partition by event_type) as first_seen from events)""")
def group_rows(t):
    return shape.group_rows(t.events.select("event_id", "event_type"), "event_type", "event_id")


@query("""select event_id, substr(event_type, 1, 3) as head, substr(event_type, length(event_type) - 2) as tail,
  substr(event_type, 2, length(event_type) - 2) as middle from events""")
def slice_text(t):
    names = t.events.select("event_id", *[F.col("event_type").alias(n) for n in ("head", "tail", "middle")])
    names = shape.slice_column(names, "head", 0, 3)
    names = shape.slice_column(names, "tail", -3, None)
    return shape.slice_column(names, "middle", 1, -1)


@query("""select doc_id, right(text, 3) as tail, substr(text, 3) as rest, left(text, greatest(length(text) - 2, 0)) as front from documents""")
def slice_long_text(t):
    names = t.documents.select("doc_id", *[F.col("text").alias(n) for n in ("tail", "rest", "front")])
    names = shape.slice_column(names, "tail", -3, None)
    names = shape.slice_column(names, "rest", 2, None)
    return shape.slice_column(names, "front", None, -2)


@query("select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as talk from conversations group by conv_id")
def join_rows_of_group(t):
    said = t.conversations.select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return shape.join_rows(said, "conv_id", "line", "turn", "\n", name="talk")


@query("select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1:2]), '|') as heads from part")
def slice_array(t):
    words = t.part.select("p_partkey", F.split("p_name", " ").alias("heads"))
    cut = shape.slice_column(words, "heads", 0, 2)
    return cut.select("p_partkey", F.array_join("heads", "|").alias("heads"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def get_json_path(t):
    parsed = t.events.select("event_id", F.from_json("props", "k bigint").alias("props"))
    return parsed.select("event_id", nested.path("props.k").alias("k"))
