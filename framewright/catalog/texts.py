"""Text, templates and conditionals."""

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.functions import text
from framewright.functions.formatting import items_template, value_text
from framewright.operators import elementwise
from framewright.plans.reports import classes
from framewright.sources import sinks


@query("select doc_id, lower(text) as text from documents")
def text_lower(t):
    return elementwise.lower(t.documents.select("doc_id", "text"), "text")


@query("select doc_id, upper(lang) as lang, upper(source) as source from documents")
def text_upper(t):
    return elementwise.upper(elementwise.upper(t.documents.select("doc_id", "lang", "source"), "lang"), "source")


@query("""select doc_id, unnest(string_split(text, '. ')) as part,
  generate_subscripts(string_split(text, '. '), 1)::bigint as i from documents""")
def text_split(t):
    parts = t.documents.select("doc_id", F.posexplode(text.split_on(F.col("text"), ". ")).alias("i", "part"))
    return parts.withColumn("i", (F.col("i") + 1).cast("bigint"))


@query("""select vec_id, array_to_string(list_transform(embedding, lambda x: regexp_replace(printf('%.6f', x::double), '\\.?0+$', '')), '; ') as line
from embeddings""")
def text_join(t):
    numbers = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    item = numbers.schema["e"].dataType.elementType
    return numbers.select("vec_id", F.array_join(F.transform("e", lambda x: value_text(x, item)), "; ").alias("line"))


@query("""select event_id, event_type || ': ' || regexp_replace(printf('%.6f', value), '\\.?0+$', '') || ' [' || printf('%.1f', value)
  || '] |' || printf('%8s', event_type) || '|' || printf('%-9s', event_type) || '| ' || printf('%05d', user_id) || ' '
  || format('{:,}', event_id * 1000) || ' ' || printf('%.1f', (value / 1000) * 100) || '%' as line from events""")
def fmt_template(t):
    frame = t.events.withColumn("big", F.col("event_id") * 1000).withColumn("part", F.col("value") / 1000)
    return sinks.fmt(
        frame, "{0}: {1} [{1:.1f}] |{0:>8}|{event_type:<9}| {user_id:05d} {big:,} {part:.1%}",
        fields=["event_type", "value"], keep=["event_id"],
    )


@query("select o_orderkey, printf('%.2f', o_totalprice * 0.125) as two, printf('%.0f', o_totalprice / 4) as zero from orders")
def fmt_decimals(t):
    frame = t.orders.withColumn("a", F.col("o_totalprice") * 0.125).withColumn("b", F.col("o_totalprice") / 4)
    both = sinks.fmt(frame, "{a:.2f}|{b:.0f}", keep=["o_orderkey"])
    parts = F.split("line", r"\|")
    return both.select("o_orderkey", parts[0].alias("two"), parts[1].alias("zero"))


@query("""select event_id, printf('%.3e', value / 7) as e, printf('%.4g', value * 1000) as g, printf('%+.1f', value - 50) as signed,
  replace(format('{:,}', event_id * 1000), ',', '_') as marked, printf('%+08.2f', value) as zeros from events""")
def fmt_kinds(t):
    frame = t.events.select(
        "event_id", (F.col("value") / 7).alias("a"), (F.col("value") * 1000).alias("b"), (F.col("value") - 50).alias("c"), (F.col("event_id") * 1000).alias("d"), "value"
    )
    done = sinks.fmt(frame, "{a:.3e}|{b:.4g}|{c:+.1f}|{d:_}|{value:+08.2f}", keep=["event_id"])
    parts = F.split("line", r"\|")
    return done.select("event_id", *(parts[i].alias(name) for i, name in enumerate(("e", "g", "signed", "marked", "zeros"))))


SIZES = [("ge", 300), ("ge", 100)]
SIZE_NAMES = ["large", "medium", "small"]
SIZE_SQL = "case when {0} >= 300 then 'large' when {0} >= 100 then 'medium' else 'small' end"


@query(f"select event_id, {SIZE_SQL.format('value')} as size from events")
def if_case(t):
    return t.events.select("event_id", classes(F.col("value"), SIZES, SIZE_NAMES).alias("size"))


@query(f"""select o_orderkey, {SIZE_SQL.format('(o_totalprice / 1000)')} as by_price,
  {SIZE_SQL.format('(o_custkey % 400)')} as by_customer from orders""")
def def_reuse(t):
    def size(c):
        return classes(c, SIZES, SIZE_NAMES)

    return t.orders.select(
        "o_orderkey", size(F.col("o_totalprice") / 1000).alias("by_price"), size(F.col("o_custkey") % 400).alias("by_customer")
    )


@query("select p_partkey, string_split(p_name, ' ')[2] || ', ' || printf('%-7s', string_split(p_name, ' ')[1]) || '.' as line from part")
def fmt_items(t):
    words = t.part.select("p_partkey", F.split("p_name", " ").alias("w"))
    return words.select("p_partkey", items_template("{1}, {0:<7}.", F.col("w"), words.schema["w"].dataType).alias("line"))
