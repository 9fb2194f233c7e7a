"""Arithmetic and comparison on columns, arrays and whole tables."""

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.functions.numbers import round_even
from framewright.operators import elementwise


def _math(name, column, op, n, sql, digits=None):
    shown = sql if digits is None else f"round_even({sql}, {digits})"

    @query(f"select event_id, {shown} as result from events", name=name)
    def run(t):
        done = elementwise.math(t.events.select("event_id", column), column, op, n, "result")
        if digits is not None:
            done = done.withColumn("result", round_even(F.col("result"), digits))
        return done.select("event_id", "result")


_math("math_add", "value", "add", 2.5, "value + 2.5::double")
_math("math_sub", "value", "sub", 0.25, "value - 0.25::double")
_math("math_mul", "value", "mul", 3, "value * 3")
_math("math_div", "user_id", "div", 7, "user_id / 7")
_math("math_div_zero", "user_id", "div", 0, "case when user_id is null then 0.0::double end")
_math("math_mod", "user_id", "mod", -7, "user_id - (-7) * floor(user_id / -7.0)::bigint")
_math("math_mod_float", "value", "mod", 2.5, "value - 2.5::double * floor(value / 2.5::double)", 6)
_math("math_pow", "user_id", "pow", 3, "user_id * user_id * user_id")
_math("math_pow_float", "value", "pow", 0.5, "pow(value, 0.5)", 9)
_math("math_add_text", "event_type", "add", "!", "event_type || '!'")
_math("math_mul_text", "event_type", "mul", 2, "repeat(event_type, 2)")


# up to 7^20 = 79792266297612001, where doubles fail
@query("select event_id, " + " * ".join(["(user_id % 8)::bigint"] * 20) + " as result from events")
def math_pow_large(t):
    small = t.events.select("event_id", (F.col("user_id") % 8).alias("k"))
    return elementwise.math(small, "k", "pow", 20, "result").select("event_id", "result")


# exponents of their own for all rows; up to 3^39 = 4052555153018976267, far above 2^53
@query("""with e as (select event_id, case when user_id % 3 = 2 then -1 else 1 end * (2 + user_id % 2) as b, event_id % 40 as n from events)
select event_id, b as base, n, list_reduce(list_transform(range(0, n), lambda _ : b::bigint), lambda x, y : x * y, 1::bigint) as result from e""")
def math_pow_columns(t):
    bases = t.events.select(
        "event_id", (F.when(F.col("user_id") % 3 == 2, -1).otherwise(1) * (2 + F.col("user_id") % 2)).alias("base"), (F.col("event_id") % 40).alias("n")
    )
    return elementwise.math(bases, "base", "pow", F.col("n"), "result")


@query("""select event_id, value = 12.31::double as eq, value <> 12.31::double as ne, value > 12.31::double as gt,
  value >= 12.31::double as ge, value < 12.31::double as lt, value <= 12.31::double as le, event_type = 'view' as is_view,
  false as mixed_eq, true as mixed_ne from events""")
def cmp_flags(t):
    flags = t.events.select("event_id", "value", "event_type")
    for op in ("eq", "ne", "gt", "ge", "lt", "le"):
        flags = elementwise.math(flags, "value", op, 12.31, op)
    flags = elementwise.math(flags, "event_type", "eq", "view", "is_view")
    flags = elementwise.math(flags, "value", "eq", "text", "mixed_eq")
    flags = elementwise.math(flags, "value", "ne", "text", "mixed_ne")
    return flags.drop("value", "event_type")


@query("""select vec_id, unnest(list_transform(embedding, lambda x: x::double * 4 + 1)) as x,
  generate_subscripts(embedding, 1)::bigint as i from embeddings""")
def array_math(t):
    wide = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    done = elementwise.math(elementwise.math(wide, "embedding", "mul", 4), "embedding", "add", 1)
    return done.select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", (F.col("i") + 1).cast("bigint").alias("i"), "x"
    )


@query("select o_orderkey + 1 as o_orderkey, o_custkey + 1 as o_custkey, o_orderstatus, o_totalprice + 1 as o_totalprice from orders")
def math_all_columns(t):
    return elementwise.math_all_columns(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "add", 1)


@query("""select l_orderkey, l_linenumber, round_even(l_extendedprice, 1) as l_extendedprice, round_even(l_discount, 1) as l_discount,
  round_even(l_tax, 1) as l_tax from lineitem""")
def round_all_columns(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return elementwise.round_all_columns(lines, 1)


@query("""select vec_id, unnest(list_transform(embedding, lambda x: printf('%.2f', x::double)::double)) as x,
  generate_subscripts(embedding, 1)::bigint as i from embeddings""")
def array_round(t):
    wide = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    done = elementwise.round_column(wide, "embedding", 2)
    return done.select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", (F.col("i") + 1).cast("bigint").alias("i"), "x"
    )
