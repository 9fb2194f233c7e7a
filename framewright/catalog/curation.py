"""Duplicates, splits, leaks, audits and comparisons over tables of examples."""

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.functions import text
from framewright.operators import aggregate as agg
from framewright.operators import order
from framewright.plans import curation
from framewright.session import cut_lineage
from framewright.sources import sinks

BUCKET_SQL = """((('0x' || substr(md5({0}), 1, 16))::ubigint % 100 * 16 + ('0x' || substr(md5({0}), 17, 16))::ubigint % 100) % 100)::bigint"""
SPLIT_SQL = "case when {0} < 4 then 'test' when {0} < 8 then 'val' else 'train' end"


@query("select doc_id, lang from documents where doc_id in (select min(doc_id) from documents group by text)")
def cur_exact_dedup(t):
    return curation.keep_first(t.documents, F.col("text"), "doc_id").select("doc_id", "lang")


# every round keeps the rows that are first under both keys and drops the rows that share one with them
@query("""with recursive r as (
  select doc_id, text as a, source || ':' || (n_chars // 10) as b, 'open' as state from documents
  union all
  select doc_id, a, b, case when keep then 'kept' else 'open' end as state from (
    select *, bool_or(keep) over (partition by a) as hit_a, bool_or(keep) over (partition by b) as hit_b from (
      select doc_id, a, b, doc_id = min(doc_id) over (partition by a) and doc_id = min(doc_id) over (partition by b) as keep
      from r where state = 'open'))
  where keep or not (hit_a or hit_b))
select doc_id, lang from documents where doc_id in (select doc_id from r where state = 'kept')""")
def cur_two_key_dedup(t):
    second = F.concat("source", F.lit(":"), F.floor(F.col("n_chars") / 10).cast("string"))
    return curation.keep_first_in_turn(t.documents, F.col("text"), second, "doc_id").select("doc_id", "lang")


@query("""with one as (select min(doc_id) as doc_id from documents group by text)
select doc_id, lang from documents where doc_id in (select min(doc_id) from documents where doc_id in (select doc_id from one)
  group by source || ':' || (n_chars // 10))""")
def cur_two_key_batch(t):
    second = F.concat("source", F.lit(":"), F.floor(F.col("n_chars") / 10).cast("string"))
    return curation.keep_first_of_two(t.documents, F.col("text"), second, "doc_id").select("doc_id", "lang")


@query(f"select doc_id, bucket, {SPLIT_SQL.format('bucket')} as split from (select doc_id, {BUCKET_SQL.format('text')} as bucket from documents)")
def cur_hash_split(t):
    return curation.hash_split(t.documents, F.col("text")).select("doc_id", "bucket", "split")


def customer_answers(t, digits, shift):
    """One answer text per customer: the total of every order status on its own line."""
    wide = agg.pivot(
        t.orders, "o_custkey", "o_orderstatus", ["F", "O", "P"], lambda cell: agg.total(F.when(cell, F.col("o_totalprice")))
    )
    moved = wide.select("o_custkey", *[(F.col(c) + shift).alias(c) for c in ("F", "O", "P")])
    lines = "\n".join(f"{c}: {{{c}:.{digits}f}}" for c in ("F", "O", "P"))
    return sinks.fmt(moved, lines, alias="answer", keep=["o_custkey"])


def banned_answers(t):
    """The same answers a little off: within the tolerance for one segment, beyond it for another."""
    near = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    far = t.customer.where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("o_custkey"))
    return (
        customer_answers(t, 3, 0.004).join(near, "o_custkey", "left_semi")
        .unionByName(customer_answers(t, 2, 0.02).join(far, "o_custkey", "left_semi"))
        .select(F.concat(F.lit("\n"), F.regexp_replace("answer", "\n", "\n\n")).alias("answer"))
    )


LEAK_SQL = """
with s as (select o_custkey, coalesce(sum(o_totalprice) filter (where o_orderstatus = 'F'), 0) as f,
    coalesce(sum(o_totalprice) filter (where o_orderstatus = 'O'), 0) as o,
    coalesce(sum(o_totalprice) filter (where o_orderstatus = 'P'), 0) as p from orders group by o_custkey),
b as (select f + shift as f, o + shift as o, p + shift as p from s join customer on c_custkey = o_custkey
  join (values ('BUILDING', 0.004), ('MACHINERY', 0.02)) as m(segment, shift) on segment = c_mktsegment)
select o_custkey from s where {0} exists (select 1 from b where abs(s.f - b.f) < 0.01 and abs(s.o - b.o) < 0.01 and abs(s.p - b.p) < 0.01)"""


@query(LEAK_SQL.format("not"))
def cur_decontaminate(t):
    answers = cut_lineage(customer_answers(t, 2, 0.0))
    return curation.without_leaks(answers, "answer", banned_answers(t), "answer").select("o_custkey")


@query(LEAK_SQL.format(""))
def cur_leaks(t):
    answers = cut_lineage(customer_answers(t, 2, 0.0))
    return curation.without_leaks(answers, "answer", banned_answers(t), "answer", negate=False).select("o_custkey")


@query("""select item_id, item_id not in (select item_id from benchmark b where exists (select 1 from documents d where d.text = b.text)) as clean
from benchmark""")
def cur_leak_texts(t):
    marked = curation.mark_leaks(t.benchmark, "text", t.documents, "text", name="leaked")
    return marked.select("item_id", (~F.col("leaked")).alias("clean"))


@query("select event_id, event_type not in ('view', 'click') as same from events")
def cur_fuzzy_match(t):
    off = F.when(F.col("event_type") == "view", 0.02).when(F.col("event_type") == "error", 0.004).otherwise(0.0)
    name = F.when(F.col("event_type") == "click", "other").otherwise(F.col("event_type"))
    pairs = t.events.select(
        "event_id",
        F.concat("event_type", F.lit(": "), F.format_string("%.3f", "value"), F.lit(" of "), "user_id").alias("a"),
        F.concat(F.lit(" "), name, F.lit(": "), F.format_string("%.3f", F.col("value") + off), F.lit(" of "), "user_id").alias("b"),
    )
    return pairs.select("event_id", text.same_line(F.col("a"), F.col("b")).alias("same"))


@query("select doc_id, lang <> 'de' and lang <> 'es' as same from documents")
def cur_output_match(t):
    spaced = F.concat(F.lit("\n"), F.regexp_replace("text", "\n", "\n \n"), F.lit("\n"))
    longer = F.concat("text", F.lit("\nend"))
    changed = F.concat(F.lit("x"), F.col("text"))
    expected = F.when(F.col("lang") == "de", longer).when(F.col("lang") == "es", changed).otherwise(spaced)
    return t.documents.select("doc_id", text.same_output(F.col("text"), expected).alias("same"))


@query("""
with a as (select l_orderkey, l_linenumber, l_returnflag, count(*) as n from lineitem group by all),
b as (select l_orderkey, l_linenumber, case when l_quantity = 1 then 'X' else l_returnflag end as l_returnflag, count(*) as n
  from lineitem group by all)
select l_orderkey, l_linenumber, l_returnflag, coalesce(a.n, 0) as left_rows, coalesce(bn, 0) as right_rows
from a full join (select l_orderkey, l_linenumber, l_returnflag, sum(n)::bigint as bn from b group by all) using (l_orderkey, l_linenumber, l_returnflag)
where coalesce(a.n, 0) <> coalesce(bn, 0)""")
def cur_row_differences(t):
    a = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    flag = F.when(F.col("l_quantity") == 1, "X").otherwise(F.col("l_returnflag"))
    return curation.row_differences(a, t.lineitem.select("l_orderkey", "l_linenumber", flag.alias("l_returnflag")))


@query("""
with p as (select l_orderkey, l_linenumber, l_shipdate, l_extendedprice from lineitem),
c as (select l_orderkey, l_linenumber, l_shipdate, case when l_orderkey % 1000 = 7 then l_extendedprice + 1 else l_extendedprice end from p),
d as (select count(*) as n from (select * from p except all select * from c))
select 'sorted' as "case", true as equal union all select 'changed', n = 0 from d union all select 'doubled', count(*) = 0 from p""")
def cur_tables_alike(t):
    """Whole tables held against each other by hash sums: sorted otherwise, some prices changed, one row for each twice."""
    p = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    changed = p.withColumn("l_extendedprice", F.col("l_extendedprice") + F.when(F.col("l_orderkey") % 1000 == 7, 1).otherwise(0))
    cases = {"sorted": p.orderBy("l_shipdate"), "changed": changed, "doubled": p.unionByName(p)}
    found = [curation.equal_rows(other, p).select(F.lit(name).alias("case"), "equal") for name, other in cases.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""select sum((before > value)::int)::bigint as breaks from
  (select value, lag(value) over (order by event_id) as before from events)""")
def cur_order_breaks(t):
    placed = order.with_position(t.events.select("event_id", "value"), "event_id")
    return curation.order_breaks(placed, "value")


@query("""
with p as (select o_orderkey, o_totalprice from orders),
d as (select count(*) as n from (select * from p except all select o_orderkey, case when o_totalprice > 400000 then 0 else o_totalprice end from p)),
w as (select count(*) filter (where before > o_totalprice) as n from (select o_totalprice, lag(o_totalprice) over (order by o_orderkey) as before from p))
select 'sorted' as "case", true as ok, '' as note
union all select 'unsorted', n = 0, case when n > 0 then 'wrong order' else '' end from w
union all select 'changed', n = 0, case when n > 0 then 'different rows' else '' end from d
union all select 'renamed', false, 'header key,o_totalprice'""")
def cur_table_equal(t):
    want = t.orders.select("o_orderkey", "o_totalprice")
    by_price = order.with_position(want, *order.ascending("o_totalprice", "o_orderkey"))
    by_key = order.with_position(want, "o_orderkey")
    changed = by_price.withColumn("o_totalprice", F.when(F.col("o_totalprice") > 400_000, 0.0).otherwise(F.col("o_totalprice")))
    cases = {"sorted": by_price, "unsorted": by_key, "changed": changed, "renamed": by_price.withColumnRenamed("o_orderkey", "key")}
    checks = [
        curation.table_check(got, want, "o_totalprice").select(F.lit(name).alias("case"), "ok", "note")
        for name, got in cases.items()
    ]
    return checks[0].unionByName(checks[1]).unionByName(checks[2]).unionByName(checks[3])


DOC_SPLIT_SQL = f"(select *, {SPLIT_SQL.format(BUCKET_SQL.format('doc_id::varchar'))} as split from documents)"


def split_documents(t):
    return curation.hash_split(t.documents, F.col("doc_id").cast("string"))


@query(f"""select md5(text) as key, count(distinct split) as splits, count(*) as n from {DOC_SPLIT_SQL} group by text
having count(distinct split) > 1 or count(*) > 1""")
def cur_overlap_audit(t):
    return curation.overlap_audit(split_documents(t), F.col("text"), "split")


def _coverage_sql():
    patterns = {"number": "[0-9]", "article": "(^|\\s)the\\s", "address": "@\\w+\\."}
    parts = [
        f"""select split, count(*) as n, '{name}' as pattern, count(*) filter (where regexp_matches(text, '{p}')) as matched,
  count(*) filter (where regexp_matches(text, '{p}')) >= count(*) * 0.08 as enough from {DOC_SPLIT_SQL} group by split"""
        for name, p in patterns.items()
    ]
    return patterns, " union all ".join(parts)


PATTERNS, COVERAGE_SQL = _coverage_sql()


@query(COVERAGE_SQL)
def cur_coverage(t):
    return curation.coverage(split_documents(t), "text", PATTERNS, 0.08, "split")


@query(f"select split, count(*) as n, count(*) filter (where lang = 'es') as held_out_rows from {DOC_SPLIT_SQL} group by split")
def cur_held_out(t):
    return curation.held_out_audit(split_documents(t), "lang", "es", "split")


@query("""select 'o_orderstatus' as "column", count(*) filter (where o_orderstatus not in ('F', 'O', 'X')) as undeclared,
  3 - count(distinct o_orderstatus) filter (where o_orderstatus in ('F', 'O', 'X')) as not_found from orders
union all select 'o_orderpriority', count(*) filter (where o_orderpriority not in ('5-LOW', '1-URGENT')),
  2 - count(distinct o_orderpriority) filter (where o_orderpriority in ('5-LOW', '1-URGENT')) from orders""")
def cur_domain_check(t):
    return curation.domain_check(t.orders, {"o_orderstatus": ["F", "O", "X"], "o_orderpriority": ["5-LOW", "1-URGENT"]})


ANSWER_SQL = """case lang when 'en' then 'Here:' || chr(10) || '```sql' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
  when 'fr' then '```' || chr(10) || source || chr(10) || '``` or ```' || chr(10) || text || '```' else text end"""


@query(f"""select doc_id, trim(coalesce(nullif(regexp_extract(answer, '```[^\\n]*\\n(.*?)```', 1, 's'), ''), answer), ' ' || chr(9) || chr(10) || chr(13)) as code
from (select doc_id, {ANSWER_SQL} as answer from documents)""")
def cur_extract_code(t):
    fenced = F.concat(F.lit("Here:\n```sql\n"), "text", F.lit("\n```\nDone."))
    twice = F.concat(F.lit("```\n"), "source", F.lit("\n``` or ```\n"), "text", F.lit("```"))
    answer = F.when(F.col("lang") == "en", fenced).when(F.col("lang") == "fr", twice).otherwise(F.col("text"))
    return t.documents.select("doc_id", text.fenced_code(answer).alias("code"))


@query("""select u.conv_id, u.turn, 'Answer in the language of the question.' || chr(10) || chr(10) || '# Data' || chr(10) || chr(10) ||
  'Turn ' || u.turn || ' of ' || d.n || ' talks' || chr(10) || chr(10) || '# Task' || chr(10) || chr(10) ||
  trim(u.text, ' ' || chr(10)) || chr(10) || chr(10) || 'Answer only.' || chr(10) as prompt, a.text as completion
from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
join (select turn, count(*) as n from conversations group by turn) d on d.turn = u.turn
where u.role = 'user'""")
def cur_prompt_rows(t):
    talk = t.conversations
    asked = talk.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("task"))
    given = talk.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    counts = agg.by(talk, "turn", agg.rows())
    about = counts.select(F.col("key").alias("turn"), F.concat(F.lit("Turn "), "key", F.lit(" of "), "value", F.lit(" talks\n")).alias("description"))
    rows = curation.prompt_rows(
        asked.join(given, ["conv_id", "turn"]), about, "turn", "task", "answer",
        F.lit("Answer in the language of the question.\n"), "Answer only.",
    )
    return rows.select("conv_id", "turn", "prompt", "completion")
