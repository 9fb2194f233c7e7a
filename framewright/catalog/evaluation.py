"""Evaluation roll-ups; labelled documents stand for evaluation rows.

The language is the question set, the source the run, ``quality`` whether the answer was right,
``n_chars`` its size, and ``toxic`` marks the questions that are left out.
"""

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.functions.numbers import round_even
from framewright.plans import evaluation

RESULTS_SQL = "(select d.doc_id, lang, source, n_chars, text, quality = 1 as ok, toxic from documents d join labels l on d.doc_id = l.doc_id)"


def score_sql(ok, among):
    return f"""case when count(*) filter (where {among}) = 0 then '' else count(*) filter (where {ok} and {among}) || '/' ||
  count(*) filter (where {among}) || ' (' ||
  printf('%.0f', 100.0 * count(*) filter (where {ok} and {among}) / count(*) filter (where {among})) || '%)' end"""


def results(t):
    labels = t.labels.select("doc_id", (F.col("quality") == 1).alias("ok"), "toxic")
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id")


def flagged(t):
    return t.labels.where(F.col("toxic") == 1).select("doc_id")


def right():
    return F.col("ok")


def size():
    return F.col("n_chars")


@query(f"""select lang, count(*) filter (where ok) as ok, count(*) as total, {score_sql('ok', 'true')} as score,
  round_even(avg(n_chars), 3) as mean_size, round_even(sum(n_chars) / nullif(count(*) filter (where ok), 0), 3) as size_per_correct
from {RESULTS_SQL} group by lang""")
def ev_rollup(t):
    scores = evaluation.rollup(results(t), "lang", right(), size())
    for name in ("mean_size", "size_per_correct"):
        scores = scores.withColumn(name, round_even(F.col(name), 3))
    return scores


SETS = ["en", "fr", "xx"]


@query(f"""select source, {score_sql('ok', "lang = 'en'")} as en, {score_sql('ok', "lang = 'fr'")} as fr,
  {score_sql('ok', "lang = 'xx'")} as xx from {RESULTS_SQL} group by source""")
def ev_pivot(t):
    return evaluation.pivoted_scores(results(t), "source", "lang", SETS, right())


@query(f"""select source, {score_sql('ok', "lang = 'en'")} as en, {score_sql('ok', "lang = 'fr'")} as fr,
  {score_sql('ok', "lang = 'xx'")} as xx,
  format('{{:,}}', round_even(case when count(*) filter (where lang = 'de') > 0 then avg(n_chars) filter (where lang = 'de') else avg(n_chars) end, 0)::bigint) as mean_size,
  coalesce(format('{{:,}}', round_even(case when count(*) filter (where lang = 'de') > 0
    then sum(n_chars) filter (where lang = 'de') / nullif(count(*) filter (where lang = 'de' and ok), 0)
    else sum(n_chars) / nullif(count(*) filter (where ok), 0) end, 0)::bigint), 'none correct') as size_per_correct
from {RESULTS_SQL} group by source""")
def ev_comparison(t):
    return evaluation.comparison(results(t), "source", "lang", SETS, "de", right(), size())


@query(f"select doc_id, lang, ok from {RESULTS_SQL} where toxic = 0")
def ev_fair(t):
    return evaluation.fair(results(t), flagged(t), "doc_id").select("doc_id", "lang", "ok")


@query(f"""select {score_sql('ok', "not contains(text, chr(10))")} as without_label, {score_sql('ok', "contains(text, chr(10))")} as with_label
from {RESULTS_SQL} where toxic = 0""")
def ev_label_split(t):
    labelled = t.documents.where(F.col("text").contains("\n")).select("doc_id")
    return evaluation.label_split(results(t), labelled, flagged(t), "doc_id", right())


@query(f"""select lang, count(distinct doc_id) as questions, count(distinct doc_id) filter (where toxic = 1) as left_out
from {RESULTS_SQL} group by lang""")
def ev_left_out(t):
    return evaluation.left_out(results(t), flagged(t), "doc_id", "lang")


@query("""select round_even((select avg(value) from (select value from events order by event_id desc limit 5)), 6) as last_mean,
  max(event_id) as max_step from events""")
def ev_last_k_mean(t):
    means = evaluation.last_k_mean(t.events, "event_id", "value")
    return means.select(round_even(F.col("last_mean"), 6).alias("last_mean"), "max_step")


@query("""with s as (select lang, length(text) as c, len(string_split(text, chr(10))) as l, len(regexp_extract_all(text, '\\S+')) as w from documents),
r as (select coalesce(lang, 'all') as lang, sum(c)::bigint as chars, sum(l)::bigint as lines, sum(w)::bigint as words
  from s group by rollup (lang))
select *, printf('%.1f', chars / (select sum(c) from s where lang = 'en')) || '×' as ratio from r""")
def ev_text_size(t):
    return evaluation.text_size(t.documents, "text", "lang", "en")
