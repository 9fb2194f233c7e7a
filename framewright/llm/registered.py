"""The queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.catalog.registry import Tables
from framewright.llm import bpe, cleaning, collocations, dedup, html, jaccard, languages, packing, passages, quality, spelling, tokenfiles, tokens, toxicity
from framewright.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(tables)`` under its own name, with SQL for the same rows."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


@query()
def op1_cutting_stock_packing(t: Tables) -> DataFrame:
    """All documents in sequences of at most 1024 byte-level ids, end id 0."""
    pieces = packing.pack(t.documents, tokens.tokenizer_path(tokens.BYTE_LEVEL), end_id=0, capacity=1024)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query()
def op2_simple8b_token_files(t: Tables) -> DataFrame:
    """All documents written as Simple-8b token files with end id 2, and read back."""
    path = tokenfiles.write(t.documents, scratch_path(t.spark), tokens.tokenizer_path(tokens.WORD_END), end_id=2)
    return tokenfiles.read(t.spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# The same counts, line rules and verdict as cleaning.Rules() has, in DuckDB's words.
OP9_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce("text", '') as t from documents
), words as (
  select rid, w, p from (select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
    unnest(ws) with ordinality as u(w, p)
), windows as (
  select rid, p, w, lead(w, 1) over o as w2, lead(w, 2) over o as w3 from words window o as (partition by rid order by p)
), again as (
  select rid, w, w2, w3 from windows where w3 is not null group by all having count(*) > 1
), covered as (
  select x.rid, count(distinct x.p + k) as n_repeat_words
  from windows x join again a on x.rid = a.rid and x.w = a.w and x.w2 = a.w2 and x.w3 = a.w3, unnest([0, 1, 2]) as s(k)
  group by x.rid
), lines as (
  select rid, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n,
    length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) as chars
  from (select rid, string_split(t, chr(10)) as ls from d), unnest(ls) as u(l)
), judged as (
  select rid, l, chars,
    100 * len(regexp_extract_all(l, '[|»›•]|::')) > 25 * n
    or 100 * length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > 20 * n
    or (n >= 4 and 100 * length(regexp_replace(l, '[^\p{Lu}]', '', 'g')) > 70 * length(regexp_replace(l, '[^\p{L}]', '', 'g')))
    or regexp_matches(lower(l), 'accept cookies|cookie policy|cookie settings|use of cookies|terms of use|terms of service|privacy policy|all rights reserved|enable javascript|javascript is disabled|lorem ipsum|click here|sign in|sign up|log in|subscribe to|newsletter|share this|read more|skip to content|back to top')
    or not regexp_matches(l, '[.!?…"'')\]”’»:;][ \t\x0b\f\r]*$') as bad
  from lines where n > 0
), by_line as (
  select rid, count(*) - count(distinct l) as n_dup_lines, coalesce(sum(chars) filter (bad), 0) as lost from judged group by rid
), counted as (
  select d.rid, d.doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost, 0) as lost
  from d left join by_line using (rid) left join covered using (rid)
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost <= 55 * word_chars as kept
from counted
"""


@query(OP9_SQL)
def op9_line_first_rules(t: Tables) -> DataFrame:
    """Counts and verdict of the quality rules for all documents."""
    return cleaning.clean(t.documents).drop("lost_chars", "clean_text")


def held_out(modulus: int, rest: int):
    """Rows that no model may learn labels from, by the checksum of the doc_id's text; a null doc_id is never one."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


@query()
def op10_rank_order_language(t: Tables) -> DataFrame:
    """Language of all documents, profiles learned from those not held out."""
    docs = t.documents
    profiles = languages.train(docs.where(~held_out(5, 0)))
    return languages.identify(docs, profiles).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


OP5_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, text_sha256
from d window same as (partition by text_sha256)
"""


@query(OP5_SQL)
def op5_cuckoo_exact_dedup(t: Tables) -> DataFrame:
    """Every document with the copy of its text that stays."""
    marked = dedup.mark(t.documents)
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query()
def op6_tree_scored_html(t: Tables) -> DataFrame:
    """The main text of all pages."""
    return html.extract(t.pages)


@query()
def op7_noisy_or_toxicity(t: Tables) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    labels = t.labels.where(~held_out(5, 0)).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(t.documents, toxicity.train(t.documents, labels))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op8_sparse_rule_quality(t: Tables) -> DataFrame:
    """Quality of all documents, rules learned from the labels that are not held out."""
    path = scratch_path(t.spark)
    quality.statistics(t.documents).write.parquet(path)
    measured = t.spark.read.parquet(path)  # a few numbers a document, read for learning and for scoring
    labels = t.labels.where(~held_out(4, 2)).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(measured, quality.train(measured, labels))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op3_token_group_jaccard(t: Tables) -> DataFrame:
    """Components of all documents under links of four-word shingle sets with 85 percent in common."""
    return jaccard.join(t.documents, words=4, percent=85)


@query()
def op4_chunk_reuse_bpe(t: Tables) -> DataFrame:
    """Digests of the ids and of the decoded ids of all documents."""
    return bpe.encode(t.documents, tokens.tokenizer_path(tokens.WORD_END), bpe.digests, bpe.DIGESTS)


OP13_SQL = r"""
with pieces as materialized (
  select coalesce(lang, 'und') as lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws
  from documents, unnest(regexp_split_to_array(
    translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as u(piece)
), placed as materialized (
  select lang, row_number() over () as piece, ws from pieces
), words as materialized (
  select lang, piece, unnest(ws) as w, generate_subscripts(ws, 1) as p from placed
), suffixes as materialized (
  select lang, w as w1, w1 || ' ' || lead(w, 1) over o as w2, w2 || ' ' || lead(w, 2) over o as w3,
    w3 || ' ' || lead(w, 3) over o as w4, w4 || ' ' || lead(w, 4) over o as w5
  from words window o as (partition by piece order by p)
), grams as materialized (
  select lang, 1 as size, w1 as phrase, count(*) as f from suffixes group by all
  union all select lang, 2, w2, count(*) from suffixes where w2 is not null group by all
  union all select lang, 3, w3, count(*) from suffixes where w3 is not null group by all
  union all select lang, 4, w4, count(*) from suffixes where w4 is not null group by all
  union all select lang, 5, w5, count(*) from suffixes where w5 is not null group by all
), totals as materialized (
  select lang, sum(f) as n from grams where size = 1 group by lang
), found as materialized (
  select * from grams where size > 1 and f >= 100
), cuts as materialized (
  select lang, phrase, a, k, lang || chr(10) || array_to_string(ws[1 : k], ' ') as head, lang || chr(10) || array_to_string(ws[k + 1 : ], ' ') as tail
  from (select lang, phrase, f as a, string_split(phrase, ' ') as ws, unnest(range(1, size)) as k from found)
), keyed as materialized (
  select lang || chr(10) || phrase as part, f from grams
), halves as materialized (
  select c.*, x.f as l from cuts c join keyed x on x.part = c.head
), both_halves as materialized (
  select c.*, y.f as r from halves c join keyed y on y.part = c.tail
), scored as materialized (
  select c.lang, phrase, a, k, l, r, n, (1000::hugeint * a * n) // (l::hugeint * r) as score from both_halves c join totals t on c.lang = t.lang
), weakest as materialized (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_parts as materialized (
  select lang, array_to_string(ws[i : i + m - 1], ' ') as phrase, max(f) as f
  from (select lang, size, f, string_split(phrase, ' ') as ws from found) g, unnest([2, 3, 4]) as s(m), unnest(range(1, size - m + 2)) as p(i)
  where m < size group by all
), kept as materialized (
  select w.* from weakest w left join inner_parts i on i.lang = w.lang and i.phrase = w.phrase where i.f is null or 100 * i.f < 100 * w.a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r,
  cast(n as bigint) as n, cast(score as bigint) as score
from kept qualify rank <= 2000
"""


@query(OP13_SQL)
def op13_suffix_sort_collocations(t: Tables) -> DataFrame:
    """The first 2000 phrases of two to five words of each language of all documents."""
    return collocations.mine(t.documents)


# The checksum is worked out from its polynomial; texts of these letters have one or two bytes a code point in UTF-8.
OP12_SQL = r"""
with crc_table as materialized (
  select list(v order by i) as crc from (
    select i, list_reduce(range(0, 8), lambda c, _ : case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v
    from range(0, 256) as r(i))
), found as materialized (
  select doc_id, unnest(regexp_extract_all(
    translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) as run
  from documents
), runs as materialized (
  select doc_id, run, count(*) as times from found group by all
), hashed as materialized (
  select run, times, xor(list_reduce(
    flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''),
      lambda x : case when unicode(x) < 128 then [cast(unicode(x) as bigint)] else [195, cast(unicode(x) as bigint) - 64] end)),
    lambda c, b : xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as h
  from runs, crc_table
), spelt as materialized (
  select case when h % 97 = 0 then left(run, h % length(run)) || substring(run, cast(h % length(run) + 2 as bigint)) else run end as word, times from hashed
), vocab as materialized (
  select word, cast(sum(times) as bigint) as n from spelt where length(word) >= 5 group by word having sum(times) >= 3
), places as materialized (
  select word, n, unnest(range(1, length(word) + 1)) as i from vocab
), cut as materialized (
  select distinct word, n, left(word, i - 1) || substring(word, i + 1) as edit from places
), masked as materialized (
  select word, n, left(word, i - 1) || '_' || substring(word, i + 1) as edit from places
), pairs as materialized (
  select c.word, c.n, v.word as near, v.n as near_n from cut c join vocab v on v.word = c.edit
  union all select v.word, v.n, c.word, c.n from cut c join vocab v on v.word = c.edit
  union all select a.word, a.n, b.word, b.n from masked a join masked b on a.edit = b.edit where a.word <> b.word
), best as materialized (
  select word, count(*) as n_near, max(near_n) as most from pairs group by word
), nearest as materialized (
  select p.word, b.n_near, b.most, min(near) as near from pairs p join best b on p.word = b.word where near_n = b.most group by all
), formed as materialized (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when most >= 2 * v.n then near end as form, case when most >= 2 * v.n then most end as form_n
  from vocab v left join nearest x on v.word = x.word
), walk as (
  with recursive step(word, root) as (
    select word, word from formed
    union all select s.word, f.form from step s join formed f on s.root = f.word where f.form is not null)
  select s.word, s.root from step s join formed f on s.root = f.word where f.form is null
)
select f.word, form, root, n, cast(n_near as bigint) as n_near, form_n from formed f join walk w on f.word = w.word
"""


@query(OP12_SQL)
def op12_bloom_spelling_variants(t: Tables) -> DataFrame:
    """Spelling variants among the words of all documents, with misspellings planted in every 97th run."""
    return spelling.group(t.documents, misspell_every=97)


OP11_SQL = r"""
with split as materialized (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') as ws from documents
), windows as materialized (
  select rid, doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) as w
  from (select rid, doc_id, ws, unnest(range(1, len(ws) - 48)) as i from split)
), firsts as materialized (
  select w, min(doc_id) as first_id from windows group by w
), covered as materialized (
  select distinct rid, unnest(range(i, i + 50)) as p from windows x join firsts f on x.w = f.w where first_id < doc_id
), words as materialized (
  select rid, unnest(ws) as word, generate_subscripts(ws, 1) as p from split
), kept as materialized (
  select w.rid, count(c.p) as n_removed, string_agg(w.word, ' ' order by w.p) filter (c.p is null) as body
  from words w left join covered c on c.rid = w.rid and c.p = w.p group by w.rid
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from split s left join kept k on s.rid = k.rid
"""


@query(OP11_SQL)
def op11_fm_index_substring_dedup(t: Tables) -> DataFrame:
    """What is left of all documents without windows of 50 words that an earlier document has too."""
    return passages.strip(t.documents)
