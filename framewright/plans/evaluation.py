"""Scores of evaluation runs: one row per answer, with run, set, id, ok and size columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.formatting import fixed_decimals
from framewright.functions.numbers import true_div
from framewright.functions.text import lines, strip
from framewright.operators.aggregate import rows, total
from framewright.operators.order import top
from framewright.operators.select import common_type, same_key, where_in_table
from framewright.session import cut_lineage


def score_text(ok: Column, n: Column) -> Column:
    """``3/4 (75%)``; empty when there is no row."""
    percent = fixed_decimals(true_div(ok * 100, n), 0)
    text = F.concat(ok.cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("), percent, F.lit("%)"))
    return F.when(n > 0, text).otherwise(F.lit(""))


def score(ok: Column, among: Column | None = None) -> Column:
    """Share of correct rows as text, over all rows or those ``among``."""
    if among is None:
        return score_text(F.count_if(ok), rows())
    return score_text(F.count_if(ok & among), F.count_if(among))


def rollup(results: DataFrame, group: str, ok: Column, size: Column) -> DataFrame:
    """For every group: correct, total, score text, mean size and size spent per correct answer."""
    good = F.count_if(ok)
    return results.groupBy(group).agg(
        good.alias("ok"),
        rows().alias("total"),
        score(ok).alias("score"),
        F.avg(size).alias("mean_size"),
        true_div(total(size), F.nullif(good, F.lit(0))).alias("size_per_correct"),
    )


def comparison(results: DataFrame, run: str, group: str, sets: list[str], main: str, ok: Column, size: Column):
    """One row per run: a score text per set, mean size and size per correct answer.

    The sizes are those of set ``main``, or of all rows where a run has none of it.
    """
    in_main = F.col(group) == F.lit(main)
    mine = F.count_if(in_main)
    good = F.when(mine > 0, F.count_if(ok & in_main)).otherwise(F.count_if(ok))
    spent = F.when(mine > 0, total(F.when(in_main, size))).otherwise(total(size))
    used = F.when(mine > 0, mine).otherwise(rows())
    per_correct = fixed_decimals(true_div(spent, F.nullif(good, F.lit(0))), 0, grouped=True)
    return results.groupBy(run).agg(
        *[score(ok, F.col(group) == F.lit(s)).alias(s) for s in sets],
        F.coalesce(fixed_decimals(true_div(spent, used), 0, grouped=True), F.lit("")).alias("mean_size"),
        F.coalesce(per_correct, F.lit("none correct")).alias("size_per_correct"),
    )


def pivoted_scores(results: DataFrame, run: str, group: str, sets: list[str], ok: Column) -> DataFrame:
    """Score text per run (rows) and set (columns); empty where a run did not cover a set."""
    return results.groupBy(run).pivot(group, sets).agg(score(ok)).na.fill("")


def fair(results: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Results without the questions that are flagged as depending on tie-breaking."""
    return where_in_table(results, key, flagged, key, negate=True)


def label_split(
    results: DataFrame, labelled: DataFrame, flagged: DataFrame, key: str, ok: Column, sets: tuple[str, list] | None = None
) -> DataFrame:
    """One row: the score on questions without and with a label, flagged questions left out.

    ``sets`` names a column and the sets that count (all if it is not given). Labels and flags come in as one table,
    a row per id, so there is one join, whose hot ids AQE can split.
    """
    if sets is not None:
        results = results.where(F.col(sets[0]).isin(sets[1]))
    shared = common_type(labelled.schema[key].dataType, flagged.schema[key].dataType)
    ids = labelled.select(F.col(key).cast(shared).alias("_id"), F.lit(True).alias("_l"), F.lit(False).alias("_f")).unionByName(
        flagged.select(F.col(key).cast(shared).alias("_id"), F.lit(False).alias("_l"), F.lit(True).alias("_f"))
    )
    marks = ids.where("_id is not null").groupBy("_id").agg(F.max("_l").alias("_labelled"), F.max("_f").alias("_flagged"))
    types = (results.schema[key].dataType, shared)
    rows_ = results.join(marks, same_key(F.col(key), F.col("_id"), types), "left").where(~F.coalesce("_flagged", F.lit(False)))
    has_label = F.coalesce(F.col("_labelled"), F.lit(False))
    return rows_.agg(score(ok, ~has_label).alias("without_label"), score(ok, has_label).alias("with_label"))


def left_out(results: DataFrame, flagged: DataFrame, key: str, group: str) -> DataFrame:
    """For every set: the number of questions and how many of them are flagged."""
    marks = flagged.select(F.col(key).alias("_id")).distinct()
    questions = results.select(group, key).distinct().join(marks, F.col(key) == F.col("_id"), "left")
    return questions.groupBy(group).agg(rows().alias("questions"), F.count("_id").alias("left_out"))


def last_k_mean(log: DataFrame, step: str, value: str, k: int = 5) -> DataFrame:
    """Mean of the last ``k`` logged values, and the highest step."""
    known = log.where(F.col(value).isNotNull())
    ends = top(known.select(step, value), k, step)
    last = ends.agg(F.avg(value).alias("m")).scalar()
    return log.agg(last.alias("last_mean"), F.max(step).alias("max_step"))


def text_size(texts: DataFrame, text: str, version: str, base: str) -> DataFrame:
    """Characters, lines and words per version and in all, without blanks around a text, and how many times longer than ``base``."""
    body = strip(F.col(text))
    sizes = texts.select(
        F.col(version),
        F.length(body).alias("_chars"),
        F.size(lines(body)).alias("_lines"),
        F.regexp_count(body, F.lit(r"\S+")).alias("_words"),
    )
    names = ("chars", "lines", "words")
    # one row per version, kept, so that the texts are read once for all that follows
    each = cut_lineage(sizes.groupBy(version).agg(*[total(f"_{n}").alias(n) for n in names]))
    totals = each.rollup(version).agg(*[F.sum(n).alias(n) for n in names], F.grouping(version).alias("_all"))
    name = F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(version))
    first = each.agg(F.max(F.when(F.col(version) == F.lit(base), F.col("chars")))).scalar()
    named = totals.select(name.alias(version), *names, true_div(F.col("chars"), first).alias("_ratio"))
    ratio = F.concat(fixed_decimals(F.col("_ratio"), 1), F.lit("×"))
    return named.select(version, *names, ratio.alias("ratio"))
