"""Jobs over a table of examples: duplicates, splits, leaks, audits and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import text as texts
from framewright.functions.hashes import fingerprints, quoted
from framewright.operators.aggregate import rows
from framewright.operators.select import same_key
from framewright.session import cut_lineage

# Percentages of the hash split, and the tolerance between equal numbers.
TEST_BELOW, VALIDATION_BELOW = 4, 8
TOLERANCE = 0.01

FOLD = 1_000_000.0  # numbers are folded into 0 ... FOLD before they are summed
BUCKETS = 16_384  # of row hashes, in the comparison of two tables
ORDER_BLOCK = 1_000_000  # rows compared with their neighbour in one window


def digest(c: Column) -> Column:
    """A 16-byte stand-in for a long text: what the shuffles carry instead of the text.

    Null has a digest of its own (no bytes), so that it can be a join key.
    """
    return F.coalesce(F.unhex(F.md5(c.cast("string"))), F.lit(bytearray()))


def keep_first(examples: DataFrame, key: Column, seq: str) -> DataFrame:
    """The first row of every key.

    The key's digest finds the survivors; copies shrink to one row per task before the shuffle.
    The rows themselves are joined on the unique ``seq``, so no key can make a join uneven.
    """
    survivors = examples.select(digest(key).alias("_k"), F.col(seq)).groupBy("_k").agg(F.min(seq).alias(seq))
    return examples.join(survivors.select(seq), seq, "left_semi")


def keep_first_of_two(examples: DataFrame, first_key: Column, second_key: Column, seq: str) -> DataFrame:
    """The first row of every first key, and of these the first row of every second key.

    Two aggregates, one after the other, and no job while the plan is built. A row whose second key belongs to an
    earlier row that fell out under its own first key stays open here to the rows that are left; going through the
    rows in turn (``keep_first_in_turn``) can keep others.
    """
    keys = examples.select(F.col(seq).alias("_seq"), digest(first_key).alias("_a"), digest(second_key).alias("_b"))
    one = keys.groupBy("_a").agg(F.min(F.struct("_seq", "_b")).alias("_row")).select("_row._seq", "_row._b")
    two = one.groupBy("_b").agg(F.min("_seq").alias("_seq"))
    return examples.join(two.select("_seq"), F.col(seq) == F.col("_seq"), "left_semi")


PLAIN_ROUNDS = 3  # of keep_first_in_turn, before it contracts chains


def _resolved_by_leads(undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that come first under both of their keys are kept; gives these, and the others."""
    lead_a = undecided.groupBy("_a").agg(F.min("_seq").alias("_lead_a"))
    lead_b = undecided.groupBy("_b").agg(F.min("_seq").alias("_lead_b"))
    led = undecided.join(lead_a, "_a").join(lead_b, "_b")
    first = (F.col("_lead_a") == F.col("_seq")) & (F.col("_lead_b") == F.col("_seq"))
    return led.where(first).select(*undecided.columns), led.where(~first)


def _roots_of_chains(links: DataFrame) -> DataFrame:
    """_seq, _to, _flips: where following ``links`` (_seq, _to, _flips) ends, and whether the steps are odd in number. Steps double."""
    while True:
        onward = links.select(F.col("_seq").alias("_to"), F.col("_to").alias("_further"), F.col("_flips").alias("_more"))
        links = cut_lineage(
            links.join(onward, "_to", "left").select(
                "_seq",
                F.coalesce("_further", "_to").alias("_to"),
                (F.col("_flips") != F.coalesce("_more", F.lit(False))).alias("_flips"),
                F.col("_further").isNotNull().alias("_moved"),
            )
        )
        if links.where("_moved").limit(1).count() == 0:
            return links.drop("_moved")
        links = links.drop("_moved")


def _resolved_by_chains(undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decide whole chains at once: gives the rows that are kept, and those that are still open.

    A row that comes first under one key and second under the other has one row before it: it is kept if and only if that
    one is not. Such rows form chains; followed to their ends, those that end in a row that is kept are decided.
    """
    kept, rest = _resolved_by_leads(undecided)
    kept, rest = cut_lineage(kept), cut_lineage(rest)
    singles = []
    for key, lead, other in (("_a", "_lead_a", "_lead_b"), ("_b", "_lead_b", "_lead_a")):
        # Rows behind the first of a key, and of these the first: the key's second row.
        second = rest.where(F.col(lead) != F.col("_seq")).groupBy(key).agg(F.min("_seq").alias("_second"))
        behind = rest.where((F.col(lead) != F.col("_seq")) & (F.col(other) == F.col("_seq")))
        singles.append(behind.join(second, key).where(F.col("_second") == F.col("_seq")).select("_seq", F.col(lead).alias("_to")))
    links = singles[0].unionByName(singles[1]).withColumn("_flips", F.lit(True))
    roots = _roots_of_chains(cut_lineage(links))
    ended = roots.join(kept.select(F.col("_seq").alias("_to")), "_to", "left_semi")
    decided = rest.join(ended.select("_seq", "_flips"), "_seq", "left")
    more = decided.where("not _flips").select(*undecided.columns)  # an even number of steps from a row that is kept
    return kept.unionByName(more), decided.where("_flips is null").select(*undecided.columns)


def keep_first_in_turn(examples: DataFrame, first_key: Column, second_key: Column, seq: str) -> DataFrame:
    """Rows taken in order, each one dropped if either of its keys belongs to a row kept before.

    The result is that of going through the rows one by one, found in rounds. In the first rounds the rows that come first
    under both of their keys are kept, and the rows that share a key with them fall out. What is still open then has
    long chains of rows that share keys pairwise; later rounds decide whole chains by doubling steps, so that a chain
    takes as many checkpoints of its keys as the logarithm of its length. Rows with several open rows before them under one
    key wait for a later round.
    """
    rows = examples.select(F.col(seq).alias("_seq"), digest(first_key).alias("_a"), digest(second_key).alias("_b"))
    # full copies fall out at once
    undecided, kept, rounds = rows.groupBy("_a", "_b").agg(F.min("_seq").alias("_seq")), None, 0
    while True:
        found, rest = (_resolved_by_leads if rounds < PLAIN_ROUNDS else _resolved_by_chains)(undecided)
        marked = found.select("_seq", "_a", "_b", F.lit(True).alias("_kept"))
        by_a, by_b = found.select("_a"), found.select("_b")
        rest = rest.select("_seq", "_a", "_b", F.lit(False).alias("_kept")).join(by_a, "_a", "left_anti").join(by_b, "_b", "left_anti")
        state = cut_lineage(marked.unionByName(rest.select(*marked.columns)))
        found, undecided = state.where("_kept").select("_seq"), state.where("not _kept").drop("_kept")
        kept = found if kept is None else kept.unionByName(found)
        rounds += 1
        if undecided.limit(1).count() == 0:
            break
    return examples.join(kept, F.col(seq) == F.col("_seq"), "left_semi")


def hash_bucket(text: Column, buckets: int = 100) -> Column:
    """md5 of a text, read as one 128-bit number, modulo ``buckets``."""
    hexed = F.md5(text)
    words = [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    return reduce(lambda rest, word: (rest * F.lit(2**32 % buckets) + word) % F.lit(buckets), words)


def hash_split(examples: DataFrame, task: Column) -> DataFrame:
    """Adds ``bucket`` and ``split`` (test, val or train), decided by the text alone."""
    bucket = hash_bucket(task)
    split = F.when(F.col("bucket") < TEST_BELOW, "test").when(F.col("bucket") < VALIDATION_BELOW, "val")
    return examples.withColumn("bucket", bucket).withColumn("split", split.otherwise("train"))


def _shape(answers: DataFrame, answer: str) -> DataFrame:
    """Every answer as a digest of its masked lines, the numbers of each line, and its own digest."""
    kept = texts.non_blank_lines(F.col(answer))
    mask = F.array_join(F.transform(kept, texts.masked), "\n")
    found = F.transform(kept, texts.numbers)
    return answers.select(digest(mask).alias("_mask"), found.alias("_numbers"), digest(F.col(answer)).alias("_answer"))


def number_cell(numbers: Column) -> Column:
    """A whole number that is equal or off by one for two lists of numbers that match pairwise.

    Every number is folded into a bounded range without stretching distances and weighted by its
    place; the sum of two matching lists then differs by less than half a cell.
    """
    flat = F.flatten(numbers)
    fold = lambda x: F.abs(F.pmod(x + F.lit(FOLD), F.lit(2 * FOLD)) - F.lit(FOLD))
    weighted = F.transform(flat, lambda x, i: fold(x) * (1 + F.pmod(i * F.lit(0.618), F.lit(1.0))))
    level = F.aggregate(weighted, F.lit(0.0), lambda total, x: total + x)
    width = F.lit(4 * TOLERANCE) * F.greatest(F.size(flat), F.lit(1))
    return F.floor(F.nanvl(level, F.lit(0.0)) / width)


def leaked_answers(examples: DataFrame, answer: str, banned: DataFrame, banned_answer: str) -> DataFrame:
    """Digests of the answers that equal a banned one line by line, numbers within the tolerance.

    Join keys are the masked lines and a cell made of all numbers, so answers that share a mask
    spread over their numbers, and only near ones meet. What meets is compared number by number.
    Copies are folded before the join.
    """

    def near(xs: Column, ys: Column) -> Column:
        close = F.zip_with(xs, ys, lambda x, y: F.coalesce(F.abs(x - y) < TOLERANCE, F.lit(False)))
        return F.coalesce(F.forall(close, lambda ok: ok), F.lit(False))

    mine = _shape(examples, answer).distinct().withColumn("_cell", number_cell(F.col("_numbers")))
    theirs = _shape(banned, banned_answer).select(F.col("_mask").alias("_like"), F.col("_numbers").alias("_other"))
    cell = number_cell(F.col("_other"))
    theirs = theirs.distinct().select("_like", "_other", F.explode(F.array(cell - 1, cell, cell + 1)).alias("_at"))
    same = F.forall(F.zip_with("_numbers", "_other", near), lambda ok: ok)
    hit = mine.join(theirs, (F.col("_mask") == F.col("_like")) & (F.col("_cell") == F.col("_at")) & same, "left_semi")
    return hit.select("_answer")  # distinct already


def without_leaks(examples: DataFrame, answer: str, banned: DataFrame, banned_answer: str, negate: bool = True):
    """Rows whose answer does not (or, with ``negate=False``, does) reproduce a banned answer."""
    leaked = leaked_answers(examples, answer, banned, banned_answer)
    how = "left_anti" if negate else "left_semi"
    return examples.join(leaked, digest(F.col(answer)) == F.col("_answer"), how)


def mark_leaks(examples: DataFrame, answer: str, banned: DataFrame, banned_answer: str, name: str = "leaked") -> DataFrame:
    """All rows, with whether their answer reproduces a banned one; both tables are shaped once."""
    leaked = leaked_answers(examples, answer, banned, banned_answer).withColumn("_hit", F.lit(True))
    marked = examples.join(leaked, digest(F.col(answer)) == F.col("_answer"), "left")
    return marked.withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit", "_answer")


def _both_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both tables; ``_side`` is 1 for those of ``a`` and -1 for those of ``b``."""
    return a.select("*", F.lit(1).alias("_side")).unionByName(b.select(*quoted(a.columns), F.lit(-1).alias("_side")))


def different_buckets(both: DataFrame, names: list[str], side: str) -> tuple[DataFrame, Column]:
    """The hash buckets in which two tables differ, and the bucket of a row.

    ``both`` holds the rows of both, ``side`` is 1 in the one and -1 in the other. A bucket's rows are summed up, whatever
    their order: their number and four 32-bit parts of their hashes, the one table's less the other's. All are 0 if the
    bucket holds the same rows equally often (and else by a chance of about 2^-128).
    """
    one, two = fingerprints(names)
    low = F.lit(0xFFFFFFFF)
    parts = [one.bitwiseAND(low), F.shiftrightunsigned(one, 32), two.bitwiseAND(low), F.shiftrightunsigned(two, 32)]
    bucket = F.pmod(one, F.lit(BUCKETS))
    sums = both.groupBy(bucket.alias("_bucket")).agg(F.sum(side).alias("_n"), *(F.sum(F.col(side) * p).alias(f"_h{i}") for i, p in enumerate(parts)))
    differ = (F.col("_n") != 0) | (F.col("_h0") != 0) | (F.col("_h1") != 0) | (F.col("_h2") != 0) | (F.col("_h3") != 0)
    return sums.where(differ).select("_bucket"), bucket


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that do not occur equally often in both tables, with the count in each.

    First sums of row hashes are compared, by hash bucket: at most ``BUCKETS`` rows of numbers a task are shuffled. Only rows
    of buckets that differ are then counted and shuffled whole; tables that are equal are not, and are not read again.
    """
    names = a.columns
    both = _both_sides(a, b)
    found, bucket = different_buckets(both, names, "_side")
    rest = both.withColumn("_bucket", bucket).join(F.broadcast(found), "_bucket", "left_semi")
    counts = rest.groupBy(*quoted(names)).agg(F.count_if(F.col("_side") == 1).alias("left_rows"), F.count_if(F.col("_side") == -1).alias("right_rows"))
    return counts.where(F.col("left_rows") != F.col("right_rows"))


def equal_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``equal``: whether two tables hold the same rows equally often, in whatever order. From hashes alone, no row is shuffled."""
    found, _ = different_buckets(_both_sides(a, b), a.columns, "_side")
    return found.agg((rows() == 0).alias("equal"))


def sort_key(c: Column, dtype: T.DataType) -> Column:
    """The order in which a sorted file column is expected: numbers first, then texts."""
    if not isinstance(dtype, T.StringType):
        return c
    number = c.try_cast("double")
    return F.struct(
        number.isNull().cast("int").alias("kind"),
        F.coalesce(number, F.lit(0.0)).alias("number"),
        F.when(number.isNull(), c).otherwise(F.lit("")).alias("text"),
    )


def order_breaks(placed: DataFrame, name: str, pos: str = "pos", desc: bool = False) -> DataFrame:
    """Number of neighbouring rows in the wrong order; equal values may stand in any order.

    ``pos`` numbers the rows 1, 2, 3 ... . Rows are compared in blocks of positions, and the first
    row of a block also closes the block before, so no pair of neighbours is missed.
    """
    block = F.floor(F.col(pos) / ORDER_BLOCK)
    also = F.when(F.col(pos) % ORDER_BLOCK == 0, F.array(block - 1, block)).otherwise(F.array(block))
    keyed = placed.select(pos, sort_key(F.col(name), placed.schema[name].dataType).alias("_key"), F.explode(also).alias("_block"))
    before = F.lag("_key").over(Window.partitionBy("_block").orderBy(pos))
    wrong = (before < F.col("_key")) if desc else (before > F.col("_key"))
    return keyed.select(wrong.alias("_wrong")).agg(F.count_if("_wrong").alias("breaks"))


def table_check(got: DataFrame, expected: DataFrame, sort_by: str, pos: str = "pos", desc: bool = False) -> DataFrame:
    """One row: header, rows and order compared with what was expected.

    ``got`` carries its row numbers in ``pos``; these are not compared.
    """
    body = got.drop(pos)
    if body.columns != expected.columns:
        spark = got.sparkSession
        return spark.range(1).select(F.lit(False).alias("ok"), F.lit("header " + ",".join(body.columns)).alias("note"))
    equal = equal_rows(body, expected).scalar()
    breaks = order_breaks(got, sort_by, pos, desc)
    note = F.when(~equal, "different rows").when(F.col("breaks") > 0, "wrong order").otherwise("")
    return breaks.select((note == "").alias("ok"), note.alias("note"))


def overlap_audit(examples: DataFrame, key: Column, split: str) -> DataFrame:
    """Keys found in more than one split, or more than once: digest, splits and rows."""
    return (
        examples.groupBy(F.md5(key.cast("string")).alias("key"))
        .agg(F.count_distinct(split).alias("splits"), rows().alias("n"))
        .where((F.col("splits") > 1) | (F.col("n") > 1))
    )


def coverage(examples: DataFrame, text: str, patterns: dict[str, str], at_least: float, split: str) -> DataFrame:
    """For every split and pattern: matching rows, all rows, and whether the share is reached."""
    wide = examples.groupBy(split).agg(
        rows().alias("n"), *[F.count_if(F.col(text).rlike(p)).alias(name) for name, p in patterns.items()]
    )
    long = wide.unpivot([split, "n"], list(patterns), "pattern", "matched")
    return long.withColumn("enough", F.col("matched") >= F.col("n") * F.lit(at_least))


def held_out_audit(examples: DataFrame, group: str, held_out: str, split: str) -> DataFrame:
    """For every split: its rows, and how many of them belong to the held-out group."""
    return examples.groupBy(split).agg(
        rows().alias("n"), F.count_if(F.col(group) == F.lit(held_out)).alias("held_out_rows")
    )


def domain_check(table: DataFrame, declared: dict[str, list]) -> DataFrame:
    """For every declared column: rows with an undeclared value, and declared values not found.

    One pass over the table with plain counters, whatever the number of columns.
    """
    if missing := [c for c in declared if c not in table.columns]:
        raise ValueError(f"columns not found: {missing}")

    def absent(c: str, value) -> Column:
        return F.coalesce(F.max((F.col(c) == F.lit(value)).cast("int")), F.lit(0)) == 0

    counters = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(~F.col(c).isin(values)).alias("undeclared"),
            sum((absent(c, v).cast("bigint") for v in values), F.lit(0).cast("bigint")).alias("not_found"),
        )
        for c, values in declared.items()
    ]
    return table.agg(F.array(*counters).alias("checks")).select(F.inline("checks"))


def prompt_rows(
    examples: DataFrame, descriptions: DataFrame, key: str, task: str, answer: str, intro: Column, closing: str,
    headings: tuple[str, str] = ("# Data", "# Task"),
):
    """Prompt text and completion of every example, next to the description of its table.

    The prompt is the intro, the description if there is one, the task, and a closing instruction; ``headings`` stand
    over the description and the task.
    """
    about = descriptions.where(F.col(key).isNotNull()).withColumnRenamed(key, "_key")
    types = (examples.schema[key].dataType, about.schema["_key"].dataType)
    described = examples.join(about, same_key(F.col(key), F.col("_key"), types), "left")
    data = F.when(F.col("description") != "", F.concat(F.lit(headings[0] + "\n\n"), texts.strip(F.col("description"))))
    ask = F.concat(F.lit(headings[1] + "\n\n"), texts.strip(F.col(task)), F.lit("\n\n" + closing))
    prompt = F.concat(F.concat_ws("\n\n", F.regexp_replace(intro, r"\s+$", ""), data, ask), F.lit("\n"))
    return described.withColumn("prompt", prompt).withColumn("completion", F.col(answer)).drop("_key", "description")
