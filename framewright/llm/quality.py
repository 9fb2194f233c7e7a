"""Quality classifier by a sparse ensemble of rules over text statistics.

Boosted shallow trees on a bounded sample propose rules (the path to every node is a conjunction of conditions on
statistics), a logistic regression with an L1 penalty keeps few of them, and what is kept is compiled into one
Spark column expression, so scoring is a projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import blocks
from framewright.llm.sampling import labelled_sample

SAMPLE = 20_000  # labelled documents that rules are learned from; the choice goes by a hash of the doc_id
TREES, DEPTH = 24, 3
CANDIDATES = 160  # rules that the lasso chooses from, those that go best with the label; 24 trees of depth 3 have 336 paths at most

STATISTICS = (
    "n_words", "mean_word_chars", "distinct_share", "repeat_share", "symbol_share", "letter_share", "upper_share", "digit_share",
    "pipe_share", "loud_share", "comma_share", "stop_share", "words_per_stop", "n_lines", "words_per_line", "dup_line_share",
    "ended_line_share", "longest_word",
)
COLUMNS = tuple(f"_q_{name}" for name in STATISTICS)  # as columns of a table: names that documents will hardly have
_ENDS = (b".", b"!", b"?", b":", b'"', b"'", b")")


def measure(text: bytes) -> tuple[float, ...]:
    """The statistics of one text, in the order of ``STATISTICS``; an empty text has 0 throughout."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    chars = text.decode()
    visible = sum(map(len, words))
    letters = sum(map(str.isalpha, chars))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    lines = [line for line in text.split(b"\n") if line.strip()]
    stops = text.count(b".") + text.count(b"!") + text.count(b"?")
    return (
        float(n),
        len("".join(chars.split())) / n,
        len(set(words)) / n,
        1 - len(set(windows)) / len(windows) if windows else 0.0,
        sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">", b"{", b"}"))) / n,
        letters / max(1, len(chars)),
        sum(map(str.isupper, chars)) / max(1, letters),
        sum(map(str.isdigit, chars)) / visible,
        text.count(b"|") / n,
        text.count(b"!") / n,
        text.count(b",") / n,
        stops / n,
        n / (stops + 1),
        float(len(lines)),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(line.rstrip().endswith(_ENDS) for line in lines) / len(lines),
        float(max(map(len, words))),
    )


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the statistics of every row of ``docs`` (with text); null counts as empty.

    The statistics are the columns ``COLUMNS``. Repeated rows give equal rows, no rows give none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    extra = [docs.schema[name] for name in keep]
    schema = StructType([*extra, *(StructField(s, DoubleType()) for s in COLUMNS)])
    target = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks.slices(batches, "text"):
            body, bounds = blocks.raw(texts)
            whole, ends = body.tobytes(), bounds.tolist()
            values = np.array([measure(whole[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
            columns = [rows.column(f.name).cast(target.field(f.name).type) for f in extra]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(values[:, k]) for k in range(len(STATISTICS)))], schema=target)

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(work, schema)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    limit: float


@dataclass(frozen=True)
class RuleModel:
    """Log-odds: ``bias`` plus the weight of every rule (a conjunction) that holds."""

    rules: tuple[tuple[tuple[Condition, ...], float], ...]
    bias: float

    def column(self) -> Column:
        """The score as a Spark expression over ``COLUMNS``."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for c in conditions:
                value = F.col(COLUMNS[STATISTICS.index(c.statistic)])
                holds = holds & (value > c.limit if c.above else value <= c.limit)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.2f} " + " and ".join(f"{c.statistic} {'>' if c.above else '<='} {c.limit:.4g}" for c in r) for r, w in self.rules]


def _split(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray]):
    """The best cut of the rows: (gain, statistic, limit)."""
    best = (1e-6, -1, 0.0)
    whole = slope[rows].sum() ** 2 / (curve[rows].sum() + 1)
    for k, limits in enumerate(cuts):
        if not len(limits):
            continue
        bin_of = np.searchsorted(limits, x[rows, k])  # bin b: above limits[b - 1]
        g = np.bincount(bin_of, slope[rows], len(limits) + 1).cumsum()
        h = np.bincount(bin_of, curve[rows], len(limits) + 1).cumsum()
        gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - whole
        gain[(h[:-1] < 1) | (h[-1] - h[:-1] < 1)] = 0
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), k, float(limits[i]))
    return best


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[tuple[Condition, ...]]:
    """Conjunctions on the way to the nodes of boosted trees."""
    cuts = []
    for k in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)))
        cuts.append((values[1:] + values[:-1]) / 2)
    score = np.zeros(len(y))
    found: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, p * (1 - p)
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        if not len(rows):
            continue
        open_nodes = [((), rows, np.arange(len(y)))]
        for depth in range(DEPTH + 1):
            following = []
            for path, own, everyone in open_nodes:
                gain, k, limit = _split(x, slope, curve, own, cuts) if depth < DEPTH and len(own) >= 10 else (0, -1, 0)
                if k < 0:
                    score[everyone] += 0.5 * slope[own].sum() / (curve[own].sum() + 1)
                    continue
                for above in (False, True):
                    longer = (*path, Condition(STATISTICS[k], above, limit))
                    found.setdefault(longer)
                    side, all_side = x[own, k] > limit, x[everyone, k] > limit
                    following.append((longer, own[side == above], everyone[all_side == above]))
            open_nodes = following
    return list(found)


def _holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for c in rule:
        value = x[:, STATISTICS.index(c.statistic)]
        inside &= value > c.limit if c.above else value <= c.limit
    return inside


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3, steps: int = 400, candidates: int = CANDIDATES) -> RuleModel:
    """Rules and lasso weights from statistics and labels (0/1). With one class only, no rule and that class's odds.

    ``candidates`` bounds the rules that the lasso chooses from; it bounds the model, not the rows.
    """
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return RuleModel((), 0.0 if not len(y) else (40.0 if share else -40.0))
    rules = _paths(x, y, np.random.default_rng(7))
    matrix = np.array([_holds(r, x) for r in rules], float)
    spread = matrix.std(axis=1)
    strength = np.abs(((matrix - matrix.mean(axis=1, keepdims=True)) * (y - share)).mean(axis=1)) / np.maximum(spread, 1e-9)
    order = np.argsort(-strength, kind="stable")
    order = [i for i in order if spread[i] > 0][:candidates]
    rules, matrix = [rules[i] for i in order], matrix[order]
    # Lasso by accelerated proximal gradient steps; the bias is not penalized.
    w, bias = np.zeros(len(rules)), float(np.log(share / (1 - share)))
    look_w, look_b, momentum = w.copy(), bias, 1.0
    step = 4.0 / (1 + float((matrix**2).mean(axis=1).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.einsum("r,rn->n", look_w, matrix) + look_b)))
        gap = (p - y) / len(y)
        new_w = look_w - step * np.einsum("rn,n->r", matrix, gap)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_b = look_b - step * float(gap.sum())
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look_w, look_b = new_w + (momentum - 1) / faster * (new_w - w), new_b + (momentum - 1) / faster * (new_b - bias)
        w, bias, momentum = new_w, new_b, faster
    return RuleModel(tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6), bias)


def train(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE, candidates: int = CANDIDATES) -> RuleModel:
    """Learn from ``statistics`` and ``labels`` (doc_id, label 0/1): at most ``sample`` labelled documents.

    Null labels are passed over; of several labels of a document the smallest counts, of rows that repeat a doc_id any one.
    """
    picked = labelled_sample(labels, sample, F.min)  # at most ``sample`` rows
    rows = measured.select("doc_id", *COLUMNS).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    x = np.array([[r[c] for c in COLUMNS] for r in rows], float).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r["label"] for r in rows], float), candidates=candidates)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, candidates: int = CANDIDATES) -> RuleModel:
    """``train`` for documents (doc_id, text) that nothing has measured yet: only the labelled sample is."""
    picked = labelled_sample(labels, sample, F.min)  # at most ``sample`` rows
    labelled = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = statistics(labelled, keep=("doc_id", "label")).dropDuplicates(["doc_id"]).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    x = np.array([[r[c] for c in COLUMNS] for r in rows], float).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r["label"] for r in rows], float), candidates=candidates)


def score(measured: DataFrame, model: RuleModel, name: str = "score") -> DataFrame:
    """``measured`` with the score (0 to 1) as column ``name`` in place of the statistics."""
    return measured.withColumn(name, model.column()).drop(*COLUMNS)
