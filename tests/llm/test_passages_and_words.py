"""Repeated passages, spelling variants and collocations against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import collocations, passages, spelling
from framewright.llm.fm_index import FMIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Names that the operators use themselves stand in the caller's table too.
COLUMNS = "doc_id long, text string, lang string, owner string, content int, word string, n long, spans string, bucket int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, g, "o", 1, "w", 2, "s", 3) for i, t, g in rows], COLUMNS).repartition(parts)


# FM-index and repeated passages

def test_index_covers_what_brute_force_finds():
    for seed in range(60):
        draw = random.Random(seed)
        least, letters = draw.choice([2, 3, 5]), draw.choice([2, 3, 6])
        segments = [[draw.randrange(letters) for _ in range(draw.randint(1, 14))] for _ in range(draw.randint(1, 25))]
        owners = [draw.randrange(9) for _ in segments]
        index = FMIndex([np.array(s, np.uint64) for s in segments], np.array(owners), 16)
        got = [[False] * len(s) for s in segments]
        for s, a, b in zip(*index.covered(least)):
            got[s][a:b] = [True] * (b - a)
        want = [[False] * len(s) for s in segments]
        starts = {(k, tuple(t[m : m + least])) for k, t in enumerate(segments) for m in range(len(t) - least + 1)}
        for i, s in enumerate(segments):
            for j in range(len(s) - least + 1):
                if any((k, tuple(s[j : j + least])) in starts for k in range(len(segments)) if owners[k] < owners[i]):
                    want[i][j : j + least] = [True] * least
        assert got == want, seed


def stripped(rows, window):
    first = {}
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, passages.LAST), passages.LAST if i is None else i)
    out = []
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (passages.LAST if i is None else i):
                gone |= set(range(s, s + window))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


def passage_rows():
    draw = random.Random(3)
    word = lambda: draw.choice("ab cd é ef G g hi j kl".split(" ")) + str(draw.randrange(40))
    shared = [[word() for _ in range(draw.randint(8, 30))] for _ in range(6)]
    rows = [(None, None, None), (1, "", "x"), (2, " \t\n", None), (2, "one", None), (3, "a " * 500, None), (4, "a " * 300, None)]
    for i in range(5, 90):
        words = [word() for _ in range(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(words))
            words[at:at] = draw.choice(shared)
        rows.append((draw.choice([i, i, i, None]), draw.choice([" ", "\n", "  "]).join(words), None))
    return rows + rows[10:20] + [(200 + i, rows[40][1], None) for i in range(30)]


@pytest.mark.parametrize("crowd", [passages.CROWD, 1])
def test_repeated_passages(spark, crowd):
    rows = passage_rows()
    got = collections.Counter(map(tuple, passages.strip(frame(spark, rows), window=9, crowd=crowd).collect()))
    assert got == stripped(rows, 9)
    assert sum(n for (_, _, n, _), _ in got.items()) > 300


def test_repeated_passages_of_nothing(spark):
    assert passages.strip(frame(spark, [(1, "a", None)]).limit(0)).collect() == []


def test_shards_follow_the_words(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHARD_WORDS", 50)
    rows = passage_rows()
    assert collections.Counter(map(tuple, passages.strip(frame(spark, rows), window=9).collect())) == stripped(rows, 9)


# Spelling variants

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio=2):
    out, form = {}, {}
    for w, n in counts.items():
        around = [v for v in counts if near(w, v)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(around))
    found = set()
    for w, (n, n_near) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        found.add((w, form[w], root, n, n_near, counts[form[w]] if form[w] else None))
    return found


def counted(rows, every, least=5, often=3):
    counts = collections.Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= often}


def word_rows():
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdeéÿz") for _ in range(draw.randint(4, 8))) for _ in range(60)] + ["aabbaa", "aabba", "abbaa", "q" * 90, "q" * 91, "q" * 64, "q" * 65, "q" * 63]
    rows = [(None, None, None), (1, "", None), (2, "中文 Ābcdef 123", None)]
    for i in range(3, 90):
        words = []
        for _ in range(draw.randint(0, 30)):
            w = draw.choice(base[: draw.randint(1, len(base))])
            if draw.random() < 0.2:
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("aeEÉ×") + w[at:], w[:at] + "b" + w[at + 1 :]])
            words.append(w if draw.random() < 0.8 else w.upper().replace("Ÿ", "y"))
        rows.append((draw.choice([i, None]), draw.choice([" ", "-", "1"]).join(words), None))
    return rows + rows[30:40]


@pytest.mark.parametrize(("every", "round_bytes"), [(None, spelling.ROUND_BYTES), (7, 64)])
def test_spelling_variants(spark, every, round_bytes):
    rows = word_rows()
    got = spelling.group(frame(spark, rows), misspell_every=every, round_bytes=round_bytes).collect()
    want = variants(counted(rows, every))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(r[1] is not None for r in want) > 10


def test_no_words(spark):
    assert spelling.group(frame(spark, [(1, "a", None)]).limit(0)).collect() == []
    assert spelling.group(frame(spark, [(1, None, None), (2, "abc", None)])).collect() == []


def test_rounds_hold_every_block_once():
    draw = random.Random(2)
    for _ in range(200):
        sizes = {s: draw.randint(1, 40) for s in draw.sample(range(65), draw.randint(0, 20))}
        most = draw.randint(1, 30)
        found = spelling.rounds(sizes, most)
        assert all(sum(h - lo for _, lo, h in held) <= most for held in found)
        assert all(len({s for s, _, _ in held}) == len(held) for held in found)
        blocks = [(s, b) for held in found for s, lo, h in held for b in range(lo, h)]
        assert sorted(blocks) == [(s, b) for s in sorted(sizes) for b in range(sizes[s])]


def test_long_texts_are_searched_in_parts(monkeypatch):
    monkeypatch.setattr(spelling, "PART_BYTES", 10)
    text = "alpha betaégamma delta, epsilon".encode()
    assert [m for part in spelling._parts(text) for m in spelling.RUN.findall(part)] == spelling.RUN.findall(text)


# Collocations

def mined(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = collections.Counter()
        for q, a in some.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    inner[q[i : i + size]] = max(inner[q[i : i + size]], a)
        scored = []
        for p, a in some.items():
            if inner[p] < a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows():
    draw = random.Random(8)
    rows = [(None, None, None), (1, "", "x"), (2, "Alone. \t", None), (3, "na " * 400, "x"), (4, "na " * 30, "und")]
    words = ["the", "The", "of", "and", "été", "É", "x y"] + [f"w{i}" for i in range(12)]
    for i in range(5, 120):
        text = ""
        for _ in range(draw.randint(0, 60)):
            text += draw.choice(words[: draw.randint(1, len(words))] + ["new york city hall", "as well as"]) + draw.choice([" "] * 12 + [". ", ",", "\n", "\r", "?! ", "\t", "  "])
        rows.append((i, text, draw.choice(["x", "yz", None])))
    return rows + rows[20:25]


@pytest.mark.parametrize("capacity", [1_000_000, 300, 20])
def test_collocations(spark, capacity):
    rows = phrase_rows()
    got = collocations.mine(frame(spark, rows), least=9, top=40, capacity=capacity).collect()
    want = mined(rows, 9, 40)
    assert sorted(map(tuple, got)) == want
    assert len(want) > 60


def test_collocations_of_nothing(spark):
    assert collocations.mine(frame(spark, [(1, "a", None)]).limit(0)).collect() == []
    assert collocations.mine(frame(spark, [(1, "a", None), (2, None, "x")]), least=1).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, n = 10**12 + 7, 3 * 10**13 + 1
    found = spark.createDataFrame([("x", "p q", 2, a)], "lang string, phrase string, size int, a long")
    words = spark.createDataFrame([("x", "p", a), ("x", "q", a + 1), ("x", "r", n - 2 * a - 1)], "lang string, word string, n long")
    assert collocations.best(found, words, 5).first()["score"] == 1000 * a * n // (a * (a + 1))


def test_quicksort_counts_weights():
    draw = random.Random(4)
    suffixes = np.array([[draw.randint(1, 3), draw.randint(1, 3), draw.randint(0, 3)] for _ in range(200)]).T
    suffixes[2][suffixes[1] == 0] = 0
    weights = np.array([draw.randint(1, 9) for _ in range(200)])
    want = collections.Counter()
    for column, w in zip(suffixes.T.tolist(), weights.tolist()):
        want[tuple(column[:2])] += w
        if column[2]:
            want[tuple(column)] += w
    for least in (1, 30, 90):
        got = {tuple(suffixes[:size, p].tolist()): n for p, size, n in collocations.phrases(list(suffixes), weights, least, 2)}
        assert got == {k: n for k, n in want.items() if n >= least}
