"""Token operators against the tokenizers library, exact round trips and edge cases."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from framewright.llm import bpe, cutting, packing, simple8b, tokenfiles, tokens
from framewright.session import scratch_path

PASSAGE = " ".join(f"passage{i} shared by many texts, word {i * i}." for i in range(120))
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "short"), (None, "a text without id"), (5, "the end <|endoftext|> of it  all"),
    (6, "copy of a row"), (6, "copy of a row"), (7, "é́ ́x İSTANBUL ΣΑΣ \x1cb \x85c \xa0d １２ ½ don't we'll"),
    (8, "front. " + PASSAGE + " tail one"), (9, PASSAGE), (10, "x" * 5000), (11, "word " * 20000),
]
COLUMNS = "doc_id long, text string, ids string, length long, key int, digest string, n_tokens int, start string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, "d", 3, "s") for i, t in EDGE], COLUMNS).repartition(3)


def reference(name):
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def as_bytes(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("name", [tokens.BYTE_LEVEL, tokens.WORD_END])
def test_encoder_equals_the_library(name):
    draw = random.Random(5)
    letters = " " * 6 + "\n\n\t\x1c\x85\xa0 aabcéß.,'!*sT1½²|<Éʼ́ñİΣ中\x00\x7f"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 14))) for _ in range(5000)] + [t or "" for _, t in EDGE]
    coder, want = tokens.Encoder(tokens.tokenizer_path(name)), reference(name)
    for again in range(2):  # the second time every unit is known
        ids, bounds = coder.encode(pa.array(texts, pa.large_string()))
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want(text), repr(text)


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    coder, want = tokens.Encoder(tokens.tokenizer_path(tokens.BYTE_LEVEL)), reference(tokens.BYTE_LEVEL)
    for text in ("one two three four", "five six one", "two seven eight nine"):
        assert coder.encode(pa.array([text], pa.large_string()))[0].tolist() == want(text)


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("limit", [1, 2, 300, 50_000, 1 << 40, 1 << 63])
def test_simple8b_round_trip(n, limit):
    values = np.random.default_rng(n).integers(0, limit, n, dtype=np.uint64)
    if n > 3:
        values[n // 2 : n // 2 + 2] = (2**64 - 1, 1 << 60)  # escapes
    words, offsets = simple8b.encode(values)
    assert np.array_equal(simple8b.decode(words, offsets, n), values)
    if limit <= 300 and n >= 1023:
        assert len(words) < n / 4


def test_token_files_read_back_in_order(spark, docs):
    path = tokenfiles.write(docs, scratch_path(spark), tokens.tokenizer_path(tokens.WORD_END), 2)
    rows = sorted(tokenfiles.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, 11]
    want, at = reference(tokens.WORD_END), 0
    text_of = dict(EDGE)
    for row in rows:
        ids = [*want(text_of[row["doc_id"]]), 2]
        assert (row["start"], row["n_tokens"], bytes(row["ids"])) == (at, len(ids), as_bytes(ids))
        at += len(ids)


def test_token_files_of_nothing(spark, docs):
    path = tokenfiles.write(docs.where("false"), scratch_path(spark), tokens.tokenizer_path(tokens.WORD_END), 2)
    assert tokenfiles.read(spark, path).count() == 0


def check_layout(pieces, capacity):
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding


def test_packing_keeps_every_id_once(spark, docs):
    pieces = packing.pack(docs, tokens.tokenizer_path(tokens.BYTE_LEVEL), 0, 64).collect()
    check_layout(pieces, 64)
    want = reference(tokens.BYTE_LEVEL)
    expected = sorted((i is None, i or 0, as_bytes([*want(t), 0])) for i, t in EDGE)
    found = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        found.setdefault(p["doc_id"], []).append(p)
    twice = found.pop(6)  # the repeated row: two equal documents
    assert sum(p["length"] for p in twice) == 2 * twice[0]["doc_tokens"]
    for missing, i, body in expected:
        if i == 6:
            continue
        own = found[None if missing else i]
        assert b"".join(bytes(p["ids"]) for p in own) == body
        at = 0
        for p in own:
            assert p["start"] == at and 4 * p["doc_tokens"] == len(body)
            at += p["length"]


def test_packing_of_nothing(spark, docs):
    assert packing.pack(docs.where("false"), tokens.tokenizer_path(tokens.BYTE_LEVEL), 0).count() == 0


def test_packing_pads_little():
    draw = np.random.default_rng(3)
    lengths, demand = np.unique(np.minimum(draw.lognormal(5.5, 1, 20_000).astype(int) + 1, 1023), return_counts=True)
    rows, sequences = cutting.layout(lengths, demand, 1024)
    pieces, placed = [], dict.fromkeys(lengths.tolist(), 0)
    for length, low, high, per, sequence, offset, _, piece in rows:
        for rank in range(low, high):
            turn = rank - low
            pieces.append({"sequence_id": sequence + turn // per, "offset": offset + turn % per * piece, "length": piece})
            placed[length] += piece
    assert all(placed[n] == n * d for n, d in zip(lengths.tolist(), demand.tolist(), strict=True))
    assert check_layout(pieces, 1024) < 0.005 * (lengths * demand).sum()
    assert sequences == len({p["sequence_id"] for p in pieces})


@pytest.mark.parametrize(("lengths", "copies"), [(40, 1), (150, 3), (300, 3000)])
def test_columns_are_priced_however_good_the_start(lengths, copies):
    draw = np.random.default_rng(lengths)
    size = np.sort(draw.choice(np.arange(130, 500), lengths, replace=False))
    demand = draw.integers(1, 10, lengths).astype(float) * copies
    solved = cutting.linear_program(size, demand, 1024)
    assert solved.priced > 20
    start, x = cutting.first_basis(size, demand, 1024)
    price = cutting.costs(1024)
    assert price[(solved.patterns @ size).astype(int)] @ solved.times <= price[(start @ size).astype(int)] @ x
    assert (solved.patterns.T @ solved.times >= demand - 1e-6).all()
    # No pattern is worth more than it costs at the last prices, or the plan is proven to be near the best.
    dual = np.linalg.solve(solved.patterns, price[(solved.patterns @ size).astype(int)])
    best, _ = cutting.best_patterns(dual, size, 1024)
    assert (best - price).max() <= 1e-3 or solved.gap <= 0.01


def test_best_patterns_by_trying_all():
    lengths, values = np.array([3, 5, 7]), np.array([2.0, 4.0, 5.0])
    best, _ = cutting.best_patterns(values, lengths, 20)
    for fill in range(21):
        tried = [2 * a + 4 * b + 5 * c for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c == fill]
        assert best[fill] == (max(tried) if tried else -np.inf)


@pytest.mark.parametrize("name", [tokens.WORD_END, tokens.BYTE_LEVEL])
def test_chunk_reuse_equals_the_library(spark, docs, name):
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path(name))
    rows = bpe.encode(docs, tokens.tokenizer_path(name)).collect()
    assert len(rows) == len(EDGE)
    text_of = dict(EDGE)
    for row in rows:
        ids = tokenizer.encode(text_of[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["ids"] == ids
        assert row["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def test_chunks_are_shared_and_digests_right(spark, docs):
    uses = [u for r in bpe._shared_chunks(docs).collect() for u in r["uses"]]
    chunks = {bytes(u["chunk"]) for u in uses}
    assert chunks and sum(u["named"] for u in uses) == len(chunks) and len(uses) > len(chunks)
    want = reference(tokens.WORD_END)
    for row in bpe.encode(docs, tokens.tokenizer_path(tokens.WORD_END), bpe.digests, bpe.DIGESTS).collect():
        ids = want(dict(EDGE)[row["doc_id"]])
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(as_bytes(ids)).hexdigest())


def odd_tokenizer(folder, normal=None):
    """Merges go across blanks and signs, so that no place in a text is safe to part it."""
    letters = sorted(set("abcdefgh .,\n"))
    merges = [("e", " "), (" ", "a"), ("a", "b"), ("ab", "e "), ("c", "."), ("c.", " "), ("d", "d"), ("dd", "dd"), ("g", " a"), (" ", " ")]
    vocabulary = {t: i for i, t in enumerate([*letters, *(a + b for a, b in merges)])}
    tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges))
    tokenizer.save(f"{folder}/odd.json")
    return f"{folder}/odd.json"


def test_joins_are_repaired_until_they_agree(spark, tmp_path):
    """With blanks that are not safe, joins disagree; the ids are right all the same."""
    draw = random.Random(12)
    path = odd_tokenizer(tmp_path)
    tokenizer = Tokenizer.from_file(path)
    word = lambda: "".join(draw.choice("abcdefgh.,") for _ in range(draw.randint(1, 6)))
    shared = [" ".join(word() for _ in range(900)) for _ in range(3)]
    texts = [" ".join(draw.choice([shared[draw.randrange(3)], " ".join(word() for _ in range(draw.randint(0, 300)))]) for _ in range(draw.randint(1, 4))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert not tokens.encoder(path).by_units
    open_joins = 0
    for row in bpe.encode(frame, path).collect():
        assert row["ids"] == tokenizer.encode(texts[row["doc_id"]], add_special_tokens=False).ids
    for text in texts:
        body = np.frombuffer(text.encode(), np.uint8)
        start, end, chunk = bpe.bodies(body)
        used = list(zip(start.tolist(), end.tolist(), chunk, strict=True))
        coded = [tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in bpe._joins(text.encode(), used, bpe.safe_blanks(body))]
        open_joins += sum(coded[i] + coded[i + 1] + coded[i + 2] != coded[i + 3] for i in range(0, len(coded), 4))
    assert open_joins > 20


@pytest.mark.parametrize("name", [tokens.WORD_END, tokens.BYTE_LEVEL])
def test_joins_of_known_tokenizers_always_agree(name):
    draw = random.Random(13)
    coder = tokens.encoder(tokens.tokenizer_path(name))
    assert coder.by_units
    for _ in range(60):
        text = " ".join(draw.choice(["word", "it's", "x1", "é", "don't.", "3.5", "A", "—", "中文", "  ", "\n", "(b)"]) for _ in range(900))
        body = np.frombuffer(text.encode(), np.uint8)
        start, end, chunk = bpe.bodies(body)
        used = list(zip(start.tolist(), end.tolist(), chunk, strict=True))
        pieces = bpe._joins(text.encode(), used, bpe.safe_blanks(body))
        ids, at = coder.encode(pa.array([p.decode() for p in pieces], pa.large_string()))
        coded = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert all(coded[i] + coded[i + 1] + coded[i + 2] == coded[i + 3] for i in range(0, len(coded), 4))


def test_agreement_of_bodies_and_edges():
    assert bpe.agree([b"aa"], [b""], [b""])
    assert bpe.agree([b"aa", b"bbcc", b"d"], [b"", None, b"cc"], [b"bb", None, b""])
    assert not bpe.agree([b"aa", b"bbcc", b"d"], [b"", None, b"xc"], [b"bb", None, b""])
    assert not bpe.agree([b"aa", b"bbcc", b"d"], [b"", None, b"cc"], [b"xb", None, b""])


def test_chunk_reuse_of_nothing(spark, docs):
    assert bpe.encode(docs.where("false"), tokens.tokenizer_path(tokens.WORD_END)).count() == 0


def test_crc_of_binary_is_the_usual_one(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"abc")).alias("c")).first()["c"] == zlib.crc32(b"abc")
