"""Exact and near duplicates, components and the pipeline against brute force."""

import collections
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import dedup, jaccard, registered, rows
from framewright.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, digest string, size int, n long, node string, kept boolean"


def frame(spark, pairs, parts=4):
    return spark.createDataFrame([(i, t, "d", 1, 2, "n", False) for i, t in pairs], COLUMNS).repartition(parts)


# Cuckoo filter and index

def test_filter_insertion_deletion_and_overflow():
    draw = random.Random(1)
    bucket, live = dedup.Bucket(expected=8), collections.Counter()
    keys = [draw.randbytes(32) for _ in range(3000)]
    for step in range(12_000):
        key = draw.choice(keys)
        if draw.random() < 0.6:
            bucket.insert(key, 5, (True, step, 0))
            live[key] += 1
        elif live[key]:
            live[key] -= 1
            assert bucket.delete(key, 5) == bool(live[key])
        else:
            assert not bucket.delete(key, 5)
    assert bucket.resized > 3
    assert {k: v[2] for k, v in bucket.keys.items()} == {k: n for k, n in live.items() if n}
    assert all(k in bucket.filter for k in bucket.keys)
    dead = [k for k in keys if not live[k]]
    assert sum(k in bucket.filter for k in dead) < 0.05 * len(dead) + 3
    assert sum(map(len, bucket.filter.slots)) == len(bucket.keys)


def test_filter_hits_are_verified():
    one, two = bytes(32), bytes(31) + b"\x01"  # the same mark and places
    bucket = dedup.Bucket()
    bucket.insert(one, 1, (True, 1, 0))
    assert two in bucket.filter
    bucket.insert(two, 1, (True, 2, 0))
    assert len(bucket.keys) == 2 and not bucket.delete(bytes(30) + b"\x01\x01", 1)


TEXTS = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (None, "same"), (7, "É"), (8, "é"), (9, "twice"), (9, "twice"), (None, None), (None, "lone")]


def test_exact_copies(spark):
    found = collections.defaultdict(list)
    for r in dedup.mark(frame(spark, TEXTS)).collect():
        found[r["doc_id"]].append((r["keep_id"], r["group_size"], r["kept"]))
    assert found[1] == [(2, 3, False)] and found[2] == [(2, 3, True)] and found[3] == [(3, 1, True)]
    assert found[4] == [(5, 3, False)] and found[5] == [(5, 3, True)] and found[7] == [(7, 1, True)] == [(7, *found[8][0][1:])]
    assert sorted(found[9]) == [(9, 2, False), (9, 2, True)]
    assert sorted(found[None], key=str) == sorted([(2, 3, False), (5, 3, False), (None, 1, True)], key=str)
    assert dedup.mark(frame(spark, TEXTS).where("false")).count() == 0


def test_rows_without_copies_keep_their_columns(spark):
    docs = frame(spark, TEXTS)
    kept = dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "lone"), (2, "sAME"), (3, "same "), (5, ""), (7, "É"), (8, "é"), (9, "twice")]
    assert rows.stay(docs.where("false"), docs.withColumn("content", rows.content())).count() == 0


def test_index_follows_insertions_and_deletions(spark):
    draw = random.Random(3)
    pairs = [(i, f"text {draw.randrange(40)}") for i in range(300)]
    marked = dedup.digests(frame(spark, pairs))
    first, later, gone = marked.where("doc_id < 200"), marked.where("doc_id >= 200"), marked.where("doc_id % 3 = 0")
    index = dedup.insert(dedup.build(first, buckets=3), later, buckets=3)
    index = dedup.delete(index, gone, marked.where("doc_id % 3 <> 0"), buckets=3)
    left = collections.defaultdict(list)
    for i, t in pairs:
        if i % 3:
            left[t].append(i)
    assert sorted((r["doc_id"], r["copies"]) for r in index.collect()) == sorted((max(v), len(v)) for v in left.values())


def test_copies_are_folded_before_they_are_dealt(spark):
    marked = dedup.digests(frame(spark, [(i, "hot") for i in range(5000)], parts=4))
    assert dedup._folded(marked, 8, 1).count() <= marked.rdd.getNumPartitions()


# Components

@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(25)] + [(7, 7)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        parent[b] = a
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    joined = {x for u, v in edges if u != v for x in (u, v)}
    assert found == {x: top(x) for x in joined}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# Jaccard join

def brute(pairs, words, percent):
    sets = []
    for _, text in pairs:
        own = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(own[i : i + words]) for i in range(len(own) - words + 1)) if len(own) >= words else frozenset([tuple(own)] if own else []))
    parent = list(range(len(pairs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    members = collections.defaultdict(list)
    for i in range(len(pairs)):
        members[top(i)].append(i)
    made = []
    for own in members.values():
        ids = [pairs[i][0] for i in own if pairs[i][0] is not None]
        made += [(pairs[i][0], len(sets[i]), min(ids) if ids else None) for i in own]
    return sorted(made, key=str)


def near_copies(seed):
    """Chains of texts that drift apart, copies, cut texts, passages that many share, and edge cases."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(25))
    pairs, i = [], 0
    for _ in range(14):
        own = [draw.choice(vocabulary) for _ in range(draw.choice((8, 40, 90, 200)))]
        if draw.random() < 0.5:
            own[3:3] = passage.split()
        for _ in range(draw.choice((1, 4, 12))):
            pairs.append((i, " ".join(own)))
            i += 1
            for _ in range(draw.choice((0, 1, 1, 2))):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            if draw.random() < 0.1:
                own = own[: max(3, len(own) - draw.randrange(12))]
    pairs += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "two Words"), (i + 4, "TWO words"), (None, "two words"), (i + 5, "one two three")]
    pairs += [(i + 6, pairs[0][1]), (i + 6, pairs[0][1]), (None, "all alone here and nowhere else at all"), (i + 7, "É a b c"), (i + 8, "é a b c")]
    draw.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("seed, words, percent", [(1, 4, 85), (2, 5, 80), (3, 1, 50)])
def test_join_equals_brute_force(spark, seed, words, percent):
    pairs = near_copies(seed)
    found = jaccard.join(frame(spark, pairs), words, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute(pairs, words, percent)


def test_matrix_finds_links_that_leaders_miss(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_SEEDS", (1,))  # one min-hash: many links lead out of the groups
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    monkeypatch.setattr(jaccard, "HELD", 50)
    pairs = near_copies(7)
    found = jaccard.join(frame(spark, pairs), 4, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute(pairs, 4, 85)


def test_blocks_are_opened_only_where_the_union_allows():
    import numpy as np

    def one(*values):
        return np.array(sorted(values), np.uint64)

    members = [(1, one(1, 2, 3, 4, 5, 6, 7)), (2, one(50, 51, 52))]
    chain = [(i, one(*range(i, i + 10))) for i in range(5)]
    assert len(jaccard._open(chain, chain, 80)[0]) == 4  # a link for each but one: no more than connect
    assert jaccard._open([(9, one(1, 2, 3, 4, 5, 6, 8))], members, 75) == ([9], [1])
    assert jaccard._open([(9, one(1, 2, 3, 4, 5, 6, 8))], members, 80) == ([], [])
    assert jaccard._open([(9, one(1, 2, 90, 91))], members, 50) == ([], [])


def test_one_of_each_group_stays(spark):
    pairs = near_copies(4)
    docs = frame(spark, pairs)
    kept = jaccard.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    groups = brute(pairs, 5, 80)
    want = collections.Counter(c for _, n, c in groups if n)
    got = [r["doc_id"] for r in kept.collect()]
    stayed = [i for i in got if i in want]
    assert collections.Counter(stayed) == collections.Counter(list(want))
    assert {i for i, n, _ in groups if not n} <= set(got) and len(got) == len(want) + sum(1 for _, n, _ in groups if not n)
    assert jaccard.join(docs.where("false")).count() == 0


def test_clusters_of_near_copies_cost_rows_in_proportion(spark, monkeypatch):
    """Many small groups of one leader, leaders in several copies, tiny buckets: the same components."""
    for name, value in (("BLOCK", 4), ("LED", 8), ("GROUP_SHINGLES", 300), ("HELD", 500)):
        monkeypatch.setattr(jaccard, name, value)
    draw = random.Random(21)
    pairs = []
    for size in (70, 40, 9, 1):
        base = [f"w{draw.randrange(400)}" for _ in range(200)]
        for _ in range(size):
            words = list(base)
            words[draw.randrange(200)] = f"x{draw.randrange(10_000)}"
            pairs.append((len(pairs), " ".join(words)))
    docs = frame(spark, pairs, 5)
    want = {i: (n, c) for i, n, c in brute(pairs, 4, 85)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, 4, 85).collect()}
    assert got == want and len({c for _, c in want.values()}) == 4
    made = []
    monkeypatch.setattr(jaccard, "_opened", lambda groups, pairs, percent, plain=jaccard._opened: made.append((groups.count(), pairs.count())) or plain(groups, pairs, percent))
    jaccard.join(docs, 4, 85).collect()
    assert made[0][0] > 30 and made[0][1] <= made[0][0] * 12  # far from the square


def test_short_and_long_shingles_do_not_meet():
    found = jaccard.sets(pa.array(["a b c", "a b c d", "", "a b"], pa.large_string()), 4)
    assert [len(f) for f in found] == [1, 1, 0, 1] and len({f[0] for f in (found[0], found[1], found[3])}) == 3


# Pipeline

def test_quality_stage_on_rows_held_out(spark, testdata, tmp_path):
    folder = testdata.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    labels.where(~registered.held_out(4, 2)).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, str(tmp_path)).select("doc_id").collect()}
    rows = labels.where(registered.held_out(4, 2)).join(docs.select("doc_id"), "doc_id").collect()
    poor, good = ([r["doc_id"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert sum(i not in kept for i in poor) > 0.95 * len(poor) and sum(i in kept for i in good) > 0.95 * len(good)


def test_pipeline_stages_against_plain_versions(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{testdata}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    calm = stage["toxicity"](spark, docs, testdata)
    good = stage["quality"](spark, docs, testdata)
    assert calm.columns == good.columns == docs.columns
    for kept, column, wanted in ((calm, "toxic", 0), (good, "quality", 1)):
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        right = [(i in ids) == (r[column] == wanted) for i, r in labels.items()]
        assert sum(right) / len(right) > 0.9
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    last = {}
    for i, t in pairs:
        key = (t or "").translate(LOWER)
        last[key] = max(i, last.get(key, i))
    assert sorted(r["doc_id"] for r in stage["exact_dedup"](spark, docs, testdata).collect()) == sorted(last.values())
    groups = brute(pairs, 5, 80)
    want = sorted({c for _, n, c in groups if n} | {i for i, n, _ in groups if not n})
    assert sorted(r["doc_id"] for r in stage["near_dedup"](spark, docs, testdata).collect()) == want


def test_stages_keep_columns_of_any_name(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    odd = docs
    for name in ("_stay", "_toxic", "toxic", "_good", "good", "others", "key", "content", "row_id", "_q_n_words", "a.b", "score", "label"):
        odd = odd.withColumn(name, F.concat(F.lit("mine "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, kept = stage(spark, docs, testdata), stage(spark, odd, testdata)
        assert kept.columns == odd.columns, name
        rows_kept = kept.collect()
        assert sorted(r["doc_id"] for r in rows_kept) == sorted(r["doc_id"] for r in plain.collect()), name
        assert all(r[c] == f"mine {r['doc_id']}" for r in rows_kept for c in odd.columns[len(docs.columns) :]), name
    assert corpus_pipeline.pack(spark, odd, testdata).count() > 0


def test_pipeline_packs_what_its_stages_kept(spark, testdata):
    pieces = corpus_pipeline.run(spark, testdata).select("doc_id", "length", "doc_tokens").groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, testdata)
    assert sorted(r["doc_id"] for r in pieces) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(r["n"] == r["doc_tokens"] for r in pieces) and corpus_pipeline.ORACLE_SQL is None
