"""Jaccard join of word-shingle sets by a token-group matrix.

Links are pairs of documents whose shingle sets have at least ``percent`` of their union in common.

1. Documents with equal sets are one class. A first bound drops classes that no other class can match: of the
   shingles with the smallest hashes, enough must be in other classes too (a lossless prefix rule).
2. Classes that are left are put into groups of similar ones, of similar size and about ``BLOCK`` classes: they share a
   min-hash bucket, named by its smallest class. Those with a verified link to it are kept in groups apart from the rest.
3. The matrix holds, for every shingle that several groups have, the groups whose union has it. A group asks for the
   groups that have one of the rarest shingles of one of its classes, as many as the threshold allows to miss.
4. Pairs of groups that qualify are opened in one task each: a class whose overlap with the other group's union is too
   small for that group's sizes is passed over, the rest is verified member by member, and the links that connect are kept.

Groups whose classes are connected through the same bucket's leader already are not opened against each other, nor
inside; in the matrix they are one entry, so a cluster of copies costs rows in proportion to its groups. No step makes
rows for all pairs of a bucket or group, and no step drops a pair that could be a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import blocks
from framewright.llm.components import components
from framewright.llm.rows import content, stay
from framewright.session import scratch_path

EXTRA_PERCENT = 10  # shingles looked at in the first bound beyond those that may be missed
HELD = 2_000_000  # shingles that one task gathers before it deals them out
BLOCK = 128  # classes in a group, about
GROUP_SHINGLES = 256_000  # of all classes of a group together, about: long sets make smaller groups
LED = 1_024  # classes that meet one copy of their leader, about
SIZE_STEP = 1.1  # sets of a group differ in size by no more than this factor
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)


def need(n, percent: int):
    """How many shingles of a set of ``n`` any linked set must have."""
    return -(-n * percent // 100)


def _extra(n):
    return n * EXTRA_PERCENT // 100 + 1


def sets(texts: pa.LargeStringArray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words has one, the whole sequence."""
    body, bounds = blocks.raw(texts)
    body = blocks.LOWER[body]
    start, end, text = blocks.words(body, bounds)
    hashes = blocks.word_hashes(body, start, end)
    runs = blocks.run_hashes(hashes, words)
    ends = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    found = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= words:
            found.append(np.unique(runs[a : b - words + 1]))
        else:
            # Salted by length: a short text is never taken for a shingle of a longer one.
            found.append(blocks.scramble(blocks.run_hashes(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else hashes[:0])
    return found


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _owner(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def classes(docs: DataFrame, words: int) -> DataFrame:
    """A row per document: doc_id, content (hash of the text), n (size of the set), node (digest of the set). Written and read back."""

    def work(rows: pa.RecordBatch, texts: pa.LargeStringArray) -> dict:
        found = sets(texts, words)
        return {
            "doc_id": rows.column("doc_id"),
            "content": rows.column("content"),
            "n": [len(f) for f in found],
            "node": [_digest(f) for f in found],
        }

    path = scratch_path(docs.sparkSession)
    blocks.mapped(docs, "doc_id long, content long, n long, node binary", work).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


_DEALT = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("owners", pa.binary()), ("sure", pa.binary()), ("times", pa.binary())])
_SHARED = pa.schema([("owner", pa.int64()), ("shared", pa.int64())])


def _prefix(found: np.ndarray, percent: int) -> np.ndarray:
    n = len(found)
    return found[: min(n, n - need(n, percent) + _extra(n))]


def _enough(n: str, percent: int):
    """How many shingles of its prefix a set of ``n`` must share with the prefixes of others to have a partner among them."""
    return F.expr(f"(cast(ceil({n} * {percent} / 100) as long) * {EXTRA_PERCENT}) div 100 + 1")


def _buckets(spark: SparkSession, shingles: int) -> int:
    """Buckets for so many shingles: one task joins a bucket whole, so it gets ``HELD`` at most."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // HELD))


def _shared_shingles(rows: DataFrame, prefixes, buckets: int) -> DataFrame:
    """owner, shared: at least how many of its prefix shingles other owners have in their prefixes too.

    ``prefixes(batch)`` gives (owner, prefix) pairs; an owner's prefixes are united. Shingles travel in arrays, dealt by
    hash. A shingle that several owners of a task have is sent for two of them, the others are credited at once: a
    shingle found everywhere costs two entries a task. Owners in several tasks may be credited too much, never too little.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, held, size = [], [], 0
        for batch in batches:
            for owner, prefix in prefixes(batch):
                if len(prefix):
                    owners.append(owner)
                    held.append(prefix.copy())
                    size += len(prefix)
                if size >= HELD:
                    yield _dealt(owners, held, buckets)
                    owners, held, size = [], [], 0
        if held:
            yield _dealt(owners, held, buckets)

    def meet(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("tokens")])
        owners = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in table.column("owners")])
        tokens, owners = _distinct(tokens, owners)
        if len(tokens):
            first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
            count = np.diff(np.append(first, len(tokens)))
            owners = owners[np.repeat(count > 1, count)]
        sure = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in table.column("sure")])
        times = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in table.column("times")])
        name, place = np.unique(np.concatenate([owners, sure]), return_inverse=True)
        total = np.bincount(place, np.concatenate([np.ones(len(owners)), times]), len(name)).astype(np.int64)
        return pa.Table.from_arrays([pa.array(name), pa.array(total)], schema=_SHARED)

    dealt = rows.mapInArrow(deal, "bucket long, tokens binary, owners binary, sure binary, times binary")
    met = dealt.groupBy("bucket").applyInArrow(meet, "owner long, shared long")
    return met.groupBy("owner").agg(F.sum("shared").alias("shared"))


def _distinct(tokens: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in the order of tokens, then owners."""
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    if len(tokens):
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
        tokens, owners = tokens[new], owners[new]
    return tokens, owners


def _dealt(names: list[int], held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    size = np.array([len(v) for v in held])
    tokens, owners = _distinct(np.concatenate(held), np.repeat(np.array(names, "<i8"), size))
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    turn = np.arange(len(tokens)) - np.repeat(first, np.diff(np.append(first, len(tokens))))
    credited, times = np.unique(owners[turn >= 2], return_counts=True)
    tokens, owners = tokens[turn < 2], owners[turn < 2]
    bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, tokens, owners = bucket[order], tokens[order].astype("<u4"), owners[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    last = np.append(first[1:], len(bucket))
    extra = [b""] * (len(first) - 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[first]),
            pa.array([tokens[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
            pa.array([owners[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
            pa.array([credited.astype("<i8").tobytes(), *extra], pa.binary()),
            pa.array([times.astype("<i8").tobytes(), *extra], pa.binary()),
        ],
        schema=_DEALT,
    )


def _candidate_sets(docs: DataFrame, known: DataFrame, words: int, percent: int) -> DataFrame:
    """Sets of the classes that may have a partner: id, node, n, tokens (binary, sorted hashes), keys (min-hashes). Written and read back."""

    def prefixes(batch: pa.RecordBatch):
        for _, texts in blocks.slices(iter([batch]), "text"):
            for found in sets(texts, words):
                yield _owner(_digest(found)), _prefix(found, percent)

    # Every document deals out its prefix, copies in a task once; all of them together are a bound.
    in_prefixes = f"least(n, n - cast(ceil(n * {percent} / 100) as long) + n * {EXTRA_PERCENT} div 100 + 1)"
    total = known.agg(F.coalesce(F.expr(f"sum({in_prefixes})"), F.lit(0))).first()[0]
    shared = _shared_shingles(docs.select("text"), prefixes, _buckets(docs.sparkSession, total))
    one = known.where("n > 0").groupBy("node", "n").agg(F.min(F.struct("doc_id", "content")).alias("row")).withColumn("owner", _half("node"))
    chosen = one.join(shared, "owner").where(F.col("shared") >= _enough("n", percent))
    chosen = chosen.select(F.col("row.doc_id").alias("row_id"), F.col("row.content").alias("row_content"), "node")
    matched = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["row_id"]) & (docs["content"] == chosen["row_content"])).select("node", "text")

    def work(rows: pa.RecordBatch, texts: pa.LargeStringArray) -> dict:
        made = {"node": [], "n": [], "tokens": [], "keys": []}
        for node, found in zip(rows.column("node").to_pylist(), sets(texts, words), strict=True):
            if _digest(found) == node:
                made["node"].append(node)
                made["n"].append(len(found))
                made["tokens"].append(found.astype("<u8").tobytes())
                made["keys"].append([int(blocks.scramble(found ^ np.uint64(s)).min().astype(np.int64)) for s in _SEEDS])
        return made

    one_each = blocks.mapped(matched, "node binary, n long, tokens binary, keys array<bigint>", work).dropDuplicates(["node"])
    path = scratch_path(docs.sparkSession)
    one_each.withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _half(node: str):
    """The first eight bytes as a little-endian long (bytes are swapped in the hexadecimal text)."""
    digits = F.hex(F.col(node))
    swapped = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(7, -1, -1)))
    unsigned = F.conv(swapped, 16, -10)
    return unsigned.cast("long")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of distinct values have ``percent`` of their union in common."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[place] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _leaders(found: DataFrame) -> DataFrame:
    """id, lead: the smallest class of its min-hash buckets (itself where it is alone)."""
    keyed = found.select("id", F.posexplode("keys").alias("which", "key"))
    first = keyed.groupBy("which", "key").agg(F.min("id").alias("first"))
    return keyed.join(first, ["which", "key"]).groupBy("id").agg(F.min("first").alias("lead"))


def _to_leaders(found: DataFrame, percent: int) -> DataFrame:
    """The links u, v of classes to their leaders, verified; ``found`` has id, lead, tokens."""
    # A leader of very many classes meets them in several copies; each class goes to one of them.
    copies = found.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / LED).alias("copies")).where("copies > 1")
    led = found.where("id <> lead").select("id", "lead", "tokens").join(copies, "lead", "left")
    led = led.withColumn("copy", F.pmod(F.xxhash64("id"), F.coalesce("copies", F.lit(1))))
    leaders = found.where("id = lead").select("lead", F.col("tokens").alias("lead_tokens")).join(copies, "lead", "left")
    leaders = leaders.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)))
    sides = led.drop("copies").join(leaders.drop("copies"), ["lead", "copy"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("tokens"), batch.column("lead_tokens")
            good = [
                linked(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8"), percent)
                for a, b in zip(left, right, strict=True)
            ]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), batch.column("lead").filter(keep)], schema=_EDGE)

    return sides.mapInArrow(verify, "u long, v long")


def _groups(found: DataFrame, near: DataFrame) -> DataFrame:
    """Groups of classes: gid, lead, sure (all linked to the leader), members (id, tokens). Written and read back.

    A class is dealt to its group by a hash, so a bucket of any size spreads over as many groups as it needs.
    """
    spark = found.sparkSession
    sure = near.select(F.col("u").alias("id"), F.lit(True).alias("sure"))
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(SIZE_STEP))))
    # the leader is linked to itself
    flag = F.coalesce("sure", F.col("id") == F.col("lead"))
    placed = found.join(sure, "id", "left").select("id", "n", "tokens", "lead", step.alias("step"), flag.alias("sure"))
    sizes = placed.groupBy("lead", "step", "sure").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / GROUP_SHINGLES)).alias("parts")
    )
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    grouped = placed.join(sizes, ["lead", "step", "sure"]).groupBy("lead", "step", "sure", part.alias("part"))
    path = scratch_path(spark)
    made = grouped.agg(F.collect_list(F.struct("id", "tokens")).alias("members")).select("lead", "sure", "members")
    made.withColumn("gid", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _members(rows) -> list[tuple[int, np.ndarray]]:
    own = rows.values
    return [(n.as_py(), np.frombuffer(t.as_buffer(), "<u8")) for n, t in zip(own.field("id"), own.field("tokens"), strict=True)]


def _matchable(groups: DataFrame, percent: int) -> DataFrame:
    """The groups that another may match: the first bound, on the united prefixes of their classes."""

    def prefixes(batch: pa.RecordBatch):
        for gid, members in zip(batch.column("gid").to_pylist(), batch.column("members"), strict=True):
            yield gid, np.unique(np.concatenate([_prefix(t, percent) for _, t in _members(members)]))

    held = F.aggregate("members", F.lit(0).cast("long"), lambda n, m: n + F.length(m["tokens"]))
    total = groups.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0] // 8
    shared = _shared_shingles(groups.select("gid", "members"), prefixes, _buckets(groups.sparkSession, total))
    least = F.array_min(F.transform("members", lambda m: F.length(m["tokens"]))) / 8
    able = groups.select("gid", least.cast("long").alias("least")).join(shared.withColumnRenamed("owner", "gid"), "gid")
    return groups.join(able.where(F.col("shared") >= _enough("least", percent)).select("gid"), "gid")


_INCIDENCE = pa.schema([("gid", pa.int64()), ("token", pa.int64()), ("classes", pa.int64())])
_ASKING = pa.schema([("gid", pa.int64()), ("token", pa.int64())])


def _pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups, gid and asked, that may hold links. Written and read back."""
    spark = groups.sparkSession
    path = scratch_path(spark)
    _matchable(groups, percent).write.parquet(path)
    groups = spark.read.parquet(path)

    def unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, members in zip(batch.column("gid").to_pylist(), batch.column("members"), strict=True):
                token, classes = np.unique(np.concatenate([t for _, t in _members(members)]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(token), gid)), pa.array(token.view(np.int64)), pa.array(classes)], schema=_INCIDENCE
                )

    held = groups.select("gid", "members").mapInArrow(unions, "gid long, token long, classes long")
    # Shingles of two groups at least, with their number of classes: the order of rarity.
    several = held.groupBy("token").agg(F.min("gid").alias("low"), F.max("gid").alias("high"), F.sum("classes").alias("rarity"))
    path = scratch_path(spark)
    # What is one entry: the groups that are all linked to the same leader, or a group alone.
    entry = F.when(F.col("sure"), F.col("lead")).otherwise(-1 - F.col("gid"))
    entries = groups.select("gid", entry.alias("entry"))
    several = several.where("low <> high").select("token", "rarity")
    held.join(several, "token").join(entries, "gid").select("gid", "token", "rarity", "entry").write.parquet(path)
    matrix = spark.read.parquet(path)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c) for c in ("gid", "members", "shared"))
            for gid, members, shared in zip(*columns, strict=True):
                token = np.asarray(shared.values.field("token"), np.int64).view(np.uint64)
                rarity = np.asarray(shared.values.field("rarity"), np.int64)
                order = np.argsort(token)
                token, rarity = token[order], rarity[order]
                chosen = []
                for _, own in _members(members):
                    place = np.minimum(np.searchsorted(token, own), len(token) - 1)
                    both = token[place] == own
                    # shingles that no other group has are the rarest of all
                    room = len(own) - need(len(own), percent) + 1 - int((~both).sum())
                    if room > 0:
                        place = place[both]
                        chosen.append(token[place[np.lexsort((token[place], rarity[place]))[:room]]])
                asked = np.unique(np.concatenate(chosen)) if chosen else token[:0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), gid.as_py())), pa.array(asked.view(np.int64))], schema=_ASKING)

    shared = matrix.groupBy("gid").agg(F.collect_list(F.struct("token", "rarity")).alias("shared"))
    asking = groups.select("gid", "members").join(shared, "gid").mapInArrow(rarest, "gid long, token long")
    # First which entries are asked, other than the group's own; then their groups that have the shingle.
    own = asking.join(entries, "gid").withColumnRenamed("entry", "own")
    others = matrix.select("token", "entry").distinct()
    met = own.join(others, "token").where("own <> entry").select("gid", "token", "entry")
    theirs = matrix.select("token", "entry", F.col("gid").alias("asked"))
    path = scratch_path(spark)
    met.join(theirs, ["token", "entry"]).where("asked < gid").select("gid", "asked").distinct().write.parquet(path)
    return spark.read.parquet(path)


def _opened(groups: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links u, v inside groups and between those of a pair, as many as connect what is linked."""
    both = pairs.join(groups.select("gid", "members"), "gid").join(
        groups.select(F.col("gid").alias("asked"), F.col("members").alias("others")), "asked"
    )
    alone = groups.where(~F.col("sure") & (F.size("members") > 1)).select("members", F.lit(None).cast(groups.schema["members"].dataType).alias("others"))

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, others in zip(batch.column("members"), batch.column("others"), strict=True):
                own = _members(members)
                u, v = _open(own, _members(others) if others.is_valid else own, percent)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_EDGE)

    return both.select("members", "others").unionByName(alone).mapInArrow(open_pairs, "u long, v long")


def _open(queries: list, members: list, percent: int) -> tuple[list[int], list[int]]:
    """Links between two groups (or inside one) that connect all that is linked: no more than there are classes."""
    size = np.array([len(t) for _, t in members])
    tokens = np.concatenate([t for _, t in members])
    holder = np.repeat(np.arange(len(members)), size)
    order = np.argsort(tokens, kind="stable")
    tokens, holder = tokens[order], holder[order]
    union = np.unique(tokens)
    smallest = int(size.min())
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    u, v = [], []
    for node, own in queries:
        n = len(own)
        # what any member of this group must share: of the query, and of both sizes together
        least = max(need(n, percent), -(-percent * (n + smallest) // (100 + percent)))
        place = np.minimum(np.searchsorted(union, own), len(union) - 1)
        inside = own[union[place] == own]
        if len(inside) < least:  # the group's union holds too little of the query
            continue
        low, high = np.searchsorted(tokens, inside), np.searchsorted(tokens, inside, side="right")
        count = high - low
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        both = np.bincount(holder[at], minlength=len(members))
        for i in np.flatnonzero(100 * both >= percent * (size + n - both)).tolist():
            a, b = find(node), find(members[i][0])
            if a != b:
                top[a] = b
                u.append(node)
                v.append(members[i][0])
    return u, v


def links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of all documents (doc_id, content, n, node); the candidate classes (id, node); and links u, v of their ids
    that connect the classes of every component."""
    docs = docs.select("doc_id", "text", content().alias("content"))
    spark = docs.sparkSession
    known = classes(docs, words)
    found = _candidate_sets(docs, known, words, percent)
    led = found.select("id", "n", "tokens").join(_leaders(found), "id")
    path = scratch_path(spark)
    _to_leaders(led, percent).write.parquet(path)
    near = spark.read.parquet(path)
    groups = _groups(led, near)
    return known, found.select("id", "node"), near.unionByName(_opened(groups, _pairs(groups, percent), percent))


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Documents with their class and ``label``, which names the component (null for an empty set)."""
    known, found, near = links(docs, words, percent)
    label = found.join(components(near).toDF("id", "label_id"), "id").join(
        found.select(F.col("id").alias("label_id"), F.col("node").alias("label")), "label_id"
    )
    # Written, so that the join can split the copies of a hot class.
    path = scratch_path(docs.sparkSession)
    label.select("node", "label").write.parquet(path)
    named = known.join(docs.sparkSession.read.parquet(path), "node", "left")
    return named.withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "node")))


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links, or its own).

    Words are runs of anything but white space after lower-casing A-Z. Null, empty and blank texts have an empty set
    and link with nothing; a text with fewer words than a shingle has the whole sequence as its only one. Repeated rows
    are copies of each other. A null doc_id never names a component if another document is in it. No rows give none.
    """
    labelled = _labelled(docs, words, percent)
    path = scratch_path(docs.sparkSession)
    labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")).write.parquet(path)
    groups = docs.sparkSession.read.parquet(path)
    return labelled.join(groups, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component: the one with the smallest doc_id.

    Documents with an empty set link with nothing and all stay (rows that repeat doc_id and text once).
    """
    labelled = _labelled(docs, words, percent)
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "content")
    first = labelled.where("label is not null").groupBy("label").agg(F.min(row).alias("row")).select("row.doc_id", "row.content")
    return stay(docs, first.unionByName(labelled.where("label is null").select("doc_id", "content")))
