"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut into chunks by a rolling hash. A chunk that several texts have is encoded once, in the text that is
named for it, and travels to the others as ids. Ids next to a cut depend on both sides, so only a chunk's body counts, from
its first to its last safe blank (one with visible ASCII characters on both sides, before which most tokenizers part a text
in any surroundings); what lies between two bodies is encoded again as one piece, over the join.

Every join is then held against its surroundings. The piece is encoded once more together with the edges of both bodies,
as far as the next blank inside them: the ids must be those of the three parts in a row, and the bodies' ids, which
other texts made, must end and begin with those of their edges. Where they do not agree the repair goes on to the end: the
text is encoded whole. With the tokenizers of ``tokens.PARTED`` a blank is such a place always, and no join disagrees; with
others the reuse saves less, and agreement at the edges of both sides stands for a proof. A chunk without two safe blanks
is not reused, so the piece reaches on into it.

Equal texts are encoded once as well. Texts move once, compressed, to meet the list of their shared chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from framewright.llm import blocks, chunking, tokens
from framewright.session import scratch_path

MEAN_CHUNK = 512  # bytes, a power of two


def _key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def safe_blanks(text: np.ndarray) -> np.ndarray:
    """Blanks with visible ASCII characters on both sides."""
    if len(text) < 3:
        return np.zeros(0, np.int64)
    solid = (text > 0x20) & (text < 0x7F)
    return np.flatnonzero(solid[:-2] & (text[1:-1] == 0x20) & solid[2:]) + 1


def bodies(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Bodies of a text's chunks as start and end, and their digests. Chunks without a body are left out."""
    begin = chunking.cuts(text, np.array([0, len(text)]), MEAN_CHUNK)
    at = safe_blanks(text)
    if len(text) < 3:
        return begin[:0], begin[:0], []
    low = np.searchsorted(at, begin)
    high = np.searchsorted(at, np.append(begin[1:], len(text)) - 1) - 1  # the blank's right neighbour is in the chunk too
    good = high > low
    start, end = at[low[good]], at[high[good]]
    whole = text.tobytes()
    return start, end, [_key(whole[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def digests(ids: np.ndarray, decoded: str) -> tuple:
    """A view of a document: n_tokens, SHA-256 of its ids (little-endian unsigned 32-bit) and of its decoded text."""
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def whole(ids: np.ndarray, decoded: str) -> tuple:
    """A view of a document: its ids and its decoded text."""
    return ids.astype(np.int64).tolist(), decoded


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
WHOLE = "ids array<bigint>, decoded string"


class Decoder:
    """Decodes as the tokenizers library does with skip_special_tokens=False."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.names = None
        if tokenizer.decoder is None:  # tokens parted by blanks
            vocabulary = tokenizer.get_vocab(with_added_tokens=True)
            self.names = [""] * (max(vocabulary.values()) + 1)
            for name, i in vocabulary.items():
                self.names[i] = name

    def decode(self, ids: np.ndarray) -> str:
        if self.names is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_decoders: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(tokens.encoder(path).tokenizer)
    return _decoders[path]


def _arrays(texts: pa.LargeStringArray) -> Iterator[np.ndarray]:
    body, bounds = blocks.raw(texts)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield body[a:b]


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


_USES = "array<struct<at:int, chunk:binary, named:boolean>>"


def _packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def _joins(text: bytes, used: list[tuple[int, int, bytes]], blanks: np.ndarray) -> list[bytes]:
    """For each stretch between used bodies: the edge of the body on its left, itself, the edge on its right, and all three.

    An edge reaches to the next safe blank inside the body, or over all of it.
    """
    found, taken = [], 0
    low = 0  # where the left edge begins
    for start, end, _ in [*used, (len(text), len(text), b"")]:
        inside = blanks[np.searchsorted(blanks, start, side="right") : np.searchsorted(blanks, end)]
        high = int(inside[0]) if len(inside) else end
        found += [text[low:taken], text[taken:start], text[start:high], text[low:high]]
        low, taken = (int(inside[-1]) if len(inside) else start), end
    return found


def agree(ids: list[bytes], left: list[bytes | None], right: list[bytes | None]) -> bool:
    """Whether the bodies (odd places) end and begin with the ids that the joins around them (even places) found for their edges."""
    return all(ids[i].startswith(right[i - 1]) and ids[i].endswith(left[i + 1]) for i in range(1, len(ids), 2))


def _shared_chunks(docs: DataFrame) -> DataFrame:
    """short (of the text's key), uses: the text's bodies (by number) that other texts have too, and whether it is the named one."""
    schema = pa.schema([("chunk", pa.binary()), ("short", pa.int64()), ("at", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, texts in blocks.slices(batches, "text"):
            chunk, short, at = [], [], []
            for text in _arrays(texts):
                key = _key(text.tobytes())
                if key in seen:
                    continue
                seen.add(key)
                found = bodies(text)[2]
                chunk += found
                short += [_short(key)] * len(found)
                at += range(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.binary()), pa.array(short, pa.int64()), pa.array(at, pa.int32())], schema=schema)

    met = docs.select("text").mapInArrow(find, "chunk binary, short long, at int")
    # Written, so that both sides of the join below are dealt out for it alone and the uses of a hot chunk can be split.
    shared = _written(
        met.groupBy("chunk")
        .agg(F.min("short").alias("low"), F.max("short").alias("high"), F.min(F.struct("short", "at")).alias("named"))
        .where("low <> high")
        .select("chunk", "named")
    )
    one = F.struct("at", "chunk", (F.struct("short", "at") == F.col("named")).alias("named"))
    return met.join(shared, "chunk").groupBy("short").agg(F.collect_set(one).alias("uses"))


def encode(docs: DataFrame, tokenizer: str, view: Callable = whole, columns: str = WHOLE) -> DataFrame:
    """doc_id and ``view(ids, decoded text)`` as ``columns`` for every row of ``docs`` (doc_id, text).

    The ids are those of the tokenizers library without added special tokens; a null text is empty and has none. Repeated
    rows give equal rows, no rows give none, other columns are not read.
    """
    spark = docs.sparkSession
    made = to_arrow_schema(StructType.fromDDL(columns))
    names = [f.name for f in made]

    def keys(rows: pa.RecordBatch, texts: pa.LargeStringArray) -> dict:
        return {"doc_id": rows.column("doc_id"), "key": [_key(t.tobytes()) for t in _arrays(texts)]}

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, texts in blocks.slices(batches, "text"):
            rows = []
            for text in _arrays(texts):
                body = text.tobytes()
                key = _key(body)
                if key not in seen:
                    seen.add(key)
                    rows.append((key, _short(key), len(body), pa.compress(body, "zstd", asbytes=True) if body else b""))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["key", "short", "size", "packed"],
            )

    # Partitioned by the short key once: the join and the copies' removal both use it.
    texts = docs.select("text").mapInArrow(compressed, "key binary, short long, size long, packed binary").repartition("short")
    work = texts.dropDuplicates(["short", "key"]).join(_shared_chunks(docs), "short", "left")

    parts = pa.schema(
        [("key", pa.binary()), ("place", pa.int32()), ("chunk", pa.binary()), ("ids", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("done", pa.struct(list(made)))]
    )

    def cook(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, reader = tokens.encoder(tokenizer), decoder(tokenizer)
        for batch in batches:
            at = 0
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), blocks.SLICE_BYTES, side="right")) + at)
                yield _cook(batch.slice(at, stop - at), coder, reader)
                at = stop

    def _cook(rows: pa.RecordBatch, coder: tokens.Encoder, reader: Decoder) -> pa.RecordBatch:
        pieces: list[bytes] = []  # what is to be encoded, one after the other
        named_chunks, plans = [], []
        for key, size, packed, uses in zip(*(rows.column(c).to_pylist() for c in ("key", "size", "packed", "uses")), strict=True):
            text = pa.decompress(packed, size, "zstd", asbytes=True) if size else b""
            wanted = {(u["at"], u["chunk"]): u["named"] for u in uses or ()}
            body = np.frombuffer(text, np.uint8)
            start, end, chunk = bodies(body) if wanted else ((), (), ())
            used = []  # bodies whose ids come from elsewhere
            for i, digest in enumerate(chunk):
                named = wanted.get((i, digest))
                if named:
                    named_chunks.append((digest, len(pieces)))
                    pieces.append(text[start[i] : end[i]])
                elif named is False:
                    used.append((int(start[i]), int(end[i]), digest))
            plans.append((key, text, used, len(pieces)))
            pieces += _joins(text, used, safe_blanks(body)) if used else [text]
        ids, offsets = coder.encode(pa.array(pieces, pa.binary()).cast(pa.large_binary()).cast(pa.large_string()))
        coded = [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        out: list[tuple] = [(None, 0, digest, _packed(coded[n]), None, None, None) for digest, n in named_chunks]

        def whole_text(key: bytes, own: np.ndarray) -> None:
            out.append((key, -1, None, None, None, None, dict(zip(names, view(own, reader.decode(own)), strict=True))))

        for key, text, used, first in plans:
            if not used:
                whole_text(key, coded[first])
                continue
            found = [coded[n : n + 4] for n in range(first, first + 4 * (len(used) + 1), 4)]
            if not all(np.array_equal(np.concatenate([left, piece, right]), both) for left, piece, right, both in found):
                whole_text(key, np.array(coder.encode(pa.array([text], pa.binary()).cast(pa.large_binary()).cast(pa.large_string()))[0]))
                continue
            for j, (left, piece, right, _) in enumerate(found):
                out.append((key, 2 * j, None, _packed(piece), _packed(left), _packed(right), None))
                if j < len(used):
                    out.append((key, 2 * j + 1, used[j][2], None, None, None, None))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in parts]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, parts, strict=True)], schema=parts)

    path = scratch_path(spark)
    view_type = f"struct<{', '.join(f'{f.name}:{_type(columns, f.name)}' for f in made)}>"
    schema = f"key binary, place int, chunk binary, ids binary, left binary, right binary, done {view_type}"
    work.select("key", "size", "packed", "uses").mapInArrow(cook, schema).write.option("compression", "zstd").parquet(path)
    cooked = spark.read.schema(schema).parquet(path)

    chunks = _written(cooked.where("key is null").groupBy("chunk").agg(F.min("ids").alias("ids")))
    wanted = cooked.where("key is not null and chunk is not null").select("key", "place", "chunk")
    nothing = F.lit(None).cast("binary")
    reused = wanted.join(chunks, "chunk").select("key", "place", "ids", nothing.alias("left"), nothing.alias("right"))
    own = cooked.where("key is not null and chunk is null and place >= 0").select("key", "place", "ids", "left", "right")
    strung = own.unionByName(reused).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "ids", "left", "right"))).alias("parts"))

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = decoder(tokenizer)
        target = pa.schema([("key", pa.binary()), ("done", pa.struct(list(made)))])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                found = []
                for parts_of in rows.column("parts"):
                    of = parts_of.values
                    if not agree(*(of.field(c).to_pylist() for c in ("ids", "left", "right"))):
                        found.append(None)
                        continue
                    ids = np.frombuffer(b"".join(of.field("ids").to_pylist()), "<u4")
                    found.append(dict(zip(names, view(ids, reader.decode(ids)), strict=True)))
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(found, target.field("done").type)], schema=target)

    joined = _written(strung.mapInArrow(string, f"key binary, done {view_type}"))
    results = cooked.where("done is not null").select("key", "done.*").unionByName(joined.where("done is not null").select("key", "done.*"))
    open_texts = joined.where("done is null").select("key")
    if open_texts.limit(1).count():  # never, with the tokenizers of ``tokens.PARTED``

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder, reader = tokens.encoder(tokenizer), decoder(tokenizer)
            for batch in batches:
                for key, size, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "size", "packed")), strict=True):
                    text = pa.decompress(packed, size, "zstd", asbytes=True) if size else b""
                    ids, _ = coder.encode(pa.array([text], pa.binary()).cast(pa.large_binary()).cast(pa.large_string()))
                    row = [key, *view(ids, reader.decode(ids))]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, [pa.field("key", pa.binary()), *made], strict=True)], names=["key", *names])

        left = texts.join(open_texts, "key", "left_semi").dropDuplicates(["key"]).select("key", "size", "packed")
        results = results.unionByName(left.mapInArrow(again, f"key binary, {columns}"))
    named = blocks.mapped(docs.select("doc_id", "text"), "doc_id long, key binary", keys)
    return named.join(results, "key").drop("key")


def _type(columns: str, name: str) -> str:
    return StructType.fromDDL(columns)[name].dataType.simpleString()
