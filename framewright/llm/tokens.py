"""Token ids of whole texts, the same as the tokenizers library gives, found unit by unit.

Both kinds of tokenizer cut a text into pieces before they merge bytes, and some of these cuts can be told
from the bytes alone: before a blank that starts or ends a run of white space, and between an ASCII letter
and an ASCII sign. What lies between two such cuts is a "unit". Arrow's hash table finds the different units
of a slice, only those not met before reach the tokenizer, and the ids are strung together. Where a special
token's name stands in a text, the text is encoded whole; so are all texts by a tokenizer with other rules than the two
that the cuts are proven for (``PARTED``).
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from framewright.llm import blocks

# Units that one Python worker remembers (about 150 bytes each); with more it starts anew.
REMEMBERED = 600_000

BYTE_LEVEL, WORD_END = "byte_bpe_50k.json", "word_bpe_49k.json"

# Digests (``rules``) of how those two files normalise, part and merge, whatever their vocabulary.
PARTED = {
    "97a1aa9a68c076e9995377b331426330870c01b7c0ed9fdde1d2848b1e8b222b",
    "b4e94907922ace7bbe30e0d3ec092dee4da38bbd5a67fae9ede282dcd197f57a",
}

_BLANK, _BREAK, _QUOTE = 0x20, 0x0A, 0x27
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = True
_SIGN &= ~_LETTER & ~_DIGIT
# Bytes that are never part of white space; C2 and E1-E3 may begin a white-space character, 80-BF may end one.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_AFTER = _SOLID.copy()
_AFTER[[x for x in range(0xC3, 0xF5) if x not in (0xE1, 0xE2, 0xE3)]] = True

# The characters that byte-level tokenizers write for bytes 0-255 (printable ones stand for themselves).
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_NAMES = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


_BLANK_NAME = chr(BYTE_NAMES[_BLANK])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``first[i] ... first[i] + size[i] - 1`` of all i in a row."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def rules(tokenizer) -> str:
    """A digest of a tokenizer's settings without its vocabulary and merges."""
    settings = json.loads(tokenizer.to_str())
    model = {k: v for k, v in settings["model"].items() if k not in ("vocab", "merges")}
    return hashlib.sha256(json.dumps([settings["normalizer"], settings["pre_tokenizer"], model], sort_keys=True).encode()).hexdigest()


class Encoder:
    """Encodes lists of texts with one tokenizer file, without adding special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_units = rules(self.tokenizer) in PARTED
        self.model = self.tokenizer.model
        self.keeps_blanks = self.tokenizer.normalizer is None  # byte level; else white space is dropped, case too
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _ids(self, unit: bytes) -> list[int]:
        if unit.isalpha():  # ASCII letters, one piece: straight to the merges
            return [t.id for t in self.model.tokenize(unit.decode())]
        if self.keeps_blanks and unit[:1] == b" " and unit[1:].isalpha():
            return [t.id for t in self.model.tokenize(_BLANK_NAME + unit[1:].decode())]
        text = unit.decode()
        word = text[1:] if self.keeps_blanks and unit[:1] == b" " else text
        if word.isalpha() and max(word) < "İ":  # composed already, no case rules beyond one letter
            piece = text if self.keeps_blanks else text.lower()
            return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_NAMES))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _places(self, units: list[bytes]) -> np.ndarray:
        known = self.known
        new = [u for u in units if u not in known]
        if new:
            ids = list(map(self._ids, new))
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            n, total = len(known), int(size.sum())
            self.flat, self.first, self.size = (
                _room(self.flat, self.used + total), _room(self.first, n + len(new)), _room(self.size, n + len(new))
            )
            self.flat[self.used : self.used + total] = [i for x in ids for i in x]
            self.first[n : n + len(new)] = self.used + np.cumsum(size) - size
            self.size[n : n + len(new)] = size
            self.used += total
            known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def _cuts(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where units begin, and which bytes are dropped."""
        cut = np.zeros(len(body), bool)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        letter, sign = _LETTER[body], _SIGN[body]
        cut[1:] |= letter[:-1] & sign[1:]
        cut[1:] |= sign[:-1] & letter[1:] & (body[:-1] != _QUOTE)
        if not self.keeps_blanks:
            dropped = (body == _BLANK) | (body == _BREAK)
            cut[1:] |= dropped[:-1]
            return cut, dropped
        white = (body == _BLANK) | (body == _BREAK)
        before, after = _SOLID[body], _AFTER[body]
        cut[1:] |= white[1:] & before[:-1]
        cut[1:-1] |= (body[1:-1] == _BLANK) & after[2:]
        # A line break between solid characters is a piece of its own.
        cut[2:] |= before[:-2] & (body[1:-1] == _BREAK) & after[2:]
        return cut, np.zeros(0, bool)

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (uint32), and n + 1 offsets that tell each text's part."""
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if not self.by_units:
            found = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            return np.array([i for x in found for i in x], np.uint32), offsets
        if len(self.known) > REMEMBERED:
            self._forget()
        apart = np.zeros(n, bool)
        for name in self.special:
            apart |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        whole = {int(i): texts[int(i)].as_py() for i in np.flatnonzero(apart)}
        if whole:
            texts = pc.if_else(pa.array(apart), pa.scalar("", pa.large_string()), texts)
        body, bounds = blocks.raw(texts)
        if not self.keeps_blanks:
            body = blocks.LOWER[body]
        cut, dropped = self._cuts(body, bounds)
        begin = np.flatnonzero(cut)
        if len(dropped):
            # Dropped bytes go; a unit may be left empty, it then has no ids.
            kept_before = np.concatenate([[0], np.cumsum(~dropped)])
            begin_kept, packed = kept_before[begin], body[~dropped]
        else:
            begin_kept, packed = begin, body
        ends = np.concatenate([begin_kept, [len(packed)]]).astype(np.int64)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
        coded = units.dictionary_encode()
        place = self._places(_values(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.size[place]
        ids = self.flat[ragged(self.first[place], size)]
        offsets = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(begin, bounds)]
        if whole:
            parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            for i, text in whole.items():
                parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets.astype(np.int64)


def _values(column: pa.LargeBinaryArray) -> list[bytes]:
    body, bounds = blocks.raw(column)
    whole, ends = body.tobytes(), bounds.tolist()
    return [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _room(values: np.ndarray, n: int) -> np.ndarray:
    if n <= len(values):
        return values
    grown = np.zeros(max(n, 2 * len(values)), values.dtype)
    grown[: len(values)] = values
    return grown
