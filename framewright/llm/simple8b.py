"""Simple-8b: word-aligned coding of unsigned integers, all blocks of a batch in step.

A 64-bit word has a selector in its upper four bits and, in the other 60, as many values of equal width as the
selector says. A value that needs more than 60 bits is an escape: a word with selector 0, then the value as it is.
Values are cut into blocks of ``BLOCK``; a block begins at a word of its own, told by the offsets, so blocks are
coded and decoded side by side. The last word of a block may have room for more values than are left (zeros).
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
AT_ONCE = 1024  # blocks coded in step: bounds the memory of a very long run
# How many values a word with selector 1 ... 14 holds; each is 60 // count bits wide.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, *(60 // COUNTS[1:])])
ESCAPE = 0
_LIMITS = np.array([1 << b for b in range(64)], np.uint64)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs (0 needs none)."""
    return np.searchsorted(_LIMITS, values, side="right")


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all blocks in a row (uint64), and where each block's words begin (n_blocks + 1 offsets)."""
    values = np.ascontiguousarray(values, np.uint64)
    parts = [_encode(values[at : at + AT_ONCE * BLOCK]) for at in range(0, max(len(values), 1), AT_ONCE * BLOCK)]
    sizes = np.concatenate([np.diff(offsets) for _, offsets in parts])
    return np.concatenate([words for words, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    blocks = -(-n // BLOCK)
    room = BLOCK + 60  # zeros behind each block: the last word may reach beyond
    place = np.arange(n) // BLOCK * room + np.arange(n) % BLOCK
    padded, bits = np.zeros(blocks * room, np.uint64), np.zeros((blocks, room), np.uint8)
    padded[place] = values
    bits.ravel()[place] = _bits(values)
    # choice[b, i]: the selector with the most values that holds all of its values from place i on. Of selectors
    # that no full word of the batch can use, the rest is skipped: fewer bits for more values fit nowhere either.
    choice = np.zeros((blocks, BLOCK), np.int8)
    for selector in range(len(COUNTS) - 1, 0, -1):
        wide = np.zeros((blocks, room + 1), np.int32)
        np.cumsum(bits > WIDTHS[selector], axis=1, out=wide[:, 1:])
        fits = wide[:, COUNTS[selector] : COUNTS[selector] + BLOCK] == wide[:, :BLOCK]
        choice[fits] = selector
        if blocks > 1 and not fits[:-1, : BLOCK - COUNTS[selector]].any():
            break
    size = np.minimum(n - np.arange(blocks) * BLOCK, BLOCK)
    steps = np.maximum(COUNTS, 1)
    begins = np.zeros((blocks, BLOCK), bool)
    live, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(live):
        begins[live, at] = True
        at = at + steps[choice[live, at]]
        going = at < size[live]
        live, at = live[going], at[going]
    block, inside = np.nonzero(begins)
    selector = choice[block, inside].astype(np.int64)
    start = block * room + inside
    width = 1 + (selector == ESCAPE)
    ends = np.cumsum(width)
    words = np.zeros(ends[-1], np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == ESCAPE:
            words[ends[rows] - 1] = padded[start[rows]]
            continue
        taken = padded[start[rows, None] + np.arange(COUNTS[s])]
        shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
        words[ends[rows] - 1] = np.bitwise_or.reduce(taken << shifts, axis=1) | np.uint64(int(s) << 60)
    return words, np.concatenate([[0], np.cumsum(np.bincount(block, width, blocks))]).astype(np.int64)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values back, all words at once."""
    words = np.ascontiguousarray(words, np.uint64)
    out = np.zeros(n, np.uint64)
    if n == 0:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    plain = np.zeros(len(words), bool)  # words that are values behind an escape
    if (selector == ESCAPE).any():
        for i in np.flatnonzero(selector == ESCAPE):  # in order: a value behind an escape may look like one
            if not plain[i]:
                plain[i + 1] = True
    selector[plain] = ESCAPE
    count = COUNTS[selector] + plain
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    before = np.cumsum(count) - count
    start = before - before[offsets[block]] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s in range(1, len(COUNTS)):
        rows = np.flatnonzero(selector == s)
        if not len(rows):
            continue
        shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
        values = (words[rows, None] >> shifts) & np.uint64((1 << int(WIDTHS[s])) - 1)
        place = start[rows, None] + np.arange(COUNTS[s])
        inside = place < end[rows, None]
        out[place[inside]] = values[inside]
    rows = np.flatnonzero(plain)
    out[start[rows]] = words[rows]
    return out
