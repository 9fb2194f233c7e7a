"""A compressed FM-index of segments of words: a wavelet matrix of the Burrows-Wheeler transform, with backward search.

Segments are ended by a symbol of their own (0) and sorted by suffixes of ``depth`` words, which is exact for patterns up to
that length. Many searches go on side by side: every step is numpy work on all of them. All arrays follow the words
of one shard, which the caller bounds.
"""

from __future__ import annotations

import numpy as np


class _Least:
    """Least values of ranges of an array, by a table of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        rows = [values]
        while 2 << (len(rows) - 1) <= len(values):
            last, half = rows[-1], 1 << (len(rows) - 1)
            row = last.copy()  # the last places of a row are not asked for
            row[: len(values) - half] = np.minimum(last[: len(values) - half], last[half:])
            rows.append(row)
        self.rows = np.stack(rows)

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of values[low:high] for each pair; ranges are not empty."""
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.rows[k, low], self.rows[k, high - (1 << k)])

    def last_below(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to ``at`` with a value below ``bound``; there is one."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            low = at - (1 << k) + 1
            whole = low >= 1
            whole[whole] = self.rows[k, low[whole]] >= bound[whole]
            at[whole] -= 1 << k
        return at

    def next_below(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on with a value below ``bound``; there is one."""
        at, n = at.copy(), self.rows.shape[1]
        for k in range(len(self.rows) - 1, -1, -1):
            whole = at + (1 << k) < n
            whole[whole] = self.rows[k, at[whole]] >= bound[whole]
            at[whole] += 1 << k
        return at


class _Wavelet:
    """Ranks of symbols in a sequence: one packed row of bits for each bit of a symbol, with a count for every 64."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        size = (len(sequence) >> 6) + 1
        self.bits, self.counts = np.zeros((self.levels, size), np.uint64), np.zeros((self.levels, size), np.int32)
        self.zeros = np.zeros(self.levels, np.int64)
        for level in range(self.levels):
            ones = (sequence >> (self.levels - 1 - level)) & 1 == 1
            padded = np.zeros(size << 6, bool)
            padded[: len(ones)] = ones
            self.bits[level] = np.packbits(padded, bitorder="little").view("<u8")
            self.counts[level, 1:] = np.cumsum(np.bitwise_count(self.bits[level, :-1]), dtype=np.int32)
            self.zeros[level] = len(ones) - int(ones.sum())
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        every = np.arange(symbols)
        self.origin = self._walk(every, np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            block, inside = at >> 6, (at & 63).astype(np.uint64)
            below = (np.uint64(1) << inside) - np.uint64(1)
            ones = self.counts[level, block] + np.bitwise_count(self.bits[level, block] & below)
            one = (symbol >> (self.levels - 1 - level)) & 1 == 1
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before place ``at``."""
        return self._walk(symbol, at) - self.origin[symbol]


class FMIndex:
    """The index of segments (arrays of word hashes), each with an owner; searches ask for owners below a bound."""

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray, depth: int):
        sizes = np.array([len(s) for s in segments], np.int64)
        self.end = np.cumsum(sizes + 1) - 1  # where each segment's end symbol stands
        self.start = self.end - sizes
        self.owners = owners
        _, symbol = np.unique(np.concatenate(segments), return_inverse=True)
        self.text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
        inside = np.ones(len(self.text), bool)
        inside[self.end] = False
        self.text[inside] = symbol + 1
        n, symbols = len(self.text), int(self.text.max()) + 1

        ranks, length = [self.text], 1
        while length < depth:  # ranks of suffixes by their first 2, 4, 8 ... words
            shifted = np.zeros(n, np.int64)
            shifted[: max(n - length, 0)] = ranks[-1][length:] + 1
            ranks.append(np.unique(ranks[-1] * np.int64(n + 2) + shifted, return_inverse=True)[1].astype(np.int64))
            length *= 2
        order = np.argsort(ranks[-1], kind="stable")
        shared = np.zeros(n + 1, np.int64)  # words in common with the suffix before
        one, two, common = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            at_one, at_two = one + common, two + common
            more = (at_one < n) & (at_two < n)
            more[more] = ranks[level][at_one[more]] == ranks[level][at_two[more]]
            common[more] += 1 << level
        shared[1:n] = common
        self.shared, self.nodes = shared, _Least(shared.astype(np.int16))
        self.least = _Least(np.repeat(owners, sizes + 1)[order])
        self.wavelet = _Wavelet(self.text[order - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=symbols))])[:-1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that start with ``symbol`` and go on as those of each range."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.before[symbol] + both[: len(symbol)], self.before[symbol] + both[len(symbol) :]

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drop words at the right end until more suffixes match: the new ranges and lengths."""
        length = np.maximum(self.shared[low], self.shared[high])
        root = length == 0
        bound = np.maximum(length, 1)
        low, high = self.nodes.last_below(low, bound), self.nodes.next_below(high, bound)
        return np.where(root, 0, low), np.where(root, len(self.text), high), length

    def covered(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of words of every segment that lie in matches of ``least`` words or more with a segment of a smaller owner.

        The segments are streamed from their ends: matching statistics, one word to the left in each step, words dropped
        at the right where no smaller owner matches. Gives segment, first word and end of each run.
        """
        n = len(self.text)
        who = np.flatnonzero(self.end - self.start >= least)
        at, low, high, length = self.end[who], np.zeros(len(who), np.int64), np.full(len(who), n), np.zeros(len(who), np.int64)
        edge = np.zeros(n + 1, np.int64)

        def note(chosen: np.ndarray) -> None:
            chosen = chosen & (length >= least)
            np.add.at(edge, at[chosen], 1)
            np.add.at(edge, (at + length)[chosen], -1)

        while len(who):
            more_low, more_high = self.extend(self.text[at - 1], low, high)
            grown = more_high > more_low
            grown[grown] = self.least.between(more_low[grown], more_high[grown]) < self.owners[who[grown]]
            note(~grown)
            stuck = ~grown & (length > 0)
            alone = ~grown & (length == 0)
            low, high = np.where(grown, more_low, low), np.where(grown, more_high, high)
            at, length = at - (grown | alone), length + grown
            low[stuck], high[stuck], length[stuck] = self.shorten(low[stuck], high[stuck])
            over = at == self.start[who]
            note(over)
            going = ~over & (at + length - self.start[who] >= least)
            who, at, low, high, length = who[going], at[going], low[going], high[going], length[going]
        inside = np.cumsum(edge[:-1]) > 0
        change = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        first, end = change[::2], change[1::2]
        segment = np.searchsorted(self.end, first)
        return segment, first - self.start[segment], end - self.start[segment]
