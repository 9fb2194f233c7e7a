"""Cutting-stock plans by column generation, over a histogram of lengths (never over single documents)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def best_patterns(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming, any number of each item.

    Returns for every fill 0 ... capacity the greatest value of a pattern with exactly that fill (-inf if there
    is none) and the last item put in.
    """
    best = np.full(capacity + 1, -np.inf)
    last = np.full(capacity + 1, -1)
    best[0] = 0.0
    order = np.argsort(lengths)
    values, lengths = values[order], lengths[order]
    for fill in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, fill, side="right"))
        if n:
            reached = values[:n] + best[fill - lengths[:n]]
            k = int(np.argmax(reached))
            best[fill], last[fill] = reached[k], order[k]
    return best, last


def costs(capacity: int) -> np.ndarray:
    """What a sequence of each fill costs: its padded length. A power of two is not padded."""
    cost = np.full(capacity + 1, float(capacity))
    size = 1
    while size < capacity:
        cost[size] = size
        size *= 2
    cost[0] = 0.0
    return cost


def first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A pattern for every length: the greatest length left, then the greatest that fit, until none does.

    Each is used until one of its lengths runs out, and stands in that length's row; later patterns are without
    it, so the patterns are independent.
    """
    patterns, x = np.zeros((len(lengths), len(lengths))), np.zeros(len(lengths))
    left = demand.astype(float).copy()
    present = np.argsort(lengths)[::-1].tolist()
    while present:
        pattern, space = np.zeros(len(lengths)), capacity
        for i in present:
            if lengths[i] <= space:
                taken = max(1, min(space // lengths[i], int(left[i])))
                pattern[i] = taken
                space -= taken * lengths[i]
        used = np.flatnonzero(pattern)
        amount = left[used] / pattern[used]
        gone = int(used[np.argmin(amount)])
        patterns[gone], x[gone] = pattern, amount.min()
        left[used] -= amount.min() * pattern[used]
        present.remove(gone)
    return patterns, x


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Vector times matrix or vector, in this thread: a driver has no use for a pool of linear-algebra threads."""
    return np.einsum("i,ij->j" if b.ndim == 2 else "i,i->", a, b)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchange."""
    n = len(matrix)
    left, right = matrix.astype(float).copy(), np.eye(n)
    for i in range(n):
        k = i + int(np.argmax(np.abs(left[i:, i])))
        if k != i:
            left[[i, k]], right[[i, k]] = left[[k, i]], right[[k, i]]
        right[i] /= left[i, i]
        left[i] /= left[i, i]
        others = np.flatnonzero(left[:, i])
        others = others[others != i]
        factor = left[others, i].copy()
        left[others] -= np.outer(factor, left[i])
        right[others] -= np.outer(factor, right[i])
    return right


class Program(NamedTuple):
    """A solved linear program: a row of item counts per pattern, how often each is used, columns that knapsacks priced and that came in, relative gap to a lower bound."""

    patterns: np.ndarray
    times: np.ndarray
    priced: int
    gap: float


class _Basis:
    """The revised simplex method: patterns in use, the inverse of their matrix, and the prices (duals) of the lengths."""

    def __init__(self, patterns: np.ndarray, x: np.ndarray, cost: np.ndarray):
        self.patterns, self.x, self.cost = patterns, x, cost
        self.inverse = _inverse(patterns.T)
        self.dual, self.pivots = _times(cost, self.inverse), 0

    def reduced(self, at: np.ndarray, counts: np.ndarray, cost: float) -> float:
        """What a unit of a column (counts at some lengths) costs less than its parts at the prices; below 0 it improves."""
        return cost - float((self.dual[at] * counts).sum())

    def enter(self, at: np.ndarray, counts: np.ndarray, cost: float) -> bool:
        """Bring a column in. Only the rows that it touches are worked on."""
        step = np.einsum("ij,j->i", self.inverse[:, at], counts)
        rising = step > 1e-9
        if not rising.any():
            return False
        ratio = np.full(len(step), np.inf)
        ratio[rising] = self.x[rising] / step[rising]
        leaving = int(np.argmin(ratio))
        amount, reduced = ratio[leaving], self.reduced(at, counts, cost)
        self.x -= amount * step
        self.x[leaving] = amount
        np.maximum(self.x, 0, out=self.x)
        row = self.inverse[leaving] / step[leaving]
        step[leaving] = 0.0
        touched = np.flatnonzero(np.abs(step) > 1e-12)
        self.inverse[touched] -= step[touched, None] * row
        self.inverse[leaving] = row
        self.patterns[leaving] = 0.0
        self.patterns[leaving, at] = np.maximum(counts, 0)
        self.cost[leaving] = cost
        self.pivots += 1
        self.dual = _times(self.cost, self.inverse) if self.pivots % 64 == 0 else self.dual + reduced * row
        return True


def _pattern(last: np.ndarray, lengths: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The items of the best pattern of a fill, and how often each."""
    found = []
    while fill > 0:
        found.append(last[fill])
        fill -= int(lengths[last[fill]])
    at, counts = np.unique(found, return_counts=True)
    return at, counts.astype(float)


def linear_program(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-6, rounds: int = 400, columns: int = 8) -> Program:
    """Fractional numbers of patterns that cover ``demand`` at least cost, by the revised simplex method.

    The knapsack prices columns, however good the first patterns are, and up to ``columns`` of the best fills come in
    each time if they still improve. Generation ends when no column improves, when the prices prove the cost to be within
    ``gap`` of the least possible, or after ``rounds`` knapsacks (about 10 ms each, whatever the number of documents). The last
    bound leaves padding, nothing else: the README has figures.
    """
    price = costs(capacity)
    patterns, x = first_basis(lengths, demand, capacity)
    basis = _Basis(patterns, x, price[_times(lengths.astype(float), patterns.T).astype(int)])
    bound = float((lengths * demand).sum())  # all tokens without padding
    priced, done, one = 0, 0, np.array([-1.0])
    while done < rounds:
        surplus = int(np.argmin(basis.dual))
        if basis.dual[surplus] < -1e-9:  # more of a length than is asked for is free
            if not basis.enter(np.array([surplus]), one, 0.0):
                break
            continue
        best, last = best_patterns(basis.dual, lengths, capacity)
        done += 1
        gain = best - price
        # Scaled down until no pattern is worth more than it costs, the prices give a lower bound.
        reached = best[1:] > -np.inf
        bound = max(bound, float(_times(basis.dual, demand) / np.max(best[1:][reached] / price[1:][reached])))
        better = np.flatnonzero(gain > 1e-7 * capacity)
        if len(better) == 0 or _times(basis.cost, basis.x) <= bound * (1 + gap):
            break
        came = 0
        for fill in better[np.argsort(-gain[better], kind="stable")][:columns].tolist():
            at, counts = _pattern(last, lengths, fill)
            if basis.reduced(at, counts, price[fill]) < -1e-7 * capacity:
                came += basis.enter(at, counts, price[fill])
        priced += came
        if came == 0:
            break
    return Program(basis.patterns, basis.x, priced, float(_times(basis.cost, basis.x)) / bound - 1)


def whole_patterns(patterns: np.ndarray, x: np.ndarray, demand: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Round: every pattern as often as its whole part says, then once more, the fullest first, while items last.

    Returns the times each pattern is used, and the items of each length that no pattern took.
    """
    times = np.floor(x + 1e-6)
    left = demand - _times(times, patterns)
    for i in np.flatnonzero(left < -0.5):  # "at least" may have been more: give patterns back
        for p in np.flatnonzero((patterns[:, i] > 0) & (times > 0)):
            if left[i] >= -0.5:
                break
            back = min(times[p], np.ceil(-left[i] / patterns[p, i]))
            times[p] -= back
            left = left + back * patterns[p]
    fill = _times(lengths.astype(float), patterns.T)
    waste = costs(capacity)[fill.astype(int)] - fill
    for p in np.lexsort((-fill, waste)):
        if fill[p] and waste[p] <= capacity / 50:
            more = np.floor(np.min(left[patterns[p] > 0] / patterns[p][patterns[p] > 0]))
            if more > 0:
                times[p] += more
                left = left - more * patterns[p]
    return times, left


def layout(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Where items go, by length and rank within the length.

    Rows (length, rank_from, rank_to, per_sequence, sequence, offset, piece_start, piece_length): the items of
    that length with ranks in [rank_from, rank_to) lie ``per_sequence`` to a sequence from ``sequence`` on, the
    first at ``offset``. Items left over by rounding (their number is bounded by lengths and patterns, not by
    documents) are laid end to end and cut at the capacity: they may have two rows. Also returns the number of
    sequences. The rows depend on the histogram alone.
    """
    if len(lengths) == 0:
        return [], 0
    lengths = lengths.astype(int)
    solved = linear_program(lengths, demand.astype(float), capacity)
    patterns = solved.patterns
    times, left = whole_patterns(patterns, solved.times, demand.astype(float), lengths, capacity)
    rows, rank, sequence = [], dict.fromkeys(lengths.tolist(), 0), 0
    for p in np.flatnonzero((times > 0) & patterns.any(axis=1)):
        offset = 0
        for i in np.flatnonzero(patterns[p])[::-1]:
            size, per = int(lengths[i]), int(patterns[p][i])
            upto = rank[size] + int(times[p]) * per
            rows.append((size, rank[size], upto, per, sequence, offset, 0, size))
            rank[size] = upto
            offset += per * size
        sequence += int(times[p])
    space = capacity
    for i in np.flatnonzero(left > 0.5)[::-1]:
        size = int(lengths[i])
        for r in range(rank[size], rank[size] + int(round(left[i]))):
            start = 0
            while start < size:
                piece = min(space, size - start)
                rows.append((size, r, r + 1, 1, sequence, capacity - space, start, piece))
                start, space = start + piece, space - piece
                if space == 0:
                    sequence, space = sequence + 1, capacity
    return rows, sequence + (space < capacity)
