"""Content-defined cuts: a rolling hash over the last bytes decides, so equal passages are cut alike wherever they stand."""

from __future__ import annotations

import numpy as np

from framewright.llm import blocks

WINDOW_STEPS = 5  # the window has 2 ** 5 = 32 bytes


def cuts(body: np.ndarray, bounds: np.ndarray, mean: int) -> np.ndarray:
    """Where chunks begin: at every text's start, and before characters whose 32 bytes in front hash to a multiple of ``mean``.

    ``mean`` is a power of two. A cut never parts a character, and its window lies within its text.
    """
    if len(body) == 0:
        return np.zeros(0, np.int64)
    rolled = blocks.BYTE_KEYS[body]
    factor, reach = int(blocks.STEP), 1
    for _ in range(WINDOW_STEPS):
        rolled[reach:] = rolled[reach:] + rolled[:-reach] * np.uint64(factor)
        factor, reach = factor * factor % (1 << 64), 2 * reach
    chosen = np.zeros(len(body), bool)
    chosen[1:] = (blocks.scramble(rolled[:-1]) & np.uint64(mean - 1)) == 0
    chosen &= (body & 0xC0) != 0x80
    at = np.flatnonzero(chosen)
    text = np.searchsorted(bounds, at, side="right") - 1
    at = at[at - bounds[text] >= 1 << WINDOW_STEPS]
    return np.union1d(at, bounds[:-1][np.diff(bounds) > 0])
