"""Simple-8b coding of unsigned 64-bit integers, in vectorised form.

A word of 64 bits has a selector in its top four bits and 60 bits for as many values as fit: selector 1 stands for 120
zeros, selectors 2 to 15 for 60, 30, 20, ... 1 values of 1, 2, 3, ... 60 bits. Selector 0 is the escape: a value that
needs more is laid in two such words, its upper half first (with bit 59 set), then its lower half. Values are coded in
blocks of a fixed number, each beginning with a word of its own whose number is the block's offset, so all blocks are
decoded at once by array operations, or any of them alone.

No word ends (in little-endian order) with the byte 0xFF, as values from 15 * 2**56 on are escaped: eight such bytes
never occur in coded words, whatever the values are, and can part records.
"""

from __future__ import annotations

import numpy as np

#: Bits and number of values for selectors 1 to 15.
BITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = (120, *(60 // b for b in BITS[1:]))
#: Values below are never escaped.
ESCAPED_FROM = 15 << 56

_LIMITS = np.array([1 << b for b in BITS[:-1]] + [ESCAPED_FROM], np.uint64)
_ESCAPE = len(BITS)
_PAD = COUNTS[0]
_HIGH = np.uint64(1 << 59)
_LOW_HALF = np.uint64(0xFFFFFFFF)
_STEP = np.array([*COUNTS, 1], np.uint8)
#: How the maximum over a window is made of those over two shorter ones.
_WINDOWS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (3, 3), 7: (4, 3), 8: (4, 4), 10: (5, 5), 12: (6, 6), 15: (8, 7), 20: (10, 10), 30: (15, 15), 60: (30, 30), 120: (60, 60)}


def _classes(values: np.ndarray) -> np.ndarray:
    """The number of limits that each value reaches: the narrowest class it fits."""
    out = np.zeros(values.shape, np.uint8)
    for limit in _LIMITS[: np.searchsorted(_LIMITS, np.iinfo(values.dtype).max, "right")]:
        out += values >= values.dtype.type(limit)
    return out


def pack(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block's first word) of unsigned values, in blocks of ``block`` values; each word takes as many as fit."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = -(-n // block)
    grid = np.zeros((rows, block + _PAD), np.uint64)  # beyond a block's end zeros, which fit anywhere
    full = n // block
    grid[:full, :block] = values[: full * block].reshape(full, block)
    grid[full:, : n - full * block] = values[full * block :]
    need = _classes(grid.astype(np.uint16) if values.max() < 1 << 16 else grid)
    most = {1: need}
    for width, (a, b) in _WINDOWS.items():
        most[width] = wide = most[a].copy()
        np.maximum(wide[:, :-a], most[b][:, a:], out=wide[:, :-a])
    choice = np.full(need.shape, _ESCAPE, np.uint8)
    for s in range(len(BITS) - 1, -1, -1):
        np.putmask(choice, most[COUNTS[s]] <= s, s)
    step = _STEP[choice[:, :block]]
    step[:, -_PAD:] = np.minimum(step[:, -_PAD:], np.arange(step[:, -_PAD:].shape[1], 0, -1, dtype=np.uint8))  # no further than the block's end
    # all blocks go from word to word at once
    step, begins = step.ravel().astype(np.int64), np.zeros(n, bool)
    here = np.arange(rows) * block
    end = np.minimum(here + block, n)
    while len(here):
        begins[here] = True
        here = here + step[here]
        inside = here < end
        here, end = here[inside], end[inside]
    first = np.flatnonzero(begins)
    row, column = first // block, first % block
    chosen = choice[row, column]
    size = np.where(chosen == _ESCAPE, 2, 1)
    at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        k = np.flatnonzero(chosen == s)  # words of this class
        if s == _ESCAPE:
            v = grid[row[k], column[k]]
            words[at[k]], words[at[k] + 1] = v >> np.uint64(32) | _HIGH, v & _LOW_HALF
        else:
            v = grid[row[k][:, None], column[k][:, None] + np.arange(COUNTS[s])]
            words[at[k]] = np.bitwise_or.reduce(v << _shifts(s), axis=1) | np.uint64((s + 1) << 60)
    return words, at[np.searchsorted(first, np.arange(rows) * block)]


def _shifts(s: int) -> np.ndarray:
    return (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
    """The n values of words that pack() made with this block size, as uint64."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    upper = (selector == 0) & (words & _HIGH != 0)
    count = np.array([1, *COUNTS])[selector]
    count[upper] = 0
    row = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(words))))
    before = np.cumsum(count) - count
    column = before - before[offsets][row]
    grid = np.zeros((len(offsets), block + _PAD), np.uint64)
    for s in np.unique(selector).tolist():
        if s == 0:
            k = np.flatnonzero((selector == 0) & ~upper)
            grid[row[k], column[k]] = words[k - 1] << np.uint64(32) | words[k]
        elif s > 1:  # zeros are there already
            k = np.flatnonzero(selector == s)
            mask = np.uint64((1 << BITS[s - 1]) - 1)
            grid[row[k][:, None], column[k][:, None] + np.arange(COUNTS[s - 1])] = words[k][:, None] >> _shifts(s - 1) & mask
    return grid[:, :block].reshape(-1)[:n]
