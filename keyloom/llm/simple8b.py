"""Simple-8b: whole numbers in 64-bit words. The top four bits of a word select how many numbers of how many
bits its other 60 hold. Selector 0 stands for 240 zeros, selector 15 is the escape: the next word is one number
of up to 64 bits, raw. About BLOCK words form a block, which can be decoded alone."""

from __future__ import annotations

import numpy as np

#: Fixed values of the code: bits and count of selectors 0 to 14.
BITS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
COUNTS = [240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
ESCAPE = 15
BLOCK = 1024

_WIDTHS = np.array([0] + [1 << i for i in range(64)], np.uint64)
_WIDTH16 = np.zeros(1 << 16, np.uint8)
for _b in range(16):
    _WIDTH16[1 << _b : 2 << _b] = _b + 1


def _widths(values: np.ndarray) -> np.ndarray:
    if len(values) and int(values.max()) < 1 << 16:
        return _WIDTH16[values.astype(np.uint16)]
    return (np.searchsorted(_WIDTHS, values, side="right") - 1).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words (uint64), and for each block its first word and the position of its first number."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    values = np.concatenate([values.astype(np.uint64), np.zeros(COUNTS[0], np.uint64)])
    widths = _widths(values)
    selector = np.full(n, len(COUNTS) - 1, np.uint8)
    at, high, held = np.arange(n), widths[:n].copy(), 1
    for s in range(len(COUNTS) - 2, -1, -1):  # what fits a selector with more numbers fits those with fewer
        for k in range(held, COUNTS[s]):
            high = np.maximum(high, widths[at + k]) if len(at) < n else np.maximum(high, widths[k : k + n])
        held = COUNTS[s]
        fits = high <= BITS[s]
        if held < 12 and len(at) == n:  # narrow passes over all are cheaper than picking positions
            np.putmask(selector, fits, s)
            continue
        at, high = at[fits], high[fits]
        if not len(at):
            break
        selector[at] = s
    selector[widths[:n] > BITS[-1]] = ESCAPE
    steps = np.array([*COUNTS, 1])[selector].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    start = np.array(starts)
    chosen = selector[start]
    place = np.arange(len(start)) + np.cumsum(chosen == ESCAPE) - (chosen == ESCAPE)
    words = np.zeros(len(start) + int((chosen == ESCAPE).sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        mine = chosen == s
        if s == ESCAPE:
            words[place[mine] + 1] = values[start[mine]]
            word = np.uint64(0)
        else:
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])
            word = np.bitwise_or.reduce(values[start[mine][:, None] + np.arange(COUNTS[s])] << shifts, axis=1)
        words[place[mine]] = word | np.uint64(s) << np.uint64(60)
    return words, np.column_stack([place[::BLOCK], start[::BLOCK]])


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first n numbers (uint64) of words."""
    if not n:
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(chosen == ESCAPE).tolist():  # an escape's raw word may look like one itself
        if not raw[i]:
            raw[i + 1] = True
    place = np.flatnonzero(~raw)
    chosen = chosen[place]
    counts = np.array([*COUNTS, 1])[chosen]
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        mine = chosen == s
        if s == ESCAPE:
            out[start[mine]] = words[place[mine] + 1]
        elif s:
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])
            mask = np.uint64((1 << BITS[s]) - 1)
            out[start[mine][:, None] + np.arange(COUNTS[s])] = words[place[mine]][:, None] >> shifts & mask
    return out[:n]


def decode_from(words: np.ndarray, blocks: np.ndarray, n: int, first: int, count: int) -> np.ndarray:
    """Numbers first to first + count alone, from the blocks that hold them (n: numbers in all words)."""
    lo = int(np.searchsorted(blocks[:, 1], first, side="right")) - 1
    hi = int(np.searchsorted(blocks[:, 1], first + count, side="left"))
    end, stop = blocks[hi].tolist() if hi < len(blocks) else (len(words), n)
    begin, base = blocks[lo].tolist()
    return decode(words[begin:end], stop - base)[first - base : first - base + count]
