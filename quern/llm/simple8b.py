"""Simple-8b: 64-bit words, each a 4-bit selector and as many integers as fit in 60 bits."""

from __future__ import annotations

import numpy as np

#: Fixed values of the coding: integers in a word, and bits of each, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15  # an integer of more than 60 bits is the whole word after this one
MARK_EVERY = 256  # words between two marks

#: Index of the narrowest selector for a bit length; past the last: an escape.
_NARROWEST = np.searchsorted(WIDTHS, np.arange(66)).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and marks of unsigned integers. Each word takes as many of the next integers as any
    selector can hold. marks[k] is the number of integers before word k * MARK_EVERY."""
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    need = _NARROWEST[np.frexp(values.astype(np.float64))[1]]  # a rounded-up value only takes more room
    # The widest need among the next c integers, for each c, from two shorter windows.
    choice = np.full(n, len(COUNTS), np.uint8)
    windows = {1: need}
    for s in range(len(COUNTS) - 1, -1, -1):
        c = COUNTS[s]
        if c > n:
            break
        if c > 1:
            half = max(w for w in windows if w < c and w >= c - w)
            most = windows[half]
            windows[c] = np.maximum(most[: n - c + 1], most[c - half : n - half + 1])
        fits = windows[c] <= s
        if not fits.any():
            break  # longer windows need no less and may have less
        choice[: n - c + 1][fits] = s
    steps = np.array([*COUNTS, 1], np.int64)[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    at = np.array(starts, np.int64)
    chosen = choice[at]
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(chosen == len(COUNTS))[:-1]])
    words = np.zeros(len(at) + int((chosen == len(COUNTS)).sum()), np.uint64)
    for s, (c, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = chosen == s
        if mine.any():
            held = values[at[mine][:, None] + np.arange(c)] << (np.arange(c, dtype=np.uint64) * np.uint64(width))
            words[place[mine]] = np.bitwise_or.reduce(held, axis=1) | np.uint64(s) << np.uint64(60)
    large = chosen == len(COUNTS)
    words[place[large]] = np.uint64(ESCAPE) << np.uint64(60)
    words[place[large] + 1] = values[at[large]]
    before = np.zeros(len(words) + 1, np.int64)
    before[place + 1] = np.array([*COUNTS, 0], np.int64)[chosen]
    before[place[large] + 2] = 1
    return words, np.cumsum(before)[:: MARK_EVERY]


def decode(words: np.ndarray) -> np.ndarray:
    """All integers, selector by selector: no loop over words."""
    words = words.astype(np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = _raw_words(selectors)
    counts = np.array([*COUNTS, 0, 0], np.int64)[selectors]
    counts[raw] = 1
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (c, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = (selectors == s) & ~raw
        if mine.any():
            shifted = words[mine][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(width))
            out[starts[mine][:, None] + np.arange(c)] = shifted & np.uint64((1 << width) - 1)
    out[starts[raw]] = words[raw]
    return out


def _raw_words(selectors: np.ndarray) -> np.ndarray:
    """Which words hold an escaped integer: those after an escape that isn't such a word itself."""
    raw = np.zeros(len(selectors), bool)
    skip = -1
    for k in np.flatnonzero(selectors == ESCAPE).tolist():
        if k != skip:
            raw[k + 1] = True
            skip = k + 1
    return raw


def decode_from(words: np.ndarray, marks: np.ndarray, first: int, count: int) -> np.ndarray:
    """``count`` integers from number ``first`` on, decoding only from the mark before it. Marks
    must not fall between an escape and its word: then the mark before serves."""
    k = int(np.searchsorted(marks, first, side="right")) - 1
    while k > 0 and (words[k * MARK_EVERY - 1] >> np.uint64(60)) == ESCAPE:
        k -= 1
    last = int(np.searchsorted(marks, first + count, side="left"))
    part = decode(words[k * MARK_EVERY : (last + 1) * MARK_EVERY + 1])
    return part[first - int(marks[k]) :][:count]
