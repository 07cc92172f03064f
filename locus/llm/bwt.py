"""Repeated byte strings by interval expansion on a Burrows-Wheeler transform.

The transform of a set of byte strings is built once per piece of work. From the interval of
all rows a queue then extends intervals of equal prefixes backward, breadth first: the rows of
an interval that a symbol precedes map to one interval, whose ends come from the symbol's first
place (C) and its rank counts. Its right border, if no shorter string has written it, gets the
depth as the common prefix of the two rows it parts, and only such intervals are queued. So
each border is written once, common prefixes come by increasing value, and the search stops at
the minimum length: rows with no border between them share that many bytes.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes in the order of their first `depth` symbols (or more).

    The first pass sorts by as many symbols as 64 bits hold, each further one by as many ranks.
    text holds symbols from 0; behind its end there are zeros.
    """
    n, bits = len(text), max(1, int(text.max()).bit_length())
    width = 64 // bits
    padded = np.concatenate([text.astype(np.uint64), np.zeros(width, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = (key << np.uint64(bits)) | padded[i : i + n]
    bits = (n + 1).bit_length()
    per_key = 64 // bits
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        there = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], there[1:] != there[:-1]])).astype(np.uint64)
        if rank[order[-1]] == n:
            return order
        key = rank.copy()
        for i in range(1, per_key):
            key <<= np.uint64(bits)
            key[: max(0, n - i * width)] |= rank[i * width :]
        width *= per_key


def common_prefixes(last: np.ndarray, least: int) -> np.ndarray:
    """The common prefix of rows j - 1 and j of the transform `last`, at j, where it is below `least`, else -1.

    Strings are ended by symbol 0, which is never extended to; so rows that reach an end within
    `least` symbols may be left in the interval of the rows behind them.
    """
    n = len(last)
    step = np.argsort(last, kind="stable").astype(np.int32)  # rows by the symbol before them: C and all ranks
    mapped = np.empty(n, np.int32)  # C[symbol] + rank of each row
    mapped[step] = np.arange(n, dtype=np.int32)
    same = last[step[1:]] == last[step[:-1]]
    before, behind = np.full(n, -1, np.int32), np.full(n, n, np.int32)  # the rows next to each with its symbol
    before[step[1:][same]] = step[:-1][same]
    behind[step[:-1][same]] = step[1:][same]
    prefix = np.full(n + 1, -1, np.int8 if least < 128 else np.int32)
    prefix[0] = prefix[n] = 0
    low, high = np.zeros(1, np.int32), np.full(1, n - 1, np.int32)  # the queue: disjoint intervals in order
    for depth in range(least):
        sizes = high - low + 1
        rows = np.arange(sizes.sum(), dtype=np.int32) + np.repeat((low - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes)
        begin, end, real = before[rows] < np.repeat(low, sizes), behind[rows] > np.repeat(high, sizes), last[rows] > 0
        low, high = np.sort(mapped[rows[begin & real]]), np.sort(mapped[rows[end & real]])
        new = prefix[high + 1] < 0
        low, high = low[new], high[new]
        if len(low) == 0:
            break
        prefix[high + 1] = depth
    return prefix[:n]


def least_owners(strings: list[bytes], owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """How many positions of each string have `least` bytes left, and for all those on end the
    least owner of any of the strings that holds the same `least` bytes somewhere."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings], np.int64)
    used = np.unique(data)
    symbol = np.zeros(256, np.uint16)
    symbol[used] = np.arange(1, len(used) + 1)
    ends = np.cumsum(lengths + 1)
    text = np.zeros(ends[-1], np.uint16)  # zero after each string
    text[np.arange(len(data)) + np.repeat(np.arange(len(strings)), lengths)] = symbol[data]
    order = sorted_suffixes(text, least)
    prefix = common_prefixes(text[order - 1], least)  # the symbol before each suffix, cyclically
    which = np.repeat(np.arange(len(strings)), lengths + 1)
    whole = ends[which] - 1 - np.arange(len(text)) >= least
    by_row = np.where(whole, owner[which], np.iinfo(np.int64).max)[order]
    begin = np.flatnonzero(prefix >= 0)
    low = np.minimum.reduceat(by_row, begin)
    at = np.empty(len(text), np.int64)
    at[order] = np.repeat(low, np.diff(np.append(begin, len(text))))
    return np.maximum(lengths - least + 1, 0), at[whole]


def least_owner(strings: list[bytes], owner: np.ndarray, least: int) -> list[np.ndarray]:
    """least_owners() by string."""
    windows, low = least_owners(strings, owner, least)
    return np.split(low, np.cumsum(windows)[:-1])
