"""Burrows-Wheeler transform and longest common prefixes of a collection, column by column.

One symbol of each string is inserted per round, from the right; shorter strings
begin later, so that all end in the last round and the early rounds are short.
The transform is only read and written from front to back; a round costs one pass
over what is there and touches the new symbols' neighbours.
"""

from __future__ import annotations

import numpy as np


def collection(strings: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of N strings, right-aligned rows of ``strings`` (symbols 1 to 255, 0 to their left, at most 255 long).

    Returns, in suffix order: the symbol before each suffix (0: the whole string),
    the common prefix with the suffix before it, the string, and the suffix length.
    Equal suffixes are in the order of their strings' earlier rounds; the empty
    suffixes come first."""
    n_strings, width = strings.shape
    # entry i < n_strings is the empty suffix of string i; a symbol counts once its string has begun
    bwt = np.zeros(n_strings, np.uint8)
    lcp = np.zeros(n_strings, np.uint8)
    tag = np.arange(n_strings, dtype=np.int64) << 8
    fresh = np.zeros(n_strings, bool)
    begins = width - lengths
    order = np.argsort(begins, kind="stable")
    starts = np.split(order, np.searchsorted(begins[order], np.arange(1, width)))
    for j in range(1, width + 1):
        begun = starts[j - 1]
        bwt[begun] = strings[begun, width - 1]
        fresh[begun] = True
        n = len(bwt)
        # where each symbol's suffix goes: by symbol, then by place
        order = np.argsort(bwt, kind="stable")
        silent = n - int(np.count_nonzero(bwt))
        rank = np.flatnonzero(fresh[order[silent:]]) + silent
        if not len(rank):
            continue
        at = order[rank]
        own, to = tag[at], rank + (n_strings - silent)
        before, after = order[rank - 1], order[np.minimum(rank + 1, n - 1)]
        here = bwt[at]
        same_before = (bwt[before] == here) & (rank > silent)
        same_after = (bwt[after] == here) & (rank + 1 < n)
        # common prefixes: one more than the least between neighbours of the same symbol
        begin = np.concatenate([np.where(same_before, before + 1, at), np.where(same_after, at + 1, at)])
        end = np.concatenate([at + 1, np.where(same_after, after + 1, at + 1)])
        by = np.argsort(begin, kind="stable")
        ends = np.empty(2 * len(begin), np.intp)
        ends[0::2], ends[1::2] = begin[by], end[by]
        least = np.empty(len(begin), np.uint8)
        least[by] = np.minimum.reduceat(np.append(lcp, np.uint8(0)), ends)[0::2]
        k = len(own)
        up = np.where(same_before, least[:k] + 1, 0)
        down = np.where(same_after, least[k:] + 1, 0)
        own = own + 1
        string, size = own >> 8, own & 255
        symbol = strings[string, np.maximum(width - 1 - size, 0)]
        symbol[size == lengths[string]] = 0

        total = n_strings + n - silent
        fresh = np.zeros(total, bool)
        fresh[to] = True
        old = ~fresh
        new = [np.empty(total, x.dtype) for x in (bwt, lcp, tag)]
        for x, y in zip(new, (bwt, lcp, tag), strict=True):
            x[old] = y
        behind = to + 1
        inside = behind < total
        new[1][behind[inside]] = down[inside]
        for x, y in zip(new, (symbol, up, own), strict=True):
            x[to] = y
        bwt, lcp, tag = new
        fresh[to[symbol == 0]] = False
    return bwt, lcp, (tag >> 8).astype(np.int32), (tag & 255).astype(np.uint8)


def least_of_windows(texts: list[bytes], value: np.ndarray, window: int) -> list[np.ndarray]:
    """For each start of ``window`` bytes in each text: the least ``value`` of any text that holds these bytes.

    Bytes may have any value up to 254; texts are at most 254 bytes long."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(lengths.max())
    rows = np.zeros((len(texts), width), np.uint8)
    rows[np.arange(width) >= (width - lengths)[:, None]] = np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1)
    _, lcp, who, size = collection(rows, lengths)
    # a stretch whose neighbours share at least a window is one window's occurrences
    run = np.flatnonzero(lcp < window)
    least = np.repeat(np.minimum.reduceat(value[who], run), np.diff(np.append(run, len(lcp))))
    is_start = size >= window
    out = np.zeros(int((lengths - window + 1).sum()), value.dtype)
    first = np.cumsum(lengths - window + 1) - (lengths - window + 1)
    out[first[who[is_start]] + lengths[who[is_start]] - size[is_start]] = least[is_start]
    return np.split(out, first[1:])
