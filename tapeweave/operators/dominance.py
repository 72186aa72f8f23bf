"""Sums over what lies beyond a price in a stretch of rows, for many stretches at once (a merge sort tree in numpy)."""

from __future__ import annotations

import numpy as np


def beyond(prices: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i: the sum of weights of the rows low[i] to high[i] - 1 with a price above bound[i], and the last of these rows (-1: none).

    Level k of the tree has the rows in blocks of 2**k, sorted by price, with sums and last rows from
    each place to its block's end. A stretch is two blocks a level at most.
    """
    total, last = np.zeros(len(low), np.int64), np.full(len(low), -1)
    if not len(prices):
        return total, last
    levels = int(len(prices) - 1).bit_length()
    size = 1 << levels
    distinct, rank = np.unique(prices, return_inverse=True)
    wide = len(distinct) + 1
    rank = np.concatenate([rank, np.zeros(size - len(prices), np.int64)])
    weight = np.concatenate([weights, np.zeros(size - len(prices), np.int64)])
    above = np.searchsorted(distinct, bound, "right")  # the least rank above the bound
    a, b = low.copy(), np.maximum(high, low)
    for k in range(levels + 1):
        blocks = np.arange(size) >> k
        order = np.argsort(blocks * wide + rank, kind="stable")
        key = (blocks * wide + rank)[order]
        to_end = lambda x, f: f.accumulate(x.reshape(-1, 1 << k)[:, ::-1], axis=1)[:, ::-1].ravel()  # noqa: B023, E731
        sums, lasts = to_end(weight[order], np.add), to_end(order, np.maximum)
        for takes, block in (((a < b) & (a & 1 == 1), a), ((a < b) & (b & 1 == 1), b - 1)):
            i = np.flatnonzero(takes)
            at = np.searchsorted(key, block[i] * wide + above[i])
            some = at < (block[i] + 1) << k
            i, at = i[some], at[some]
            total[i] += sums[at]
            last[i] = np.maximum(last[i], lasts[at])
        odd = (a < b) & (a & 1 == 1)
        b = np.where((a < b) & (b & 1 == 1), b - 1, b)
        a = np.where(odd, a + 1, a)
        a, b = a >> 1, b >> 1
    return total, last
