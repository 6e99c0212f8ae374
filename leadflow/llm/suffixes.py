"""Suffix arrays by induced sorting, and permuted common prefixes (numpy, inside tasks).

The array of one shard is built in whole-array steps:

* suffixes are classed as smaller (S) or larger (L) than their right neighbour;
* the leftmost-smaller substrings are put in order by inducing from their first
  characters, and named; the string of names is sorted in the same way one
  level down, by doubling the compared length there;
* from the sorted leftmost-smaller suffixes, the L suffixes are induced by one
  pass over the buckets upwards, the S suffixes by one pass downwards. A bucket
  is handled as a whole: what it induces goes to the heads (tails) of later
  buckets, and again into itself as long as characters repeat.

Common prefixes are computed in text order. Where the character before a
suffix equals the one before its predecessor in the array, the value is its
left neighbour's less one; the rest, the irreducible ones, are compared
directly, eight bytes at a time.
"""

from __future__ import annotations

import numpy as np


def _is_smaller(s: np.ndarray) -> np.ndarray:
    """Type S per suffix; the end of the string is smaller than any character."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = (s[:-1] < s[1:]).astype(np.int8) - (s[:-1] > s[1:]).astype(np.int8)
    step[-1] = -1
    where = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    return step[nearest] > 0


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that the leftmost-smaller suffixes, in the order given, induce."""
    n = len(s)
    count = np.bincount(s, minlength=sigma)
    end = np.cumsum(count)
    head = end - count
    n_large = np.bincount(s[~smaller], minlength=sigma)
    sa = np.full(n, -1, np.int64)
    chars = np.flatnonzero(count).tolist()

    # leftmost-smaller suffixes by bucket, in their order
    by = s[lms]
    order = np.argsort(by, kind="stable")
    lms_sorted = lms[order]
    lms_end = np.cumsum(np.bincount(by, minlength=sigma))
    lms_head = lms_end - np.bincount(by, minlength=sigma)

    def place(items: np.ndarray, front: np.ndarray, up: bool) -> None:
        """Appends items to their buckets, at the heads or before the tails."""
        c = s[items]
        o = np.argsort(c, kind="stable")
        c = c[o]
        first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        runs = np.diff(np.append(first, len(c)))
        within = np.arange(len(c)) - np.repeat(first, runs)
        if up:
            sa[front[c] + within] = items[o]
            front[c[first]] += runs
        else:
            sa[front[c] - 1 - within] = items[o]
            front[c[first]] -= runs

    front = head.copy()
    # the last suffix is L and comes first of its bucket
    last = n - 1
    sa[front[s[last]]] = last
    front[s[last]] += 1
    for c in chars:
        done = head[c]
        while done < front[c]:
            upto = front[c]
            before = sa[done:upto] - 1
            done = upto
            before = before[before >= 0]
            before = before[~smaller[before]]
            if len(before):
                place(before, front, True)
        before = lms_sorted[lms_head[c]:lms_end[c]] - 1
        before = before[before >= 0]
        if len(before):
            place(before[~smaller[before]], front, True)
    tail = end.copy()
    for c in reversed(chars):
        done = end[c]
        while done > tail[c]:
            upto = tail[c]
            before = sa[upto:done][::-1] - 1
            done = upto
            before = before[before >= 0]
            before = before[smaller[before]]
            if len(before):
                place(before, tail, False)
        large = sa[head[c]:head[c] + n_large[c]][::-1] - 1
        large = large[large >= 0]
        large = large[smaller[large]]
        if len(large):
            place(large, tail, False)
    return sa


def _order_names(names: np.ndarray) -> np.ndarray:
    """Suffix array of the string of names: doubles the compared length until
    all ranks differ; suffixes that stand alone are left out of later rounds."""
    n = len(names)
    rank = names.astype(np.int64) + 1
    width = 1
    order = np.argsort(rank, kind="stable")
    while True:
        r = rank[order]
        new = np.concatenate(([True], r[1:] != r[:-1]))
        if new.all():
            return order
        # groups keep the place of their first member as rank
        start = np.flatnonzero(new)
        rank_at = np.repeat(start, np.diff(np.append(start, n))) + 1
        rank = np.empty(n, np.int64)
        rank[order] = rank_at
        size = np.diff(np.append(start, n))
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        items = order[open_]
        after = items + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        both = rank_at[open_] * (n + 1) + second
        o = np.argsort(both)
        items, both = items[o], both[o]
        order[open_] = items
        fresh = np.concatenate(([True], both[1:] != both[:-1]))
        at = np.flatnonzero(fresh)
        rank[items] = np.repeat(open_[at], np.diff(np.append(at, len(items)))) + 1
        width *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of small non-negative numbers."""
    s = np.ascontiguousarray(s)
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.uint8) if s.dtype != np.uint8 and s.max() < 256 else s
    sigma = int(s.max()) + 1
    smaller = _is_smaller(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        first = _induce(s, smaller, lms, sigma)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        in_order = first[is_lms[first]]
        # a substring runs to the next leftmost-smaller position; equal bytes and equal length share a name
        size = np.full(n, 0, np.int64)
        size[lms[:-1]] = np.diff(lms) + 1
        size[lms[-1]] = n - lms[-1] + 1
        a, b = in_order[:-1], in_order[1:]
        same = (size[a] == size[b]) & (np.maximum(a, b) + size[a] <= n)
        same[same] = _equal(s, a[same], b[same], size[a[same]])
        name = np.zeros(n, np.int64)
        name[in_order] = np.concatenate(([0], np.cumsum(~same)))
        if int(name[in_order[-1]]) + 1 < len(lms):
            lms = lms[_order_names(name[lms])]
        else:
            lms = in_order
    return _induce(s, smaller, lms, sigma)


def _words(s: np.ndarray) -> np.ndarray:
    """Eight bytes from every position on, as one number each."""
    raw = np.concatenate([s.astype(np.uint8), np.zeros(8, np.uint8)])
    return np.ndarray((len(s) + 1,), "<u8", raw.data, 0, (1,))


def _equal(s: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    return _common(s, a, b, size) >= size


def _common(s: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of the suffixes a and b, up to ``most``."""
    n = len(s)
    eight = _words(s)
    limit = n - np.maximum(a, b)
    if most is not None:
        limit = np.minimum(limit, most)
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        at = out[live]
        x = eight[a[live] + at] ^ eight[b[live] + at]
        low = x & (~x + np.uint64(1))
        got = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
        at = np.minimum(at + got, limit[live])
        out[live] = at
        live = live[(x == 0) & (at < limit[live])]
    return out


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, plcp) in text order: the suffix before each one in the array
    (-1: none) and how long a prefix they share."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = (i > 0) & (before > 0)
    reducible[1:] &= s[:-1] == s[np.maximum(before[1:], 1) - 1]
    own = np.flatnonzero(~reducible)
    value = np.zeros(n, np.int64)
    real = own[before[own] >= 0]
    value[real] = _common(s, real, before[real])
    source = np.maximum.accumulate(np.where(reducible, 0, i))
    return before, np.maximum(value[source] - (i - source), 0)
