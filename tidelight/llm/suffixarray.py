"""Suffix arrays by induced sorting, and permuted common prefixes, over NumPy arrays.

Suffixes are classified as S (smaller than the next one) or L; the leftmost S of each run (LMS)
are sorted first, all others are induced from them, one pass up for L and one down for S. The
passes go bucket by bucket, a bucket's suffixes at once: a suffix in bucket c only ever places
its left neighbour into a bucket that the pass has not left yet. LMS substrings are sorted by an
induction of their own and named; names are then ranked recursively, by pairs that span twice
as many each time, until all differ or they span ``depth`` symbols. Suffixes that agree in
``depth`` symbols stand together, in any order.
"""

from __future__ import annotations

import numpy as np


def s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the least of all."""
    n = len(t)
    at = np.flatnonzero(t[:-1] != t[1:])
    rises = np.append(t[at] < t[at + 1], True)
    return rises[np.searchsorted(at, np.arange(n))]


def _ranks_in_groups(groups: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Place of each element among those of its group, in ``order`` (stable by group)."""
    sorted_ = groups[order]
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    sizes = np.diff(np.append(starts, len(sorted_)))
    out = np.empty(len(groups), np.int64)
    out[order] = np.arange(len(groups)) - np.repeat(starts, sizes)
    return out


def induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, from LMS suffixes in their order."""
    n, size = len(t), int(t.max()) + 1
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int64)
    first = t[lms]
    per = np.bincount(first, minlength=size)
    by_first = np.argsort(first, kind="stable")
    sa[(ends - per)[first] + _ranks_in_groups(first, by_first)] = lms
    used = np.flatnonzero(counts)

    def place(found: np.ndarray, heads: np.ndarray, step: int):
        chars = t[found]
        order = np.argsort(chars, kind="stable")
        sa[heads[chars] + step * _ranks_in_groups(chars, order)] = found
        heads += step * np.bincount(chars, minlength=size)

    heads = starts.copy()
    for c in used:
        at = starts[c]
        while at < heads[c]:
            upto = heads[c]
            left = sa[at:upto] - 1
            left = left[left >= 0]
            left = left[~is_s[left]]
            at = upto
            if len(left):
                place(left, heads, 1)
        left = sa[ends[c] - per[c] : ends[c]] - 1
        left = left[left >= 0]
        if len(left):
            place(left, heads, 1)
    tails = ends - 1
    for c in used[::-1]:
        at = ends[c] - 1
        while at > tails[c]:
            upto = tails[c]
            left = sa[upto + 1 : at + 1][::-1] - 1
            left = left[left >= 0]
            left = left[is_s[left]]
            at = upto
            if len(left):
                place(left, tails, -1)
        left = sa[starts[c] : heads[c]][::-1] - 1
        left = left[left >= 0]
        left = left[is_s[left]]
        if len(left):
            place(left, tails, -1)
    # the least suffix is the last symbol, which nothing induces
    sa[0] = n - 1
    return sa


def _rank(names: np.ndarray, span: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes of ``names``, each of which stands for at least ``span`` symbols."""
    top = int(names.max()) + 1
    if top == len(names) or span >= depth:
        return names
    step = max(span // 2, 1)
    after = np.append(names[step:], np.zeros(min(step, len(names)), np.int64) - 1)[: len(names)]
    _, pairs = np.unique(names * (top + 1) + after + 1, return_inverse=True)
    return _rank(pairs.astype(np.int64), span * 2, depth)


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` in order as far as ``depth`` symbols tell; its last symbol is its least and stands nowhere else."""
    t = np.asarray(t)
    if len(t) < 2:
        return np.arange(len(t))
    is_s = s_types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    sa = induce(t, is_s, lms)
    mark = np.full(len(t), -1, np.int64)
    mark[lms] = np.arange(len(lms))
    in_order = sa[mark[sa] >= 0]
    # equal neighbours: same length and same symbols, compared in steps over those still equal
    ends = np.append(lms[1:], len(t) - 1)
    stop = ends[mark[in_order]]
    a, b = in_order[:-1], in_order[1:]
    left = np.flatnonzero(stop[:-1] - a == stop[1:] - b)
    same = np.zeros(len(a), bool)
    offset = 0
    while len(left):
        left = left[t[np.minimum(a[left] + offset, len(t) - 1)] == t[np.minimum(b[left] + offset, len(t) - 1)]]
        over = a[left] + offset >= stop[left]
        same[left[over]] = True
        left = left[~over]
        offset += 1
    names = np.empty(len(lms), np.int64)
    names[mark[in_order]] = np.append(0, np.cumsum(~same))
    # an LMS substring spans two symbols at least
    ranks = _rank(names, 2, depth)
    return induce(t, is_s, lms[np.argsort(ranks, kind="stable")])


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, in text order, symbols shared with the one before it in ``sa``, up to ``most``.
    ``sa`` must be in exact order.

    Where the symbols before a suffix and before its neighbour agree, the prefix is that of the
    suffix one place earlier less one. Only the others, and every ``most``-th, are compared."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    follows = (phi > 0) & (at > 0) & (t[at - 1] == t[phi - 1]) & (at % most != 0)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero((phi >= 0) & ~follows)
    for k in range(2 * most):
        live = live[(live + k < n) & (phi[live] + k < n)]
        live = live[t[live + k] == t[phi[live] + k]]
        if not len(live):
            break
        out[live] = k + 1
    known = np.maximum.accumulate(np.where(follows, 0, at))
    return np.minimum(out[known] - (at - known), most)
