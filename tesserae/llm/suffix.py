"""Suffix arrays by induced sorting, and permuted common prefixes, with whole-array operations.

Suffixes are classified as S (smaller than the next) or L; the leftmost S of each run (LMS) are sorted by sorting the
substrings between them: one induction sorts the substrings, equal ones get equal names, and unless all names differ
the suffixes of the string of names, a third as long, are sorted by recursion on it. A last induction from the sorted
LMS suffixes gives the array. An induction is one pass over the buckets of the symbols, each handled in whole-array
rounds, linear in the length. Where there are more than RECURSE names, such a pass over their buckets no longer runs in
whole arrays (measured in the README), and the recursion goes on pairs instead: names of pairs of names, then of pairs
of those, until they differ.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
RECURSE = 1024


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S; the end counts as smaller than any symbol."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int32) - t[:-1])  # of i: next minus this
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    return np.append(np.append(step, -1)[at] > 0, False)


def _push(sa: np.ndarray, pointers: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, up: bool) -> None:
    """Appends suffixes, in order, to their buckets at the pointers: upwards from heads or downwards from tails."""
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    counts = np.bincount(ranked, minlength=len(pointers))
    inside = np.arange(len(ranked)) - (np.cumsum(counts) - counts)[ranked]
    if up:
        sa[pointers[ranked] + inside] = suffixes[order]
        pointers += counts
    else:
        sa[pointers[ranked] - 1 - inside] = suffixes[order]
        pointers -= counts


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of the LMS suffixes induces."""
    n = len(t)
    sa = np.empty(n, np.int32)
    symbols = t[lms]
    by_symbol = lms[np.argsort(symbols, kind="stable")]
    lms_ends = np.cumsum(np.bincount(symbols, minlength=len(starts)))
    head = starts.copy()
    _push(sa, head, t[n - 1 : n], np.array([n - 1], np.int32), True)
    is_l = ~is_s
    for c in range(len(starts)):
        at = starts[c]
        while at < head[c]:
            before = sa[at : head[c]] - 1
            at = head[c]
            before = before[before >= 0]
            before = before[is_l[before]]
            if len(before):
                _push(sa, head, t[before], before, True)
        group = by_symbol[lms_ends[c - 1] if c else 0 : lms_ends[c]]
        if len(group):
            before = group - 1
            _push(sa, head, t[before], before, True)
    tail = ends.copy()
    for c in range(len(starts) - 1, -1, -1):
        at = ends[c]
        while at > tail[c]:
            before = sa[tail[c] : at][::-1] - 1
            at = tail[c]
            before = before[before >= 0]
            before = before[is_s[before]]
            if len(before):
                _push(sa, tail, t[before], before, False)
        before = sa[starts[c] : head[c]][::-1] - 1
        before = before[before >= 0]
        before = before[is_s[before]]
        if len(before):
            _push(sa, tail, t[before], before, False)
    return sa


def suffix_array(t: np.ndarray, recurse: int = RECURSE) -> np.ndarray:
    """t: small symbols -> the starts of its suffixes in ascending order (a prefix before what it begins)."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    counts = np.bincount(t)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = _induce(t, is_s, lms, starts, ends)
    if len(lms) > 1:
        marked = np.zeros(n, bool)
        marked[lms] = True
        ranked = sa[marked[sa]]
        following = np.zeros(n, np.int32)
        following[lms] = np.append(lms[1:], n - 1)
        size = following[ranked] - ranked + 1
        hashes = _substring_hashes(t, ranked, size)
        fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (size[1:] != size[:-1]))
        fresh |= ranked == lms[-1]  # the last one reaches the end, and is like no other
        fresh[1:] |= ranked[:-1] == lms[-1]
        names = np.cumsum(fresh) - 1
        if names[-1] + 1 < len(lms):
            by_place = np.zeros(n, np.int64)
            by_place[ranked] = names
            string = by_place[lms]
            ranked = lms[suffix_array(string.astype(np.int32), recurse) if names[-1] < recurse else _order_of_names(string)]
        sa = _induce(t, is_s, ranked.astype(np.int32), starts, ends)
    return sa


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Suffixes of the string of names in order: each round names pairs of the last round's names, so a name stands for
    twice as many, until all differ."""
    n = len(names)
    rank, reach = names.astype(np.int64) + 1, 1
    while True:
        pair = rank * (n + 1)
        pair[: max(0, n - reach)] += rank[reach:]
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        fresh = np.append(True, ranked[1:] != ranked[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if fresh.all():
            return order
        reach *= 2


def _substring_hashes(t: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    powers, inverses = _powers(len(t))
    sums = np.zeros(len(t) + 1, np.uint64)
    np.cumsum((t.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ (t.astype(np.uint64) << np.uint64(40)) | np.uint64(1)) * powers, out=sums[1:])
    return (sums[start + size] - sums[start]) * inverses[start]


_CACHE: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if len(_CACHE[0]) < n:
        _CACHE[0] = np.cumprod(np.full(n, _BASE, np.uint64))
        _CACHE[1] = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
    return _CACHE[0][:n], _CACHE[1][:n]


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, the length up to `most` of the prefix it shares with the suffix before it in the array.

    A position whose left neighbour symbol equals that of its predecessor's is reducible: it shares one less than the
    position before it. The others are compared directly, in steps that double."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    reducible = phi > 0
    reducible[0] = False
    at = np.flatnonzero(reducible)
    reducible[at] = t[at - 1] == t[phi[at] - 1]
    direct = np.flatnonzero(~reducible & (phi >= 0))
    wide = most + n + 1  # unclipped shares stay exact below `most` plus the distance they are carried
    shared = np.zeros(n, np.int32)
    reach = np.zeros(len(direct), np.int64)
    alive = np.arange(len(direct))
    step = 8
    padded = np.append(t.astype(np.int32), np.full(64, -1, np.int32))
    while len(alive):
        i, j = direct[alive] + reach[alive], phi[direct[alive]] + reach[alive]
        offset = np.arange(step)
        same = (padded[np.minimum(i[:, None] + offset, n)] == padded[np.minimum(j[:, None] + offset, n)]) & (np.maximum(i, j)[:, None] + offset < n)
        ends = np.where(same.all(axis=1), step, same.argmin(axis=1))
        reach[alive] += ends
        alive = alive[(ends == step) & (reach[alive] < wide)]
        step = min(64, step * 2)
    shared[direct] = reach
    here = np.arange(n, dtype=np.int32)
    source = np.maximum.accumulate(np.where(reducible, np.int32(0), here))
    return np.minimum(np.maximum(shared[source] - (here - source), 0), most)
