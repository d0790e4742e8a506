"""Suffix arrays by induced sorting, vectorised bucket by bucket.

Suffixes are classified as larger or smaller than their right neighbour. The leftmost smaller ones
(LMS) cut the text into substrings; these are sorted by induction and named, the string of names is
sorted in turn, and the order of all suffixes is induced from it in two scans over the buckets.
Positions take four bytes and characters two where they fit: short keys are sorted by radix.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last position is the sentinel's."""
    n = len(text)
    # equal neighbours take the type of the next unequal pair
    unequal = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.zeros(n, bool)
    if len(unequal):
        rises = text[unequal + 1] > text[unequal]
        smaller[:unequal[-1] + 1] = np.repeat(rises, np.diff(unequal, prepend=-1))
    smaller[-1] = True
    return smaller


def _left(text, wanted):
    """For each position the character on its left, where that one is wanted, else ``len(starts)`` at least."""
    none = np.iinfo(text.dtype).max
    out = np.full(len(text), none, text.dtype)
    np.copyto(out[1:], text[:-1], where=wanted[:-1])
    return out


def _induce(text, smaller, starts, ends, seeds):
    """Suffix order from LMS suffixes in the given order: larger types forward, smaller backward."""
    n, sigma = len(text), len(starts)
    order = np.full(n, -1, seeds.dtype)
    keys = text[seeds]
    by_bucket = np.argsort(keys, kind="stable")
    seed_sorted, key_sorted = seeds[by_bucket], keys[by_bucket]
    seed_from = np.searchsorted(key_sorted, np.arange(sigma + 1))

    left = _left(text, ~smaller)
    head = starts.copy()
    for c in range(sigma):  # larger suffixes: a bucket's own, then its seeds, induce to the right
        done = starts[c]
        while True:
            wave = order[done:head[c]]
            done = head[c]
            if not len(wave):
                break
            _append(left, order, head, wave, False)
        _append(left, order, head, seed_sorted[seed_from[c]:seed_from[c + 1]], False)

    larger_end = head  # the larger suffixes of each bucket end here
    left = _left(text, smaller)
    tail = ends.copy()
    for c in range(sigma - 1, -1, -1):  # smaller suffixes, from the ends
        done = ends[c]
        while True:
            wave = order[tail[c]:done][::-1]
            done = tail[c]
            if not len(wave):
                break
            _append(left, order, tail, wave, True)
        _append(left, order, tail, order[starts[c]:larger_end[c]][::-1], True)
    order[0] = n - 1  # the sentinel
    return order


def _append(left, order, edge, wave, backward):
    """Puts the left neighbours of ``wave`` of the wanted type at the edges of their buckets."""
    if not len(wave):
        return
    keys = left[wave]
    wanted = np.flatnonzero(keys != np.iinfo(keys.dtype).max)
    if not len(wanted):
        return
    keys = keys[wanted]
    by_key = np.argsort(keys, kind="stable")
    before, keys = wave[wanted[by_key]] - 1, keys[by_key]
    first = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    first = [0, *first.tolist(), len(keys)]
    for a, b in zip(first[:-1], first[1:]):
        c = keys[a]
        if backward:
            order[edge[c] - (b - a):edge[c]] = before[a:b][::-1]
            edge[c] -= b - a
        else:
            order[edge[c]:edge[c] + b - a] = before[a:b]
            edge[c] += b - a


def _sort_names(names: np.ndarray, spans: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of the suffixes of the string of names, doubling the compared length each round, until
    all differ or ``depth`` characters of text are compared (``spans``: least length of a name).
    A round sorts those that are not yet alone in their rank, the first place of their group."""
    n, width, least = len(names), 1, int(spans.min())
    order = np.argsort(names, kind="stable")
    new = np.concatenate([[True], names[order[1:]] != names[order[:-1]]])
    first = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(first, np.diff(first, append=n))
    rank[n] = -1  # what follows the end is smaller than every name
    places = np.flatnonzero(~(new & np.append(new[1:], True)))  # of groups of several
    while len(places) and width < n and not (depth is not None and width * least >= depth):
        own = order[places]
        group = rank[own]
        key = group * (n + 1) + rank[np.minimum(own + width, n)] + 1
        by_key = np.argsort(key, kind="stable")
        own, key = own[by_key], key[by_key]
        order[places] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        rank[own] = np.repeat(places[first], np.diff(first, append=len(own)))
        places = places[~(new & np.append(new[1:], True))]
        width *= 2
    return order


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Order of all suffixes of ``text``, whose last value must be 0 and its only one.

    With ``depth``, suffixes that agree on their first ``depth`` characters may come in any order
    among themselves.
    """
    n, sigma = len(text), int(text.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    text = text.astype(np.uint16 if sigma < 2 ** 16 else np.int64, copy=False)
    smaller = classify(text)
    counts = np.bincount(text, minlength=sigma)
    ends = np.cumsum(counts)
    starts = ends - counts
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32 if n < 2 ** 31 else np.int64)
    order = _induce(text, smaller, starts, ends, lms)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ranked = order[order >= 0]
        ranked = ranked[is_lms[ranked]]
        names = _name(text, lms, ranked)
        spans = np.append(np.diff(lms), 1)
        spans[-1] = max(1, int(spans[:-1].min()))
        seeds = lms[_sort_names(names, spans, depth)]
        order = _induce(text, smaller, starts, ends, seeds)
    return order


def _name(text, lms, ranked):
    """Ranks of the LMS substrings in text order; equal substrings share one."""
    number = np.empty(len(text), np.int32)
    number[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms) + 1, 1)
    index = number[ranked]
    own = length[index]
    same = own[1:] == own[:-1]
    todo = np.flatnonzero(same)
    left, right, last = ranked[:-1][todo], ranked[1:][todo], own[1:][todo]
    k = 0
    while len(todo):  # character by character, dropping pairs that differ or are through
        equal = text[left + k] == text[right + k]
        same[todo[~equal]] = False
        k += 1
        on = np.flatnonzero(equal & (last > k))
        todo, left, right, last = todo[on], left[on], right[on], last[on]
    names = np.empty(len(lms), np.int64)
    names[index] = np.concatenate([[0], np.cumsum(~same)])
    return names


def shares_prefix(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Permuted common prefixes against a limit: for each position of the text, whether its suffix
    and the one before it in the order agree on ``length`` characters. Compared in text order, eight
    characters at a time."""
    n = len(text)
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, bool)
    todo = np.flatnonzero((before >= 0) & (np.arange(n) + length <= n) & (before + length <= n))
    before = before[todo]
    low = np.append((text & 255).astype(np.uint8), np.zeros(7, np.uint8))
    packed = np.ndarray(n, np.uint64, low, strides=(1,))
    steps = list(range(0, max(length - 7, 1), 8))
    if length >= 8 and steps[-1] != length - 8:
        steps.append(length - 8)
    for k in steps if length >= 8 else []:
        on = np.flatnonzero(packed[todo + k] == packed[before + k])
        todo, before = todo[on], before[on]
    if length < 8:
        for k in range(length):
            on = np.flatnonzero(text[todo + k] == text[before + k])
            todo, before = todo[on], before[on]
    out[todo] = True
    return out
