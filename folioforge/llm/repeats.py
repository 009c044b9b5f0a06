"""Maximal repeats of a few megabytes of text by an enhanced suffix array, inside a Spark task.

The suffix array and the lengths of common prefixes come from ranks by prefix doubling, all in
numpy. The interval tree of common prefixes is scanned with a stack; an interval whose suffixes
are preceded by different bytes (or start a text) is a maximal repeat: it can be extended neither
to the right, as the interval ends there, nor to the left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_FIRST = 7  # bytes in the first rank: 9 bits each, the value 0 stands for the end of a text


def _levels(data: np.ndarray, end: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(words, [(h, rank)]): rank orders all suffixes by their first h bytes, for growing h."""
    n = len(data)
    place = np.arange(n)
    words = np.zeros(n, np.int64)
    for j in range(_FIRST):
        inside = place + j < end
        words[inside] |= (data[(place + j)[inside]].astype(np.int64) + 1) << (9 * (_FIRST - 1 - j))
    order = np.argsort(words, kind="stable")
    rank = _by_class(words[order], order, np.zeros(n, np.int64), None)
    levels, h = [(_FIRST, rank)], _FIRST
    while h < longest:
        size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(size[rank] > 1)
        ahead = active + h
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = rank.copy()
        if len(active):
            new[active[order]] = _by_class(key[order], None, rank[active[order]], rank[active[order]])
        rank, h = new, 2 * h
        levels.append((h, rank))
    return words, levels


def _by_class(key: np.ndarray, order: np.ndarray | None, base: np.ndarray, group: np.ndarray | None) -> np.ndarray:
    """The number of suffixes before each class of equal keys; ``key`` is sorted."""
    n = len(key)
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0)) if n else at
    if group is not None:
        start = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), at, 0))
        return base + first - start
    out = np.empty(n, np.int64)
    out[order] = first
    return out


def _common(words: np.ndarray, levels: list[tuple[int, np.ndarray]], end: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes i and j, pair by pair."""
    n = len(end)
    got = np.zeros(len(i), np.int64)
    most = np.minimum(end[i] - i, end[j] - j)
    for h, rank in reversed(levels):
        a, b = i + got, j + got
        same = (got < most) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        got[same] += h
        np.minimum(got, most, out=got)
    open_ = got < most
    a, b = np.minimum(i + got, n - 1), np.minimum(j + got, n - 1)
    differ = words[a] ^ words[b]
    extra = np.zeros(len(i), np.int64)
    for k in range(1, _FIRST):
        extra += differ >> (9 * (_FIRST - k)) == 0
    return np.where(open_, np.minimum(got + extra, most), got)


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each common-prefix interval; lcp[k] is between suffixes k - 1 and k."""
    stack: list[tuple[int, int]] = []
    for k in range(1, len(lcp) + 1):
        length = lcp[k] if k < len(lcp) else -1
        first = k - 1
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            yield top, first, k - 1
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def repeat_groups(data: np.ndarray, bounds: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of each maximal repeat of ``least`` bytes or more, with all its places.

    The texts are data[bounds[i] : bounds[i + 1]]; repeats do not cross their ends.
    """
    if not len(data):
        return
    sizes = np.diff(bounds)
    end = np.repeat(bounds[1:], sizes)
    words, levels = _levels(data, end, int(sizes.max()))
    start = np.flatnonzero(end - np.arange(len(data)) >= least)
    if len(start) < 2:
        return
    sa = start[np.argsort(levels[-1][1][start], kind="stable")]
    lcp = np.zeros(len(sa), np.int64)
    near = next((rank for h, rank in reversed(levels) if h <= least), np.zeros(len(data), np.int64))
    likely = np.flatnonzero(near[sa[1:]] == near[sa[:-1]]) + 1
    lcp[likely] = _common(words, levels, end, sa[likely - 1], sa[likely])
    opens = np.zeros(len(data), bool)
    opens[bounds[:-1][sizes > 0]] = True
    left = np.where(opens[sa], -1, data[np.maximum(sa - 1, 0)].astype(np.int64))
    turn = np.zeros(len(sa), np.int64)
    turn[1:] = (left[1:] != left[:-1]) | (left[1:] < 0) | (left[:-1] < 0)
    turns = np.cumsum(turn)
    joined = lcp >= least
    lo = np.flatnonzero(~joined & np.concatenate([joined[1:], [False]]))
    hi = np.flatnonzero(joined & np.concatenate([~joined[1:], [True]]))
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if turns[b] == turns[a]:  # the same byte comes before all of them, here and further down the tree
            continue
        own = [0, *lcp[a + 1 : b + 1].tolist()]
        for length, first, last in intervals(own):
            if turns[a + last] > turns[a + first]:
                yield length, sa[a + first : a + last + 1]


def repeated_spans(data: np.ndarray, bounds: np.ndarray, least: int, doc: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, length) of the places of maximal repeats that are not the earliest one.

    doc and offset say where each text comes from; of two places the earlier one is that with the
    smaller doc, or in one document that with the smaller start.
    """
    texts = np.searchsorted(bounds, np.arange(len(data)), side="right") - 1 if len(data) else np.empty(0, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for length, places in repeat_groups(data, bounds, least):
        t = texts[places]
        d, s = doc[t], offset[t] + places - bounds[t]
        first = d == d.min()
        earliest = s[first].min()
        later = ~(first & (s == earliest))
        out.append((d[later], s[later], np.full(int(later.sum()), length)))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))
