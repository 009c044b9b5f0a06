"""Exact edit distance by diagonals, for texts of any length.

A diagonal k holds the places (i, i - k) of the two texts. With e edits, how far each diagonal is
reached follows from its neighbours with e - 1 edits, and from there equal characters cost nothing
(Ukkonen 1985, Landau and Vishkin 1989). A path of at most t edits stays on diagonals whose
distances from the first and the last one add up to t, so for a bound t few diagonals count: of
texts that differ by d deletions alone, one for each edit. The bound starts at the difference of
the lengths and grows until the distance lies within it.

Equal runs are found by comparing slices of doubling length; where many diagonals are open, by
numpy over all of them at once, with doubling names: equal stretches of 1, 2, 4 ... characters of both
texts get equal numbers, by sorting, so nothing rests on hashes. Where so many edits would cost more
than the whole table, it is the table, a column in two integers (Myers 1999, Hyyro 2003).

Work: n + d * (d - |difference of lengths| + 1), never more than n * n / 64 by much.
"""

from __future__ import annotations

import numpy as np

#: Open diagonals from which they are worked on together.
TOGETHER = 96
#: Edits beyond the difference of the lengths in the second bound (none in the first), and how bounds grow.
FIRST_SLACK, GROWTH = 4, 4
#: Characters of the longest stretch that has a name.
LONGEST_NAME = 256


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Without what both texts begin and end with."""
    start = _equal_run(a + "\ud800", 0, b + "\udfff", 0)
    a, b = a[start:], b[start:]
    end = _equal_run(a[::-1] + "\ud800", 0, b[::-1] + "\udfff", 0)
    return a[: len(a) - end], b[: len(b) - end]


def _equal_run(a: str, i: int, b: str, j: int) -> int:
    """How many characters from a[i] and b[j] on are equal; the last characters of the texts must differ from all others."""
    begin, step = i, 16
    while a[i : i + step] == b[j : j + step]:
        i, j, step = i + step, j + step, 2 * step
    while step > 1:
        step //= 2
        if a[i : i + step] == b[j : j + step]:
            i, j = i + step, j + step
    return i - begin


def _within(a: str, b: str, bound: int) -> int | None:
    """The distance if it is at most ``bound``, one diagonal after the other."""
    n, m = len(a), len(b)
    a, b = a + "\ud800", b + "\udfff"  # no text holds these
    goal = n - m
    low, high = -((bound - goal) // 2), goal + (bound - goal) // 2
    far = [-2] * (high - low + 3)  # a border on either side
    for e in range(bound + 1):
        rest, now = bound - e, far[:]
        for k in range(max(low, -e, goal - rest), min(high, e, goal + rest) + 1):
            at = k - low + 1
            i = far[at] + 1
            if far[at - 1] >= i:
                i = far[at - 1] + 1
            if far[at + 1] > i:
                i = far[at + 1]
            if i > n:
                i = n
            if i > m + k:
                i = m + k
            if e == 0:
                i = 0
            if a[i] == b[i - k]:
                i += _equal_run(a, i, b, i - k)
            now[at] = i
        far = now
        if far[goal - low + 1] == n:
            return e
    return None


def _names(a: str, b: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For lengths 1, 2, 4 ...: numbers of the stretches that start at each place; equal ones have equal numbers.

    The characters behind the ends equal nothing.
    """
    x, y = (np.frombuffer((t + end).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t, end in ((a, "\ud800"), (b, "\udfff")))
    out, length = [(x, y)], 1
    while 2 * length <= min(LONGEST_NAME, len(x), len(y)):
        x, y = out[-1]
        pair = []
        for z in (x, y):
            after = np.full(len(z), z[-1])
            after[:-length] = z[length:]
            pair.append(z << np.int64(31) | after)
        both = np.unique(np.concatenate(pair), return_inverse=True)[1].astype(np.int64)
        out.append((both[: len(x)], both[len(x) :]))
        length *= 2
    return out


def _within_together(a: str, b: str, bound: int, names: list[tuple[np.ndarray, np.ndarray]]) -> int | None:
    """As :func:`_within`, all open diagonals at once."""
    n, m = len(a), len(b)
    goal = n - m
    low, high = -((bound - goal) // 2), goal + (bound - goal) // 2
    far = np.full(high - low + 3, -2, np.int64)
    for e in range(bound + 1):
        rest = bound - e
        first, last = max(low, -e, goal - rest), min(high, e, goal + rest)
        k = np.arange(first, last + 1)
        at = first - low + 1
        size = len(k)
        i = np.maximum(np.maximum(far[at : at + size], far[at - 1 : at - 1 + size]) + 1, far[at + 1 : at + 1 + size])
        i = np.minimum(np.minimum(i, n), m + k) if e else np.zeros(1, np.int64)
        x, y = names[0]
        open_ = np.flatnonzero(x[i] == y[i - k])
        if len(open_):
            p, q = i[open_], (i - k)[open_]
            x, y = names[-1]
            longest = 1 << (len(names) - 1)
            going = np.flatnonzero(x[p] == y[q])
            while len(going):
                p[going] += longest
                q[going] += longest
                going = going[x[p[going]] == y[q[going]]]
            for level in range(len(names) - 2, -1, -1):
                x, y = names[level]
                step = (x[p] == y[q]).astype(np.int64) << level
                p += step
                q += step
            i[open_] = p
        far[at : at + size] = i
        if first <= goal <= last and far[goal - low + 1] == n:
            return e
    return None


def _table(a: str, b: str) -> int:
    """The distance from the whole table."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down = full, 0
    for c in b:
        match = masks.get(c, 0)
        diagonal = ((match & up) + up ^ up | match | down) & full
        right = down | full & ~(diagonal | up)
        left = diagonal & up
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | full & ~(diagonal | right), right & diagonal
    return len(b) + up.bit_count() - down.bit_count()


def _micros(bound: int, slack: int) -> float:
    """About what a bound costs, in microseconds."""
    diagonals = min(bound, slack) + 1
    return bound * (120 + 0.25 * diagonals) if diagonals > TOGETHER else bound * 0.9 * diagonals


def levenshtein(a: str, b: str) -> int:
    """Edit distance in code points."""
    if a == b:
        return 0
    a, b = _trimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    goal, slack, names = len(a) - len(b), 0, None
    whole = len(b) * (3 + 0.03 * len(a) / 64)
    while slack < 2 * len(b) and _micros(goal + slack, slack) < whole:
        if slack + 1 > TOGETHER:
            names = names or _names(a, b)
            found = _within_together(a, b, goal + slack, names)
        else:
            found = _within(a, b, goal + slack)
        if found is not None:
            return found
        slack = max(FIRST_SLACK, slack * GROWTH)
    return _table(a, b)
