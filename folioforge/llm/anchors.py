"""Content-defined blocks of long texts, as numpy code that runs inside Spark tasks.

Every window of LENGTH bytes belongs to the gram of GRAM bytes inside it that has the smallest
hash (the leftmost of equal ones): its anchor. The choice depends on the window's bytes alone, so
equal windows have equal anchors wherever they stand. Successive windows with the same anchor form
a block; every window is in exactly one block.
"""

from __future__ import annotations

import numpy as np

from folioforge.llm.shingles import mix64

LENGTH, GRAM = 100, 24
#: Bytes that are hashed at once. Longer texts are cut between windows.
PIECE = 1 << 21
_PLACE_BITS = 26  # a place inside a piece; the rest of a sort key is hash
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE, _SECOND = (mix64(np.arange(i, i + 256, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) for i in (1, 1001))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))


_UP, _DOWN = _powers(_BASE, PIECE + 4 * LENGTH), _powers(_INVERSE, PIECE + 4 * LENGTH)


def _prefix(data: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """Prefix sums from which :func:`_span` gets the hash of any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _UP[: len(data)], out=sums[1:])
    return sums


def window_hashes(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each of the first ``n`` windows."""
    return tuple(_span(_prefix(data, t), slice(0, n), slice(LENGTH, LENGTH + n), _DOWN[:n]) for t in (_TABLE, _SECOND))


def _span(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, down: np.ndarray) -> np.ndarray:
    """Polynomial hash of bytes start to end, wherever they stand."""
    return mix64((sums[end] - sums[start]) * down)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` successive values, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def blocks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, whole, start, windows) of each block of the texts data[bounds[i] : bounds[i + 1]].

    anchor and whole are hashes of the anchor and of all bytes of the block, start is its first
    byte in ``data``, windows says how many windows it holds.
    """
    n = len(data)
    if n < LENGTH:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    sums = _prefix(data)
    grams = _span(sums, slice(0, n - GRAM + 1), slice(GRAM, n + 1), _DOWN[: n - GRAM + 1])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    place = (_sliding_min(keyed, LENGTH - GRAM + 1) & low).astype(np.int64)
    fits = np.ones(len(place), bool)  # windows that do not cross the end of a text
    for end in bounds[1:-1]:
        fits[max(0, end - LENGTH + 1) : end] = False
    change = np.empty(len(place), bool)
    change[0] = True
    change[1:] = (place[1:] != place[:-1]) | (fits[1:] != fits[:-1])
    start = np.flatnonzero(change)
    windows = np.diff(np.concatenate([start, [len(place)]]))
    keep = fits[start]
    start, windows = start[keep], windows[keep]
    whole = _span(sums, start, start + windows + LENGTH - 1, _DOWN[start])
    return mix64(grams[place[start]]), whole, start, windows
