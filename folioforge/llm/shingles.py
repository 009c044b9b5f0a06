"""Word shingles and their min-max signatures, as numpy code that runs inside Spark tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from folioforge.llm.util import Memo

#: Words in a shingle.
WIDTH = 5
#: Bands of a signature, values in a band. Each permutation gives two values, its minimum and its maximum.
BANDS, ROWS = 28, 6
PERMUTATIONS = BANDS * ROWS // 2
#: A pair at the threshold shares no band with this probability at most.
MISSED = 2.1e-6
MEMO_WORDS = 150_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 2048


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the SplitMix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _constants(seed: int) -> tuple[np.ndarray, np.ndarray]:
    raw = mix64(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * _STEP + np.uint64(seed))
    return (raw[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32)[:, None], ((raw[PERMUTATIONS:] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]


_XOR, _ODD = _constants(1)
_words = Memo(xxhash.xxh3_64_intdigest, MEMO_WORDS)


def forget_others() -> None:
    """Empty the memo tables that other operators left in this Python worker."""
    Memo.keep_only(_words)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text: A-Z lower-cased, five words each.

    Fewer words make one shingle of all of them; a text without words has none.
    """
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space count
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    width = min(WIDTH, n)
    m = n - width + 1
    out = np.full(m, width, np.uint64)
    for i in range(width):
        out = out * _STEP + h[i : i + m]
    return np.unique(mix64(out))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    a = mix64(shingles + _STEP)
    return int(np.bitwise_xor.reduce(shingles).view(np.int64)), int(a.sum(dtype=np.uint64).view(np.int64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation of the 32-bit integers."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), _CHUNK):
        y = x[None, i : i + _CHUNK] ^ _XOR
        y *= _ODD
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    return np.concatenate([low, high])


def bands_for(threshold: int) -> tuple[int, int]:
    """Bands and values in a band for a threshold in percent: the longest bands that miss no more than MISSED."""
    for rows in range(ROWS, 1, -1):
        bands = 2 * PERMUTATIONS // rows
        if (1 - (threshold / 100) ** rows) ** bands <= MISSED:
            return bands, rows
    return 2 * PERMUTATIONS, 1


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    rows = sig[: bands * rows].reshape(rows, bands).astype(np.uint64)  # a band never has both values of a permutation
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in rows:
        key = mix64(key * _STEP + r)
    return key.view(np.int64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0
