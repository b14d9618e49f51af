"""64-bit hashes of words and word shingles over raw UTF-8 bytes, computed with whole-array operations.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return. Equal words have equal
hashes in every task and run. A word hash is a random table polynomial, a shingle hash a polynomial of word hashes; both end with a
bijective mixer.
"""

from __future__ import annotations

import numpy as np

_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, dtype=np.uint64)
WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (xor-shift and odd multiplications)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        step = np.multiply.accumulate(np.full(len(_POWERS), _BASE, dtype=np.uint64))[-1]
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """One hash per word, in text order."""
    kept = np.flatnonzero((raw != 32) & ((raw < 9) | (raw > 13)))
    if not len(kept):
        return np.zeros(0, dtype=np.uint64)
    starts = np.flatnonzero(np.diff(kept, prepend=-2) > 1)
    lengths = np.diff(starts, append=len(kept))
    inside = np.arange(len(kept)) - np.repeat(starts, lengths)
    values = _TABLE[raw[kept]] * _powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * _STEP)


def shingle_hashes(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence when there are fewer; none without words."""
    n = min(k, len(words))
    if not n:
        return words
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = out * _STEP + words[i : i + len(out)]
    return mix(out)


def shingle_set(text: str, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text in lower case (A-Z only)."""
    return np.unique(shingle_hashes(word_hashes(lower_ascii(np.frombuffer(text.encode(), dtype=np.uint8))), k))
