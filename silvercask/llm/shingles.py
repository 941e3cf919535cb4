"""Word shingles as sorted sets of 64-bit hashes.

Words are lower-cased (A-Z only) and cut at the contracts' white space. A shingle's hash mixes its words' hashes
by place; two given shingles share one with a probability of 2**-64.
"""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: Words whose hashes a Python worker keeps.
KEPT = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def words(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text, sorted; of fewer words, all together as one; none without words."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    width = min(k, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total + h[i : len(h) - width + 1 + i] * _ODD[i % 5])
    return np.unique(total)
