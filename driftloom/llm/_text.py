"""Words and hashed shingles of whole texts, for Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker remembers; then it starts anew. Bounds memory, changes no result.
REMEMBERED = 400_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_P = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(33)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; None has none."""
    return text.encode("utf-8", "replace").split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S)
    h = h * _M1
    h = h ^ (h >> _S)
    h = h * _M2
    return h ^ (h >> _S)


def windows(w: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words."""
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _P + w[k : k + n]
    return mixed(h)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased (A-Z) text's shingles; fewer words are one shingle."""
    tokens = text.encode("utf-8", "replace").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    return np.unique(windows(word_hashes(tokens), min(width, len(tokens))))
