"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed by numpy.

Words are hashed by a polynomial over mapped bytes whose prefix sums give every word at once;
shingles mix the hashes of their words. Everything is a function of the bytes alone.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1
_PIECE = 1 << 20  # bytes hashed together


def _stream(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers from a counter-based generator."""
    out = []
    for k in range(n):
        x = (seed + (k + 1) * 0x9E3779B97F4A7C15) & _MASK
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
        out.append((x ^ x >> 31) | 1)
    return np.array(out, U)


_BYTES, _PLACES, _BASE = _stream(1, 256), _stream(2, 64), int(_stream(3, 1)[0])
_powers = (np.ones(1, U), np.ones(1, U))


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16, 2 * len(_powers[0]) if n < _PIECE else n)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, U)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=U))
        _powers = (out[0], out[1])
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _hash_words(words: list[bytes]) -> np.ndarray:
    b = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _table(len(b) + 1)
    sums = np.empty(len(b) + 1, U)
    sums[0] = 0
    np.cumsum(_BYTES[b] * up[: len(b)], dtype=U, out=sums[1:])
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    return mixed((sums[end] - sums[start]) * down[start] + length.astype(U))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    out, at, weight = [], 0, 0
    for k, w in enumerate(words) if len(words) * 4 > _PIECE or len(text) > _PIECE else ():
        weight += len(w) + 1
        if weight > _PIECE and k > at:
            out.append(_hash_words(words[at:k]))
            at, weight = k, len(w) + 1
    out.append(_hash_words(words[at:]))
    return np.concatenate(out) if len(out) > 1 else out[0]


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``width`` words; of a shorter text its whole
    sequence as one; of a text without words none."""
    h = word_hashes(text)
    if not len(h):
        return h
    w = min(width, len(h))
    n = len(h) - w + 1
    z = h[:n] * _PLACES[0]
    for k in range(1, w):
        z += h[k : k + n] * _PLACES[k]
    return np.unique(mixed(z + U(w)))


def set_class(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set, equal for equal sets."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
