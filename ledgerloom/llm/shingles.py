"""Word shingles as 64-bit fingerprints, one whole text at a time."""

from __future__ import annotations

import numpy as np

#: Odd, so that it has an inverse modulo 2**64; any odd constant serves.
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors that tell the places in a shingle apart.
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; sums by them tell windows of one short length apart."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit value for each word, in order; a word is a run of bytes that are not white space.

    Each byte is scrambled together with its place in the word before the sum is
    taken, so that no arithmetic between places (as powers of one base have it)
    makes chosen words equal.
    """
    if not data:
        return np.zeros(0, dtype=np.uint64)
    b = np.frombuffer(data, dtype=np.uint8)
    solid = np.concatenate(([False], ~_WHITE[b], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    size = end - start
    inside = b[solid[1:-1]].astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, size)
    each = mix(inside + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1))
    return mix(np.add.reduceat(each, first) + size.astype(np.uint64))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct fingerprints of a text's shingles.

    A-Z are lower-cased. A text with fewer words than ``width`` has its whole
    word sequence as its one shingle; a text without words, or null, has none.
    """
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out += words[i : i + n] * _PLACE[i % len(_PLACE)]
        if i % len(_PLACE) == len(_PLACE) - 1:
            out = mix(out)
    out = mix(out)
    return np.unique(out)
