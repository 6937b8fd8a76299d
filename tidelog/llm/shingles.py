"""Word shingles of whole texts as 64-bit hashes, for use inside Spark tasks."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64), elementwise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of ``text``: runs outside ASCII white space, A-Z lower-cased.

    ``bytes.split`` separates at exactly the six ASCII white-space bytes, and
    ``bytes.lower`` changes only A-Z.
    """
    if not text:
        return np.empty(0, U64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def multiplier(i: int) -> np.uint64:
    """The odd factor of the ``i``-th word of a shingle."""
    return U64((_ODD[i % len(_ODD)] + 2 * (i // len(_ODD))) & (2**64 - 1))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of ``width`` consecutive words.

    Fewer words than ``width`` make one shingle of the whole sequence; no words
    make none.
    """
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    total = np.zeros(n, U64)
    for i in range(min(width, len(h))):
        total += h[i : i + n] * multiplier(i)
    if len(h) < width:
        total += U64(len(h))
    total = np.sort(mix(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]
