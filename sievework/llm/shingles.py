"""Word shingles of a text as sorted distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
#: Odd multipliers, one for each place of a shingle: fixed values without meaning.
PLACES = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which each bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The set of ``text``: A-Z are lower-cased, and words end at ASCII white space, which is what bytes do.

    With fewer words than a shingle has, the sequence as a whole is one; without words the set is empty.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(hashes) - SIZE + 1
    if n < 1:
        return mix(np.array([np.sum(hashes * PLACES[: len(hashes)]) + np.uint64(len(hashes))], dtype=np.uint64))
    total = hashes[:n] * PLACES[0]
    for k in range(1, SIZE):
        total += hashes[k : n + k] * PLACES[k]
    return np.unique(mix(total))
