"""Hashed runs of words, and fingerprints of them."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

SEED = 42


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, A-Z lower-cased; of the whole sequence if there are fewer words."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes, as a signed 64-bit number."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 15):
        block = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])
