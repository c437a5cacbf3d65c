"""Five-word shingle sets as sorted 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Rows of a band and bands. Two sets of similarity 0.75 share no band with probability
#: (1 - 0.75 ** ROWS) ** BANDS, 2e-5; of similarity 0.8 with 1e-7.
ROWS, BANDS = 5, 40
HASHES = ROWS * BANDS
#: Shingles hashed at once; bounds memory for long texts.
CHUNK = 1024

_draw = np.random.default_rng(5)
_PLACE = _draw.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_FACTOR = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADDED = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit (a 64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words of the text with A-Z lower-cased, words being
    cut at ASCII white space. Fewer words make one shingle of all; no word makes none."""
    if not text:
        return np.zeros(0, np.uint64)
    words = text.encode("utf-8", "replace").lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(hashes):
        return hashes
    if len(hashes) < size:
        hashes = np.concatenate([hashes, np.full(size - len(hashes), 1, np.uint64)])
    n = len(hashes) - size + 1
    total = hashes[:n] * _PLACE[0]
    for k in range(1, size):
        total += hashes[k : k + n] * _PLACE[k]
    return np.unique(mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    found = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), CHUNK):
        np.minimum(found, (low[at : at + CHUNK] * _FACTOR + _ADDED).min(axis=0), out=found)
    return found


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        total = mixed(total + rows[:, k] * _PLACE[k])
    return total.view(np.int64)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for the whole set."""
    value = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)
