"""Word n-gram sets and their MinHash bands, in numpy, a text at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .common import WORD

_WORD = re.compile(WORD)
_ODD = np.random.default_rng(11).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The most words whose hashes a worker keeps.
MOST_WORDS = 500_000
_known: dict[str, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct n-word shingles; a text of fewer words is one shingle, without
    words none."""
    words = _WORD.findall(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > MOST_WORDS:
        _known.clear()
    hashes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh64_intdigest(w)
        hashes[i] = h
    m = max(1, len(words) - n + 1)
    out = np.full(m, min(n, len(words)), np.uint64)
    for k in range(min(n, len(words))):
        out = _mix(out * _ODD[k]) ^ hashes[k : k + m]
    return np.unique(_mix(out))


def choose_bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that find a pair at the threshold with the given recall within the hashes.

    ValueError if the hashes don't suffice for the recall.
    """
    best = None
    for rows in range(1, most_hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"a recall of {recall} at {threshold} needs more than {most_hashes} hashes")
    return best


def band_hashes(shingles: np.ndarray, bands: int, rows: int, chunk: int = 8192) -> np.ndarray:
    """One 64-bit hash for each band of MinHash values."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), chunk):
        part = shingles[at : at + chunk]
        for k in range(bands * rows):
            least[k] = min(least[k], (part * _ODD[k]).min())
    out = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = _mix(out * _ODD[r]) ^ least[r::rows]
    return _mix(out)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the set, as two signed longs."""
    d = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
