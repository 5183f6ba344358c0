"""Hashed words and word shingles of whole texts; the same values in every process."""

from __future__ import annotations

import numpy as np
import xxhash

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(h: np.ndarray, places: tuple[int, ...], salt: int) -> np.ndarray:
    """A hash of the words at `places` after each start; salts tell different kinds of windows apart."""
    n = len(h) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for k, at in enumerate(places):
        out = (out ^ h[at : at + n]) * _C[k % len(_C)]
        out ^= out >> np.uint64(29)
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct shingles in ascending order: words are split at ASCII white space, A-Z lower-cased.

    A text of fewer words has its whole sequence as its only shingle; one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hash_words(words)
    return np.unique(windows(h, tuple(range(min(size, len(words)))), min(size, len(words))))
