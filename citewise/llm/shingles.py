"""Word shingles of whole texts as 64-bit hashes, many documents at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from citewise.llm.common import text_bytes

WIDTH = 5
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACES = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
SHORT = np.uint64(0x27D4EB2F165667C5)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE), np.full(size, INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for at least ``size`` places."""
    return _powers(1 << max(16, int(size).bit_length()))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums that give the polynomial hash of any byte range by one difference."""
    up, _ = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every document and one past the last); A-Z count as a-z."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    border = starts[(starts > 0) & (starts < len(raw))]
    opens[border] = inside[border]
    closes[border - 1] = inside[border - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums = prefix_sums(raw)
    _, down = powers(len(raw))
    hashes = mixed((sums[last] - sums[first]) * down[first])
    return hashes, np.concatenate([np.searchsorted(first, starts), [len(first)]]) if len(starts) else np.zeros(1, np.int64)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a text of fewer than five words is one shingle, no words give none."""
    raw, starts, ends = text_bytes(column)
    words, borders = word_hashes(raw, starts, ends)
    n = len(words) - WIDTH + 1
    joined = np.zeros(max(n, 0), np.uint64)
    for i in range(WIDTH if n > 0 else 0):
        joined += words[i : i + n] * PLACES[i]
    joined = mixed(joined)
    found = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        if b - a >= WIDTH:
            own = np.sort(joined[a : b - WIDTH + 1])
            found.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            terms = np.append(words[a:b] * PLACES[: b - a], SHORT)  # the last term keeps short texts apart from shingles
            found.append(mixed(np.add.reduce(terms, keepdims=True)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found
