"""Shingle sets and fast similarity sketches in numpy.

A fast similarity sketch has ``t`` coordinates. In round i < t every element of the set is thrown
into a random coordinate with value i + u, u uniform in [0, 1); in round t + j every element is
thrown into coordinate j. Each coordinate keeps its least value; the rounds end once all are filled,
which 2t rounds guarantee. Coordinates of two sets agree with a probability equal to their Jaccard
similarity, and the number of agreements is concentrated as for t independent hashes.
"""

from __future__ import annotations

import numpy as np

from .wordscan import NON_SPACE, Words, mixed

_SEEDS = mixed(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row: ``size`` words, or all words of a shorter row.

    A shingle's hash is made of the digests of its words.
    """
    words = Words(raw, offsets, NON_SPACE)
    runs: dict[int, np.ndarray] = dict(words.runs(words.digest, size)) if len(words.start) else {}
    sets = []
    for first, count in zip(words.first[:-1].tolist(), words.count.tolist()):
        if not count:
            sets.append(np.zeros(0, np.uint64))
        elif count <= size:
            sets.append(runs[count][first : first + 1].copy())
        else:
            own = np.sort(runs[size][first : first + count - size + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
    return sets


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes: for each coordinate its round and value, packed."""
    n = len(elements)
    best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    low, step = 0, int(1.2 * t * np.log(t) / n) + 1
    while low < 2 * t:
        high = min(2 * t, low + step)
        rounds = np.arange(low, high)
        thrown = mixed(elements[None, :] ^ _SEEDS[low:high, None])
        value = (thrown & np.uint64((1 << 48) - 1)) | (rounds.astype(np.uint64)[:, None] << np.uint64(48))
        into = ((thrown >> np.uint64(48)) * np.uint64(t)) >> np.uint64(16)
        into[rounds >= t] = (rounds[rounds >= t] - t).astype(np.uint64)[:, None]
        np.minimum.at(best, into.ravel().astype(np.int64), value.ravel())
        if int(best.max()) >> 48 != 0xFFFF:
            break
        low, step = high, max(1, step // 4)
    return best


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates, the band's number mixed in."""
    bands = coordinates.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ bands[:, k])
    return key
