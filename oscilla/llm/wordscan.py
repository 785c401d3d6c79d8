"""Vectorised scanning of Arrow string columns: bytes, words and word hashes in numpy.

Every function works on whole texts. A batch is cut into blocks of rows of about ``BLOCK`` bytes,
so memory is bounded by that or by the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
#: Upper-case A-Z to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word once lower-cased: 0-9, a-z and all of non-ASCII letters' bytes.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of a word that only white space ends.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xD6E8FEB86659FD93)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary()).fill_null(b"") if binary else column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row that is longer."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class _Powers:
    """Powers of the byte base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, BLOCK + 1)
            step = np.full(size, _P, np.uint64)
            step[0] = 1
            self.up = np.cumprod(step, dtype=np.uint64)
            step[1:] = _P_INV
            self.down = np.cumprod(step, dtype=np.uint64)


_POWERS = _Powers()


class Rolling:
    """Hashes of any substrings of some bytes, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        _POWERS.upto(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS.up[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray, salt: int = 7) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * _POWERS.down[start] + np.uint64(salt))

    def grams(self, size: int) -> np.ndarray:
        """The hash of the ``size`` bytes from each place on."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * _POWERS.down[:n] + np.uint64(7)) if n > 0 else np.zeros(0, np.uint64)


class Words:
    """Words of a block of rows: ``start``, ``end`` (bytes of the block), ``row`` and 64-bit ``hash``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> None:
        self.bytes = LOWER[raw]
        offsets = offsets - offsets[0]
        n, rows = len(raw), len(offsets) - 1
        member = np.zeros(n + 2, bool)
        member[1:-1] = inside[self.bytes]
        begins = member[1:-1] & ~member[:-2]
        ends = member[1:-1] & ~member[2:]
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[filled] = member[1:-1][filled]
        lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[lasts] = member[1:-1][lasts]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.offsets = offsets
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(rows), self.count)

    @property
    def hash(self) -> np.ndarray:
        """One hash a word, of its bytes alone."""
        return Rolling(self.bytes).hash(self.start, self.end)

    @property
    def digest(self) -> np.ndarray:
        """64 bits of a cryptographic digest of each word's bytes, made once for each distinct word.

        Sums of powers modulo 2^64 agree for some pairs of words whatever their base; these don't.
        """
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
        data = self.bytes[np.repeat(self.start - ends[:-1], np.diff(ends)) + np.arange(ends[-1])]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        blake = hashlib.blake2b
        known = np.frombuffer(b"".join([blake(w, digest_size=8).digest() for w in words.dictionary.to_pylist()]), np.uint64)
        return known[words.indices.to_numpy()]

    def runs(self, hashes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each length up to ``longest``: hashes of the runs of so many words from every word on.

        A run that leaves its row has a hash too; ``fits`` tells which ones to use.
        """
        run = hashes.copy()
        yield 1, mixed(run)
        for length in range(2, longest + 1):
            if len(hashes) < length:
                return
            run = run[: len(hashes) - length + 1] * _Q + hashes[length - 1 :]
            yield length, mixed(run + np.uint64(length))

    def fits(self, length: int) -> np.ndarray:
        """Whether the run of ``length`` words from each word on stays in its row."""
        return self.row[: len(self.row) - length + 1] == self.row[length - 1 :]

    def text(self, word: int, length: int) -> bytes:
        return b" ".join(self.bytes[s:e].tobytes() for s, e in zip(self.start[word : word + length], self.end[word : word + length]))
