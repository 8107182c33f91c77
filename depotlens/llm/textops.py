"""Words, word hashes and shingles of a batch of texts, computed on the bytes of the whole batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INVERSE = pow(_P, -1, 1 << 64)
SHINGLE = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_P) + np.uint64(seed)) | np.uint64(1)


_BYTE = numbered(11, 256)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLACE = numbered(29, SHINGLE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins (one more entry than rows). Null counts as empty."""
    plain = column.cast(pa.large_string()).fill_null("")
    _, ends, data = plain.buffers()
    offsets = np.frombuffer(ends, np.int64, plain.offset + len(plain) + 1)[plain.offset :]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


_powers: dict[int, np.ndarray] = {}  # of the base and of its inverse, as long as the longest batch so far


def _powers_of(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        power = np.full(n, base, np.uint64)
        power[:1] = 1
        _powers[base] = np.multiply.accumulate(power)
    return _powers[base][:n]


def running_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over the values, and inverse powers, for hashes of any piece."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers_of(_P, n), out=sums[1:])
    return sums, _powers_of(_P_INVERSE, n + 1)


def running(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same over bytes."""
    return running_of(_BYTE[data])


def piece_hash(sums: np.ndarray, inverse: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [begin, end), not yet mixed; equal bytes have equal hashes wherever they stand."""
    return (sums[end] - sums[begin]) * inverse[begin]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the row it belongs to."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:n]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:n]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(offsets, begins, side="right") - 1


def folded_word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with A-Z lower-cased."""
    sums, inverse = running(_FOLD[data])
    return mixed(piece_hash(sums, inverse, begins, ends) + (ends - begins).astype(np.uint64))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """For every row the sorted distinct hashes of its five-word shingles.

    A row of one to four words has one shingle of all its words; a row without words has none.
    """
    data, offsets = text_bytes(column)
    begins, ends, rows = words(data, offsets)
    hashes = folded_word_hashes(data, begins, ends)
    counts = np.bincount(rows, minlength=len(column))
    firsts = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashes)
    whole = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        whole += hashes[j : j + len(whole)] * _PLACE[j]
    whole = mixed(whole + np.uint64(SHINGLE))
    out = []
    for i in range(len(column)):
        a, b = firsts[i], firsts[i + 1]
        if b - a >= SHINGLE:
            out.append(distinct(whole[a : b - SHINGLE + 1]))
        elif b > a:
            short = (hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
