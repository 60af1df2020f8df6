"""Words of many texts at once, on Arrow's flat UTF-8 buffers (numpy).

A word is a run of bytes of a class; bytes over 127 belong to it or not as a
whole, so code points are never cut.  Word hashes are polynomials over the
word's bytes mod 2**64, taken as differences of one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 19

#: a-z, 0-9 and everything beyond ASCII, after lower-casing A-Z.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Everything but ASCII white space.
SOLID = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its row offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``size`` bytes.

    A longer text is a chunk of its own, so memory follows the longest text.
    """
    for start in range(0, len(texts), 512):  # copies some rows at a time
        data, offsets = flat(texts.slice(start, 512))
        row, n = 0, len(offsets) - 1
        while row < n:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
            yield start + row, start + end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
            row = end


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i <= n."""
    size = max(CHUNK_BYTES, n) + 1
    if size in _powers:
        return _powers[size]
    both = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                 for b in (BASE, INVERSE))
    if size == CHUNK_BYTES + 1:
        _powers[size] = both
    return both


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters uint64 values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's first word (and the end)."""
    is_in = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], is_in[:-1]]) & ~edge[:-1] if len(data) else is_in
    after = np.concatenate([is_in[1:], [False]]) & ~edge[1:] if len(data) else is_in
    starts, ends = np.flatnonzero(is_in & ~before), np.flatnonzero(is_in & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A uint64 hash of each word's bytes."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


_factors = mix(np.arange(1, 1 << 12, dtype=np.uint64) * np.uint64(BASE))


def checked_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another uint64 hash of each word's bytes: every place in a word has a
    factor of its own, so no words are made to collide as a polynomial's can."""
    global _factors
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(begin)
    most = int((ends - starts).max(initial=0))
    if most > len(_factors):
        _factors = mix(np.arange(1, 2 * most + 1, dtype=np.uint64) * np.uint64(BASE))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _factors[np.minimum(place, len(_factors) - 1)], out=total[1:])
    return mix(total[ends] - total[starts])


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A uint64 hash of each n consecutive words (over row borders too)."""
    m = max(0, len(words) - n + 1)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = out * np.uint64(BASE) + words[j:j + m]
    return mix(out)
