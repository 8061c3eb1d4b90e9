"""Vectorised word and shingle hashing over Arrow string columns, used inside Spark tasks.

A word is a maximal run of digits, letters and non-ASCII characters; A-Z count as a-z. A shingle is
five consecutive words; a text of one to four words has one shingle, all of its words. Null and
wordless texts have none. All hashing is by fixed constants, so equal texts hash alike everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
HASH_BITS = 50
BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 1 << (64 - HASH_BITS)

_FOLD = np.zeros(256, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POSITION = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into (first row, end row, bytes, offsets) blocks of bounded size.

    A block holds at least one text, so only a text that is longer itself exceeds BLOCK_BYTES.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), lo + BLOCK_DOCS, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word, in order."""
    folded = _FOLD[data]
    n = len(folded)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = folded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(folded * _power("up", _BASE, n), out=total[1:])
    value = (total[end] - total[start]) * _power("down", _INVERSE, n)[start]
    value = mix(value + (end - start).astype(np.uint64) * _POSITION[0])
    return value, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text number, 50-bit hash, times), sorted by text, then hash."""
    word, doc = words(data, offsets)
    if not len(word):
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(0, np.uint64), empty
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    begin = np.cumsum(counts) - counts
    value, owner = [], []
    if len(word) >= WIDTH:
        m = len(word) - WIDTH + 1
        full = np.flatnonzero(doc[WIDTH - 1 :] == doc[:m])
        value.append(sum(word[full + j] * _POSITION[j] for j in range(WIDTH)))
        owner.append(doc[full])
    for size in range(1, WIDTH):
        short = np.flatnonzero(counts == size)
        if len(short):
            value.append(sum(word[begin[short] + j] * _POSITION[j] for j in range(size)) + np.uint64(size))
            owner.append(short)
    value, owner = np.concatenate(value), np.concatenate(owner)
    key = np.sort((owner.astype(np.uint64) << np.uint64(HASH_BITS)) | (mix(value) >> np.uint64(64 - HASH_BITS)))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), times
