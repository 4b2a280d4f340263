"""Words and word shingles of whole Arrow batches as 64-bit hashes, computed in numpy over the UTF-8 bytes.

A word is a maximal run of bytes of a class; both classes used here hold every byte from 0x80 up, so that
working on bytes equals working on characters. A-Z count as a-z.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: [^\\x20\\x09-\\x0D]: what white space leaves.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]: digits, a-z (after lower-casing) and every character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _cache.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        have = _cache[base] = np.cumprod(have)
    return have[:n]


_cache: dict[int, np.ndarray] = {}


#: What operators keep in a worker from task to task, by name: functions that drop it.
KEPT: dict[str, Callable[[], None]] = {}


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, keep: str | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with about `most` bytes of text each (one row at least): (part, bytes, row offsets).

    A null text has no bytes. What other operators have kept in this worker is dropped first, all but that named keep.
    """
    for name, drop in KEPT.items():
        if name != keep:
            drop()
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        text = (text.cast(pa.large_binary()) if text.null_count == 0 else text.cast(pa.large_binary()).fill_null(b""))
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None and text.buffers()[2].size else np.zeros(0, np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    release()


def release() -> None:
    """Give freed memory back to the system: workers stay from task to task, and what they keep adds to the executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, row offsets into them) of the words in every row of a slice."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    inside = kind[low]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * _powers(_BASE, len(data)), dtype=np.uint64)))
    h = mix((total[ends] - total[starts]) * _powers(_INVERSE, len(data) + 1)[starts])
    return h, starts, ends, np.searchsorted(starts, offsets)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words, row ends not minded: len(h) - n + 1 of them."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out += h[i : i + count] * _PLACE[i]
    return mix(out + np.uint64(n))


def shingle_sets(h: np.ndarray, rows: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingles of n words; fewer words give the whole row as one, none give none."""
    all_of = windows(h, n)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= n:
            yield np.unique(all_of[a : b - n + 1])
        else:
            yield windows(h[a:b], int(b - a)) if b > a else all_of[:0]
