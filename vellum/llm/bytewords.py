"""Vectorised word handling on Arrow string buffers.

A *word* is a maximal run of ASCII letters, ASCII digits or bytes >= 0x80 (so every non-ASCII
character belongs to a word), which is the same as the regular expression
``[a-zA-Z0-9\\x{80}-\\x{10FFFF}]+``.  Everything here works on whole batches with numpy: no Python
loop runs over words or documents.  Null texts count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BYTE = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTE[_lo:_hi] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xD1342543DE82EF95)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


_PI, _QI = _inverse(_P), _inverse(_Q)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 20:  # 8 MB for each base; more would stay in every worker
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a batch of texts; ``first[d]:first[d + 1]`` are those of text d."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans stand in order.  A block of bytes is worked on at a time, as eight bytes are held for each."""
    out = np.empty(len(start), dtype=np.uint64)
    a = 0
    while a < len(start):
        z = max(a + 1, int(np.searchsorted(end, start[a] + block, "right")))
        low, n = start[a], int(end[z - 1] - start[a])
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data[low : low + n].astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=total[1:])
        out[a:z] = mix((total[end[a:z] - low] - total[start[a:z] - low]) * powers(_PI, n + 1)[start[a:z] - low])
        a = z
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return data, at - at[0]


def words(texts: pa.Array, lower: bool = True) -> Words:
    if lower and len(texts):
        texts = pc.utf8_lower(texts)
    data, at = buffers(texts)
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(data, at, none, none, np.zeros(len(at), dtype=np.int64))
    inside = WORD_BYTE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of k words that lies inside one text, and the windows' first words."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(_Q, n), out=total[1:])
    found = mix((total[k:] - total[: n - k + 1]) * powers(_QI, n)[: n - k + 1])
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(ends[: n - k + 1] - np.arange(n - k + 1) >= k)
    return found[at], at


def trim() -> None:
    """Gives memory that is free back to the system: a worker lives on after its task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows, of about ``limit`` bytes of text (one row may exceed it)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    trim()
