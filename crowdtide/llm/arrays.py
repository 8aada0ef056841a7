"""Texts of an Arrow batch as byte arrays, and hashes of their words, for use inside tasks.

Nothing here makes a Python object per word: words are found and hashed by whole-array operations on the UTF-8 bytes.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time. A longer text is a chunk of its own, never cut.
CHUNK_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20260117))
_ODD = np.uint64(1)
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _ODD
STEP_VALUES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + _ODD
_BASE = int(_rng.integers(0, 1 << 62)) * 4 + 1
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII letters and digits, and every byte of a code point beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: Everything but ASCII white space.
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


class Words(NamedTuple):
    key: np.ndarray  # uint64 hash of each word, ASCII upper case folded
    doc: np.ndarray  # index of its text
    start: np.ndarray  # first byte
    end: np.ndarray  # one past the last byte


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the n+1 offsets between them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into slices of about ``limit`` text bytes: (slice, bytes, offsets)."""
    if not batch.num_rows:
        return
    data, offsets = text_bytes(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit value."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept per worker up to the usual chunk."""
    global _powers
    if len(_powers[0]) < n:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(n, base & _MASK, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if n > 2 * CHUNK_BYTES:
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def words(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray = WORD) -> Words:
    """Maximal runs of ``solid`` bytes within each text."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    inside = solid[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _power_table(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[LOWER[data]] * power[:n], out=total[1:])
    key = mix((total[end] - total[start]) * inverse[start])
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(key, doc, start, end)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words inside one text, and the index of its first word."""
    m = len(w.key) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.key[:m] * STEP_VALUES[0]
    for k in range(1, n):
        h += w.key[k : k + m] * STEP_VALUES[k]
    at = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
    return mix(h[at]), at


def per_doc(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Offsets of each text's rows in arrays ordered by text."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists of ``values`` cut at ``offsets``."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def sorted_unique(values: np.ndarray) -> np.ndarray:
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]
