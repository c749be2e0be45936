"""Byte and word kernels in numpy, used inside tasks on whole chunks of rows.

Texts of a chunk lie one after the other in one byte array, as Arrow stores
them. Hashes of any span come from one running sum: with an odd base B and
arithmetic modulo 2**64, ``(S[end] - S[start]) * B**-start`` depends on the
bytes of the span only. Hashes are 64 bits wide; two different spans agree
with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
BYTE_CODES = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=U64) | U64(1)
WORD_CODES = np.random.default_rng(20240918).integers(1, 2**63, 64, dtype=U64) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
# letters and digits of ASCII, and every byte of a longer code point
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x41:0x5B] = ALPHANUMERIC[0x61:0x7B] = True
ALPHANUMERIC[0x80:] = True

_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; kept for the next chunk."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            row = np.full(max(n, 1 << 20), base, dtype=U64)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def running_hash(data: np.ndarray) -> np.ndarray:
    """``n + 1`` running sums from which ``span_hash`` takes any span."""
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_CODES[data] * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    scale = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * scale[start] + (end - start).astype(U64))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and ``n + 1`` offsets. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(
    batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20, rows: int = 60_000
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of at most ``limit`` bytes of text (or one longer row).

    This bounds the memory of the kernels, not the work: all rows are given.
    """
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + rows)
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` bytes, and each text's first run.

    A run ends with its text. The third array has ``n + 1`` entries.
    """
    mask = inside[data]
    before = np.empty(len(mask), dtype=bool)
    after = np.empty(len(mask), dtype=bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    heads = offsets[:-1][offsets[:-1] < len(mask)]
    before[heads] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text, from ``word_spans``' third array."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position; the last ``k - 1`` are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = np.full(n, k, dtype=U64)
    for i in range(k):
        total += words[i : i + n] * WORD_CODES[i % 64] + U64(i)
    return mix(total)


def sort_by_owner(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Order by (owner, value), for owners below 65,536."""
    order = np.argsort(values)
    return order[np.argsort(owner[order].astype(np.uint16), kind="stable")]


class HashIndex:
    """Places of 64-bit keys, by open addressing, for whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.wrap = U64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.keys = np.append(keys, U64(0))
        self.place(np.arange(len(keys), dtype=np.int32))

    def place(self, left: np.ndarray) -> None:
        place = (self.keys[left] * U64(BASE) >> self.shift).astype(np.int64)
        while len(left):
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]
            lost = self.slots[place] != left  # taken before, or by another of these
            left, place = left[lost], (place[lost] + 1) & self.wrap

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key, or -1."""
        place = (wanted * U64(BASE) >> self.shift).astype(np.int64)
        found = self.slots[place]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != wanted))
        while len(open_):
            place[open_] = (place[open_] + 1) & self.wrap
            found[open_] = self.slots[place[open_]]
            here = found[open_]
            open_ = open_[(here >= 0) & (self.keys[here] != wanted[open_])]
        return found


class GrowingIndex:
    """A ``HashIndex`` to which keys are added; slots double as it fills."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, dtype=U64)
        self.inner = HashIndex(self.keys)

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, keys: np.ndarray) -> int:
        """Append new, distinct keys; returns the place of the first."""
        at = len(self.keys)
        self.keys = np.concatenate([self.keys, keys])
        if len(self.keys) * 2 > len(self.inner.slots):
            self.inner = HashIndex(self.keys)
        else:
            self.inner.keys = np.append(self.keys, U64(0))
            self.inner.place(np.arange(at, len(self.keys), dtype=np.int32))
        return at

    def find(self, wanted: np.ndarray) -> np.ndarray:
        return self.inner.find(wanted)
