"""Vectorised helpers over Arrow text batches, shared by the operators of this subpackage.

Everything works on whole batches of UTF-8 bytes with numpy: word boundaries, polynomial (Rabin-Karp) hashes modulo
2**64 of words and of runs of symbols, and sliding minima that pick content-defined anchors. Words are
``[^\\x20\\x09-\\x0D]+``. Hashes of words are mixed once more before they enter a polynomial over words, so the
weakness of power-of-two moduli for very long regular strings does not reach them; words of over 512 bytes are
hashed with xxhash instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20_240_117)
BYTE_CODE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_CODE_LOWER = BYTE_CODE.copy()
BYTE_CODE_LOWER[65:91] = BYTE_CODE[97:123]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of a base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        base = BASES[which]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[which] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Runs:
    """Hashes of runs of a symbol array in constant time each."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        n = len(symbols)
        up, self.down = powers(n, which)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def fixed(self, width: int) -> np.ndarray:
        """Of all runs of one width."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string or binary column into slices of about ``limit`` bytes: first row, row after the last, the bytes and
    the offsets (from 0) of the slice. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, body[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """The words of a slice: byte starts and ends, row of each, first word of each row, 64-bit hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, separator: np.ndarray = SEPARATOR):
        n = len(data)
        rows = len(offs) - 1
        if n:
            word = ~separator[data]
            first = np.ones(n, bool)
            first[1:] = ~word[:-1]
            first[offs[:-1][offs[:-1] < n]] = True
            last = np.ones(n, bool)
            last[:-1] = ~word[1:]
            inner = offs[1:-1]
            last[inner[inner > 0] - 1] = True
            self.start = np.flatnonzero(word & first)
            self.end = np.flatnonzero(word & last) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offs, "left")  # word index of each row's start, and the total
        self.rows = rows
        self.hash = Runs((BYTE_CODE_LOWER if lower else BYTE_CODE)[data]).of(self.start, self.end)
        for k in np.flatnonzero(self.end - self.start > 512):
            import xxhash

            w = data[self.start[k] : self.end[k]].tobytes()
            self.hash[k] = xxhash.xxh64_intdigest(bytes(x + 32 if 65 <= x <= 90 else x for x in w) if lower else w)

    def __len__(self) -> int:
        return len(self.start)


def anchors(grams: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Content-defined anchors. Each window of ``window`` symbols inside one row is owned by the leftmost of its least
    ``gram``-symbol hashes, so equal windows are owned at equal distances. Returns arrays: row, anchor position, first
    owned window start, number of owned starts (consecutive). ``grams[i]`` is the hash at symbol i; ``bounds`` are the
    rows' first symbols and the total.

    Slices must hold under 2**28 symbols; the hashes' other 36 bits decide, and equal ones go to the left.
    """
    span = window - gram + 1
    lengths = np.diff(bounds)
    n = int(bounds[-1])
    starts_per_row = np.maximum(lengths - window + 1, 0)
    empty = np.zeros(0, np.int64)
    if not starts_per_row.any():
        return empty, empty, empty, empty
    key = np.full(n + 2 * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    m = len(grams)
    low = U(28)
    if n >= 1 << 28:
        raise ValueError("a document must hold fewer than 2**28 symbols")
    key[:m] = ((grams >> low) << low) | np.arange(m, dtype=np.uint64)
    size = (n + span) // span * span
    block = key[:size].reshape(-1, span)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: size - span + 1], ahead[span - 1 : size])
    rows = np.repeat(np.arange(len(lengths)), starts_per_row)
    where = np.arange(len(rows)) - np.repeat(np.cumsum(starts_per_row) - starts_per_row, starts_per_row) + np.repeat(bounds[:-1], starts_per_row)
    at = (least[where] & U((1 << 28) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    return rows[begin], at[begin], where[begin], count


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


def take_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, .. for each pair, joined."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(count) - count
    return np.arange(total) - np.repeat(skip, count) + np.repeat(start, count)
