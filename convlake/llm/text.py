"""Byte-level helpers over Arrow string columns.

Every helper works on the UTF-8 bytes of a slice of rows laid end to end, with
``offsets`` (n + 1 positions) marking the rows. Null texts are empty. A slice
holds about ``SLICE_BYTES`` bytes; a longer text forms a slice of its own, so
memory follows the longest text, never the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)  # one random odd number per byte value
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(chars: bytes) -> np.ndarray:
    """Boolean table over byte values: True for the given bytes."""
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


SPACE = byte_table(b" \t\n\x0b\x0c\r")
NOT_SPACE = ~SPACE
#: ASCII digits, lower-case ASCII letters and every byte of a non-ASCII character.
ALNUM = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column as large strings without nulls."""
    return batch.column(name).cast(pa.large_string()).fill_null("")


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows end to end, and their offsets from 0."""
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset: arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def slices(arr: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for consecutive rows of at most
    about ``most`` bytes together."""
    most = most or SLICE_BYTES
    data, off = utf8(arr)
    lo, n = 0, len(arr)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        lo = hi


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = max(n, SLICE_BYTES + 1024)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b)]))
                                  for b in (_BASE, _INV))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


class Spans:
    """64-bit hashes of byte ranges of one slice, by prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        up, self.down = POWERS.get(n + 1)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * up[:n], out=self.sum[1:])

    def hash(self, lo, hi) -> np.ndarray:
        """Hash of bytes [lo, hi) for arrays (or slices) of positions."""
        return mix((self.sum[hi] - self.sum[lo]) * self.down[lo])


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``table`` bytes inside each row: starts, ends, and the
    offsets of each row's words (n + 1)."""
    mask = table[data]
    n = len(data)
    cut = off[:-1][off[:-1] < n]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    first[cut] |= mask[cut]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    ends_at = off[1:][off[1:] > 0] - 1
    last[ends_at] |= mask[ends_at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def row_of(off: np.ndarray) -> np.ndarray:
    """Row index of every item, from the items' offsets by row."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def windows(off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``size`` items that stay inside a row, and the
    offsets of each row's windows."""
    n = np.maximum(np.diff(off) - size + 1, 0)
    w = np.concatenate([[0], np.cumsum(n)])
    return np.arange(w[-1]) + np.repeat(off[:-1] - w[:-1], n), w


def combine(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` consecutive items from each start, order kept."""
    out = np.full(len(starts), size, np.uint64)
    for j in range(size):
        out = mix(out * _U(0xC2B2AE3D27D4EB4F) + hashes[starts + j])
    return out


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Boolean mask over n items: inside any [start, start + size)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + size, -1)
    return np.cumsum(d[:n]) > 0


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (or counts) over each row's items."""
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin, begin + 1, ... of ``size`` each, end to end."""
    to = np.cumsum(size)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(begin - (to - size), size)
