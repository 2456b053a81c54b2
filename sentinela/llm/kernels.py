"""Vectorised byte kernels shared by the Arrow operators of this subpackage.

All kernels work on the raw UTF-8 buffer of an Arrow string column: ``data`` (uint8) and ``offs`` (int64, one
more than the documents). A null text is an empty one.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

U64 = np.uint64
_rng = np.random.RandomState(20240229)
#: A random 64-bit value per byte and an odd base: a polynomial hash modulo 2**64, of at most ``SPAN_BLOCK`` bytes at a
#: time. Over longer stretches such a sum falls on equal values for strings like the Thue-Morse words, whatever the base.
SPAN_BLOCK = 32
BYTE_VALUE = _rng.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BYTE_VALUE_2 = _rng.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so that executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def tidy(run):
    """``run`` over a task's batches; at the end the worker, which lives on, gives memory that it does not use back."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return wrapped


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the life of the worker."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.empty(size, U64)
        have[0] = 1
        filled = 1
        with np.errstate(over="ignore"):
            while filled < size:
                step = have[filled - 1] * base
                have[filled : 2 * filled] = have[:filled] * step
                filled *= 2
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): a bijection that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def pieces(data: np.ndarray, offs: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``most`` bytes (a longer document stands alone): first, last, data, offsets."""
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def doc_of(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The document that holds each byte position."""
    return np.searchsorted(offs, at, side="right") - 1


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes; a document's end also ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` turns a difference of two into the hash of a span."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(table[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands: a span's blocks of ``SPAN_BLOCK`` bytes are
    mixed one by one with their places, summed, and mixed again with the length."""
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    with np.errstate(over="ignore"):
        inv = powers(BASE_INV, len(prefix))
        size = ends - starts
        out = mix((prefix[np.minimum(ends, starts + SPAN_BLOCK)] - prefix[starts]) * inv[starts] + size.astype(U64))
        long = np.flatnonzero(size > SPAN_BLOCK)
        at, most = 0, 1 << 20
        blocks = -(-size[long] // SPAN_BLOCK) - 1
        upto = np.cumsum(blocks)
        while at < len(long):  # about a million blocks at a time
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
            n = blocks[at:end]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            a = np.repeat(starts[long[at:end]], n) + k * SPAN_BLOCK
            b = np.minimum(a + SPAN_BLOCK, np.repeat(ends[long[at:end]], n))
            part = mix((prefix[b] - prefix[a]) * inv[a] ^ mix(k.astype(U64)))
            out[long[at:end]] = mix(out[long[at:end]] + np.add.reduceat(part, np.cumsum(n) - n))
            at = end
        return out


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, document and hash of each word, A-Z lower-cased."""
    starts, ends = word_spans(data, offs)
    return starts, ends, doc_of(offs, starts), span_hash(prefix_hash(LOWER[data]), starts, ends)


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """An order-sensitive hash of each window of ``width`` consecutive word hashes (one per possible start)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, width):
            out = out * U64(0xD6E8FEB86659FD93) + hashes[k : k + n]
            out ^= out >> U64(32)
        return mix(out)


def planes(a: np.ndarray) -> bytes:
    """The array's bytes plane by plane, which suits sorted or small integers, compressed; the size stands in front."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    return raw.nbytes.to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw.nbytes else b"")


def unplanes(b: bytes | pa.Buffer, dtype) -> np.ndarray:
    """The array of ``planes``."""
    size, whole = np.dtype(dtype).itemsize, pa.py_buffer(b)
    n = int.from_bytes(whole[:8], "little")
    raw = np.frombuffer(pa.decompress(whole[8:], decompressed_size=n, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(dtype)


def binary_rows(a: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row of a matrix."""
    size = a.shape[1] * a.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))])


class Slots:
    """An open-addressing table from non-zero 64-bit keys to int32 values, filled and read in whole arrays."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None, room: int = 0):
        n = 0 if keys is None else len(keys)
        self.used = 0
        self._new(max(1024, 1 << (3 * max(n, room) // 2).bit_length()))
        if n:
            self.add(keys, values)

    def _new(self, size: int) -> None:
        self.mask = U64(size - 1)
        self.keys = np.zeros(size, U64)
        self.values = np.full(size, -1, np.int32)

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Slots:
        """The table that has these slots already."""
        out = cls.__new__(cls)
        out.keys, out.values, out.mask, out.used = keys, values, U64(len(keys) - 1), int((keys != 0).sum())
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert distinct keys that are not in the table yet."""
        if 3 * (self.used + len(keys)) > 2 * len(self.keys):
            old = self.keys != 0
            k, v = self.keys[old], self.values[old]
            self._new(1 << int(3 * (self.used + len(keys))).bit_length())
            self._put(k, v)
        self._put(keys, values)
        self.used += len(keys)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = mix(keys) & self.mask
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of several rivals for one slot the last stays
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + U64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is unknown."""
        at = mix(keys) & self.mask
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], -1)
        left = np.flatnonzero((seen != keys) & (seen != 0))
        at = at[left]
        while len(left):
            at = (at + U64(1)) & self.mask
            seen = self.keys[at]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (seen != 0)
            left, at = left[go], at[go]
        return out


ship(__name__)
