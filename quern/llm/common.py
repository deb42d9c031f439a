"""Shared pieces of the training-data operators.

Texts reach Python as Arrow buffers; everything below works on the raw UTF-8
bytes of many documents at once, so the cost per character is a handful of
numpy passes.  A *word* is a maximal run of ASCII letters, ASCII digits and
bytes >= 0x80 inside one document; callers lower-case in the JVM first when
case must not matter.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import drop, root, saved  # noqa: F401

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_ipow = np.ones(1, np.uint64)

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64-bit keys over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse for i < n, modulo 2**64; grown by doubling and kept."""
    global _pow, _ipow
    while len(_pow) < n:
        k = np.uint64(pow(int(_BASE), len(_pow), 1 << 64))
        j = np.uint64(pow(int(_BASE_INV), len(_ipow), 1 << 64))
        _pow, _ipow = np.concatenate([_pow, _pow * k]), np.concatenate([_ipow, _ipow * j])
    return _pow, _ipow


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of n+1 rows, null mask) of a string column; a null row has no bytes."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    nulls = np.zeros(n, bool) if not col.null_count else np.asarray(col.is_null())
    bufs = col.buffers()
    if n == 0 or bufs[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), nulls
    off = np.frombuffer(bufs[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    return np.frombuffer(bufs[2], np.uint8)[: off[-1]], off, nulls


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each (a longer row is a range of its own)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def texts(batch_col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) over a string column."""
    buf, off, _ = bytes_of(batch_col)
    for i, j in slices(off, limit):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of all words; no word crosses a document's border."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = WORD[buf]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    inner = off[(off > 0) & (off < len(buf))]
    s[inner] = w[inner]
    e[inner - 1] = w[inner - 1]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: equal spans have equal hashes wherever they stand."""
    pw, ipw = powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[: len(buf)], out=c[1:])
    return mix((c[ends] - c[starts]) * ipw[starts])


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds of each document's words in that array)."""
    s, e = word_bounds(buf, off)
    return span_hash(buf, s, e), np.searchsorted(s, off).astype(np.int64)


def ngrams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams and their document; a document of fewer words, but one at least, is one gram."""
    per = np.diff(bounds)
    doc = np.repeat(np.arange(len(per)), per)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = bounds[1:][doc] - np.arange(len(h))
    g = h.copy()
    for k in range(1, n):
        nxt = np.zeros_like(h)
        nxt[: len(h) - k] = h[k:] if k < len(h) else 0
        g = np.where(left > k, mix(g * np.uint64(0xD6E8FEB86659FD93) + nxt), g)
    first = np.zeros(len(h), bool)
    first[bounds[:-1][per > 0]] = True
    ok = (left >= n) | (first & (left < n))
    return g[ok], doc[ok]


def lean(run: Callable) -> Callable:
    """run, for mapInArrow; once it ends, memory that it freed goes back to the system, as the worker waits for other tasks."""

    def then(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
                libc.malloc_trim(0)

    return then


class HashIndex:
    """Position of 64-bit keys in an array: open addressing, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, np.uint64)
        bits = max(4, int(len(self.keys) * 3).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        pending = np.arange(len(self.keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(pending):
            free = self.slots[at] < 0
            self.slots[at[free]] = pending[free]
            lost = self.slots[at] != pending
            pending, at = pending[lost], (at[lost] + 1) & self.mask

    def _home(self, q: np.ndarray) -> np.ndarray:
        return ((q * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, q: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where absent."""
        if not len(self.keys):
            return np.full(len(q), -1, np.int32)
        at = self._home(q)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != q))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got = self.slots[at[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[got] != q[todo])]
        return out


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments given by n+1 bounds; empty segments sum to 0."""
    c = np.zeros((len(values) + 1, *values.shape[1:]), np.int64 if values.dtype.kind in "iub" else np.float64)
    np.cumsum(values, axis=0, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Least member of the component of each of n nodes under the edges (a, b), on top of the components in `root`."""
    root = np.arange(n) if root is None else root
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


#: Groups of more rows than this are joined by broadcast: of N rows there are at most N / HOT such groups.
HOT = 1 << 17


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str = "n") -> DataFrame:
    """Inner join of rows with one row a group, which counts the group's rows in `size`; a hot group is no task of its own."""
    few = groups.where(F.col(size) > HOT)
    if few.isEmpty():
        return rows.join(groups, keys)
    hot = rows.join(F.broadcast(few), keys)
    cold = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(groups.where(F.col(size) <= HOT), keys)
    return hot.select(cold.columns).unionByName(cold)
