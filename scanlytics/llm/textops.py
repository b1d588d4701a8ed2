"""Vectorised scanning of Arrow text batches: words, word hashes, and slices of bounded size.

Everything works on the UTF-8 bytes of a slice of a batch. Word characters are
given by a 256-entry table, so multi-byte characters need no decoding.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False  # words [^\x20\x09-\x0D]+
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.arange(256, dtype=np.uint8)
BLANK[[*range(0x09, 0x0E)]] = 0x20
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def trimmed() -> None:
    """Gives memory that is free but still held by this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut between rows so that each holds about ``limit`` bytes of text (a longer row stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size, dtype=np.int64), 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, edges - edges[0]


class Words:
    """The words of a text column: byte spans, owners and positions.

    ``buf`` ends in 8 spare zero bytes; ``row`` is the owner of each word, ``first`` the
    index of each row's first word (with one more entry at the end).
    """

    def __init__(self, column: pa.Array, table: np.ndarray = SPACES, fold: np.ndarray | None = None) -> None:
        self.scan(*_bytes(column), table, fold)

    @classmethod
    def cut(cls, column: pa.Array, starts) -> Words:
        """Not words but all bytes of each text, cut where ``starts`` of the bytes says and between texts."""
        new = cls.__new__(cls)
        data, new.edges = _bytes(column)
        new.buf = np.concatenate([data, np.zeros(8, np.uint8)])
        begin = np.append(starts(data), False)
        begin[new.edges] = True
        begin[-1] = False
        new.start = np.flatnonzero(begin)
        new.end = np.append(new.start[1:], len(data)) if len(new.start) else new.start
        new.first = np.searchsorted(new.start, new.edges)
        new.count = np.diff(new.first)
        new.row = np.repeat(np.arange(len(new.edges) - 1), new.count)
        return new

    @classmethod
    def of_bytes(cls, data: np.ndarray, edges: np.ndarray, table: np.ndarray = SPACES) -> Words:
        new = cls.__new__(cls)
        new.scan(data, edges, table, None)
        return new

    def scan(self, data: np.ndarray, edges: np.ndarray, table: np.ndarray, fold: np.ndarray | None) -> None:
        n = len(data)
        self.buf = np.zeros(n + 8, np.uint8)
        self.buf[:n] = fold[data] if fold is not None else data
        inside = table[data]
        cut = np.zeros(n + 1, bool)
        cut[edges] = True
        apart = np.ones(n + 1, bool)  # no word goes on across this place
        if n:
            apart[1:n] = ~(inside[:-1] & inside[1:]) | cut[1:n]
        self.start = np.flatnonzero(inside & apart[:-1])
        self.end = np.flatnonzero(inside & apart[1:]) + 1
        self.first = np.searchsorted(self.start, edges)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(edges) - 1), self.count)
        self.edges = edges

    def __len__(self) -> int:
        return len(self.start)

    def heads(self) -> np.ndarray:
        """The first eight bytes of each word, as a number."""
        load = np.ndarray((max(len(self.buf) - 7, 0),), "<u8", self.buf.data, strides=(1,))
        return load[self.start] & _MASK[np.minimum(self.end - self.start, 8)]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        size = self.end - self.start
        load = np.ndarray((max(len(self.buf) - 7, 0),), "<u8", self.buf.data, strides=(1,))
        out = mix((load[self.start] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _A) if len(size) else np.zeros(0, np.uint64)
        more, at = np.flatnonzero(size > 8), 8
        while len(more):
            left = size[more] - at
            out[more] = mix(out[more] * _A + (load[self.start[more] + at] & _MASK[np.minimum(left, 8)]))
            more, at = more[left > 8], at + 8
        return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n consecutive entries; shorter by n - 1."""
    size = max(len(hashes) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    factor = _A
    for j in range(n):
        with np.errstate(over="ignore"):
            out += hashes[j : j + size] * factor
            factor = mix(np.array([factor], np.uint64))[0] | np.uint64(1)
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least entry of every run of ``width`` entries."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin, as indices."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
