"""Words, word hashes and window hashes of whole Arrow batches, without a Python call per word.

A word is a longest run of bytes other than space and \\t \\n \\v \\f \\r in the UTF-8 text. Texts
come in as binary columns; batches are cut into slices of bounded bytes, whole texts each, so that
memory does not follow the length of a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U = np.uint64
_M1, _M2, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA24BAED4963EE407)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U(32))) * _M2
    h = (h ^ (h >> U(29))) * _M1
    return h ^ (h >> U(32))


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE_BYTES`` of text, one row at least."""
    for batch in batches:
        _, at = binary_parts(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(at, at[row] + SLICE_BYTES, side="right")) - 1
            stop = min(max(stop, row + 1), batch.num_rows)
            yield batch.slice(row, stop - row)
            row = stop


def whole_row(docs: DataFrame) -> Column:
    """All columns as ``row``, whatever their names."""
    return F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]).alias("row")


class Words:
    """Word borders in a binary column: ``start``/``end`` in ``data``, ``first`` per row."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.offsets = binary_parts(column)
        self.rows = len(self.offsets) - 1
        n = len(data)
        # Eight bytes more, so that a word can be read in whole steps of eight.
        self.data = np.zeros(n + 8, np.uint8)
        self.data[:n] = _LOWER[data] if lower else data
        ink = np.zeros(n + 2, dtype=bool)
        np.logical_not(_WHITE[self.data[:n]], out=ink[1 : n + 1])
        begins = ink[1:] & ~ink[:-1]  # position i: a word begins at byte i
        ends = ink[:-1] & ~ink[1:]  # position i: a word ends before byte i
        edges = self.offsets[1:-1]
        cut = edges[(edges > 0) & (edges < n)]
        cut = cut[ink[cut] & ink[cut + 1]]  # a text border inside a run of ink
        begins[cut] = True
        ends[cut] = True
        self.start = np.flatnonzero(begins[:n])
        self.end = np.flatnonzero(ends[: n + 1])
        self.first = np.searchsorted(self.start, self.offsets)
        self.first[-1] = len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, from all its bytes."""
        size = self.end - self.start
        h = mix(size.astype(np.uint64) * _M1 + _STEP)
        eight = np.lib.stride_tricks.as_strided(
            self.data[:8].view(np.uint64) if len(self.data) == 8 else np.frombuffer(self.data, np.uint64, 1),
            shape=(len(self.data) - 7,),
            strides=(1,),
        )
        todo, at = np.arange(len(size)), 0
        while len(todo):
            part = eight[self.start[todo] + at]
            left = np.minimum(size[todo] - at, 8).astype(np.uint64)
            part = part & (~U(0) >> (U(64) - left * U(8)))
            h[todo] = mix((h[todo] ^ part) * _M1 + _STEP)
            at += 8
            todo = todo[size[todo] > at]
        return h


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Ordered hash of every ``n`` consecutive values, by joining windows of doubled length."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    done, out, power, width = 0, None, h, 1
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, done = power, width
            else:
                size = len(h) - done - width + 1
                out = out[:size] + power[done : done + size] * _pow(done)
                done += width
        rest >>= 1
        if rest:
            size = len(power) - width
            power = power[:size] + power[width:] * _pow(width)
            width *= 2
    return mix(out)


def _pow(n: int) -> np.uint64:
    return U(pow(int(_STEP) | 1, n, 1 << 64))


def window_rows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of every window of ``n`` words inside one text."""
    rows = words.row_of_word()
    if len(rows) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    return at, rows[at]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` for each i, ``counts[i]`` values."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal ``keys`` from a sorted stream; only one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None

    def flush():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield flush()
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield flush()
