"""Counts above many cuts at once, for the arrays of a whole Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _layout(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists and their values, without Python objects; a missing list has no values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lengths.astype(np.int64), column.flatten()


def _numbers(values: pa.Array, missing: float) -> np.ndarray:
    return (values.fill_null(missing) if values.null_count else values).to_numpy(zero_copy_only=False)


def _placed(inside: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Flags laid out for lists of other lengths: surplus ones are left out, absent ones are false."""
    if np.array_equal(lengths, wanted):
        return inside
    out = np.zeros(int(wanted.sum()), dtype=bool)
    common = np.minimum(lengths, wanted)
    within = np.arange(int(common.sum())) - np.repeat(np.cumsum(common) - common, common)
    source = np.repeat(np.cumsum(lengths) - lengths, common) + within
    out[np.repeat(np.cumsum(wanted) - wanted, common) + within] = inside[source]
    return out


def counts_above(prob: pa.Array, target: pa.Array, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: set target pixels; and for every cut the pixels above it, of all and of the set ones.

    Each pixel is put between two cuts once, by binary search, and a histogram of these places is summed from
    above; the number of cuts hardly matters. NaN lies above every cut, as in Spark; a missing value above none.
    """
    lengths, values = _layout(prob)
    other, marks = _layout(target)
    pixels = _numbers(values, -np.inf)
    inside = ~(_numbers(marks, 0) <= 0.5)
    rows, ways = len(lengths), len(cuts) + 1
    order = np.argsort(cuts, kind="stable")
    place = np.searchsorted(cuts[order].astype(pixels.dtype), pixels, side="left")
    cell = np.repeat(np.arange(rows), lengths) * ways + place
    both = cell[_placed(inside, other, lengths)]

    def above(cells: np.ndarray) -> np.ndarray:
        histogram = np.bincount(cells, minlength=rows * ways).reshape(rows, ways)
        suffix = histogram[:, ::-1].cumsum(axis=1)[:, ::-1]
        out = np.empty((rows, len(cuts)), dtype=np.int64)
        out[:, order] = suffix[:, 1:]  # above the k-th cut lie the places after k
        return out

    area = np.bincount(np.repeat(np.arange(rows), other)[inside], minlength=rows)
    return area.astype(np.int64), above(cell), above(both)
