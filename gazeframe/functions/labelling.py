"""Components and outlines of many run lists at once, on Arrow batches.

A run list is what :mod:`gazeframe.functions.runs` makes of one mask: ``struct(y, x0, x1)`` in row-major
order. All lists of a batch are laid end to end, so the work is a fixed number of vector operations,
linear in the runs but for sorting: a noisy map costs as much more as it has runs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROW = 1 << 24  # more than any row number
_COLUMN = 1 << 20  # more than any column number


class Runs:
    """Run lists end to end: owner, row and ends of each run, in order."""

    def __init__(self, owner: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, lists: int):
        self.owner, self.y, self.x0, self.x1, self.lists = owner, y, x0, x1, lists

    @classmethod
    def of(cls, column: pa.Array) -> Runs:
        """A null list is an empty one."""
        sizes = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
        flat = column.flatten()
        y, x0, x1 = (np.asarray(flat.field(n)).astype(np.int64) for n in ("y", "x0", "x1"))
        return cls(np.repeat(np.arange(len(column)), sizes), y, x0, x1, len(column))

    def where(self, keep: np.ndarray) -> Runs:
        return Runs(self.owner[keep], self.y[keep], self.x0[keep], self.x1[keep], self.lists)

    @property
    def row(self) -> np.ndarray:
        return self.owner * _ROW + self.y + 2

    def touching(self, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (run, run of the row above) whose columns come within ``reach``."""
        above = (self.row - 1) * _COLUMN
        first = np.searchsorted(self.row * _COLUMN + self.x1 + 1, above + self.x0 - reach + 1, side="left")
        stop = np.searchsorted(self.row * _COLUMN + self.x0 + 1, above + self.x1 + reach + 1, side="right")
        count = np.maximum(stop - first, 0)
        before = np.cumsum(count) - count
        upper = np.arange(count.sum()) + np.repeat(first - before, count)
        return np.repeat(np.arange(len(count)), count), upper

    def labels(self, reach: int) -> np.ndarray:
        """Number of the first run of each run's component, by hooking to the smaller and jumping."""
        a, b = self.touching(reach)
        parent = np.arange(len(self.y))
        while True:
            low = np.minimum(parent[a], parent[b])
            before = parent.copy()
            np.minimum.at(parent, parent[a], low)
            np.minimum.at(parent, parent[b], low)
            while not np.array_equal(jumped := parent[parent], parent):
                parent = jumped
            if np.array_equal(parent, before):
                return parent

    def per_list(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=values, minlength=self.lists)


def _common(a0, a1, b0, b1):
    return np.maximum(0, np.minimum(a1, b1) - np.maximum(a0, b0) + 1)


def outline(runs: Runs) -> np.ndarray:
    """Length of all borders of each list, outer and inner, through pixel centres.

    It follows from counting 2x2 windows: one with exactly two adjacent pixels holds a straight step, one
    with three a diagonal step, one with two opposite pixels two diagonal steps.
    """
    lower, upper = runs.touching(1)
    a0, a1, b0, b1 = runs.x0[upper], runs.x1[upper], runs.x0[lower], runs.x1[lower]
    shared = _common(a0, a1, b0, b1)
    corner = (a1 + 1 == b0).astype(np.int64) + (b1 + 1 == a0)
    slanted = _common(a0 + 1, a1 + 1, b0, b1) + _common(a0 - 1, a1 - 1, b0, b1)
    full = np.maximum(0, shared - 1)
    three = slanted - corner - 2 * full
    meet = lambda v: np.bincount(runs.owner[lower], weights=v, minlength=runs.lists)
    straight = runs.per_list(2 * (runs.x1 - runs.x0)) + meet(2 * shared - 2 * three - 4 * full)
    return straight + math.sqrt(2.0) * meet(three + 2 * corner)


def _background(runs: Runs) -> Runs:
    """Runs of what is not set, inside each mask's box widened by one pixel."""
    lists = np.unique(runs.owner)
    start = np.searchsorted(runs.owner, lists)
    top, bottom = np.minimum.reduceat(runs.y, start) - 1, np.maximum.reduceat(runs.y, start) + 1
    left, right = np.full(runs.lists, 0), np.full(runs.lists, 0)
    left[lists], right[lists] = np.minimum.reduceat(runs.x0, start) - 1, np.maximum.reduceat(runs.x1, start) + 1
    new_row = np.ones(len(runs.y), dtype=bool)
    new_row[1:] = runs.row[1:] != runs.row[:-1]
    ends_row = np.append(new_row[1:], True)
    after = Runs(runs.owner, runs.y, runs.x1 + 1, np.where(ends_row, right[runs.owner], np.append(runs.x0[1:], 0) - 1), runs.lists)
    head = runs.where(new_row)
    before = Runs(head.owner, head.y, left[head.owner], head.x0 - 1, runs.lists)
    height = bottom - top + 1
    owner = np.repeat(lists, height)
    y = np.arange(height.sum()) + np.repeat(top - (np.cumsum(height) - height), height)
    blank = ~np.isin(owner * _ROW + y + 2, head.row)
    empty = Runs(owner[blank], y[blank], left[owner[blank]], right[owner[blank]], runs.lists)
    parts = [np.concatenate([getattr(p, n) for p in (after, before, empty)]) for n in ("owner", "y", "x0", "x1")]
    order = np.lexsort((parts[2], parts[1], parts[0]))
    return Runs(*(p[order] for p in parts), runs.lists)


def filled(runs: Runs) -> Runs:
    """The masks with every hole closed: whatever lies between background that reaches the margin."""
    if not len(runs.y):
        return runs
    back = _background(runs)
    margin = np.searchsorted(back.owner, back.owner)  # the first background run of each list
    open_ = back.where(back.labels(0) == margin)
    same = open_.row[1:] == open_.row[:-1]
    pick = np.flatnonzero(same)
    return Runs(open_.owner[pick], open_.y[pick], open_.x1[pick] + 1, open_.x0[pick + 1] - 1, runs.lists)


def _listed(values: pa.Array, owner: np.ndarray, lists: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=lists))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


_PART = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("area", T.IntegerType())])
COMPONENTS = T.StructType(
    [T.StructField("labels", T.ArrayType(T.IntegerType())), T.StructField("parts", T.ArrayType(_PART))]
)


@F.arrow_udf(COMPONENTS)
def components(column: pa.Array) -> pa.Array:
    """``labels``: for each run the number of its 8-connected component's first run; ``parts``: label and area of each component."""
    runs = Runs.of(column)
    label = runs.labels(1)
    first = np.flatnonzero(label == np.arange(len(label)))
    area = np.bincount(label, weights=runs.x1 - runs.x0 + 1, minlength=len(label)).astype(np.int32)
    start = np.searchsorted(runs.owner, runs.owner)
    own = pa.array((label - start).astype(np.int32))
    parts = pa.StructArray.from_arrays([pa.array((first - start[first]).astype(np.int32)), pa.array(area[first])], names=["label", "area"])
    return pa.StructArray.from_arrays(
        [_listed(own, runs.owner, runs.lists), _listed(parts, runs.owner[first], runs.lists)], names=["labels", "parts"]
    )


@F.arrow_udf(T.DoubleType())
def outer_border(column: pa.Array) -> pa.Array:
    """Length of the outer borders of each mask, holes closed."""
    return pa.array(outline(filled(Runs.of(column))))
