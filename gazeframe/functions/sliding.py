"""Order statistics of many ranges of one sequence, for whole Arrow batches.

A sequence is kept as bit planes of its values' ranks, each plane stably sorted by the bits above it. A range then stays
a range from plane to plane, and its k-th smallest value is found with one look at two prefix counts a plane: the cost
of a range is logarithmic in the length of the sequence and does not depend on the length of the range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def kth_in_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """For each range [start, end) its k-th smallest value; k counts from zero and lies inside the range."""
    distinct, ranks = np.unique(values, return_inverse=True)
    low, high, k = starts.astype(np.int64), ends.astype(np.int64), ks.astype(np.int64)
    found = np.zeros(len(k), np.int64)
    for bit in reversed(range(max(len(distinct) - 1, 0).bit_length())):
        ones = (ranks >> bit & 1).astype(bool)
        zeros_before = np.concatenate([[0], np.cumsum(~ones)])
        low_zeros, high_zeros = zeros_before[low], zeros_before[high]
        up = k >= high_zeros - low_zeros
        found |= up.astype(np.int64) << bit
        k -= np.where(up, high_zeros - low_zeros, 0)
        low = np.where(up, zeros_before[-1] + low - low_zeros, low_zeros)
        high = np.where(up, zeros_before[-1] + high - high_zeros, high_zeros)
        ranks = np.concatenate([ranks[~ones], ranks[ones]])
    return distinct[found]


def medians_of_others(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Median of each range without one copy of the value ``own``, which is in it; ranges have two members or more."""
    others = ends - starts - 1
    low, high = (others - 1) // 2, others // 2
    # Where the k-th of the range is not below the own value, the own copy stands at or before it.
    kth = lambda k: kth_in_ranges(values, np.tile(starts, 2), np.tile(ends, 2), np.concatenate([k, k + 1])).reshape(2, -1)
    without = lambda pair: np.where(pair[0] < own, pair[0], pair[1])
    return (without(kth(low)) + without(kth(high))) / 2


def _group_numbers(table: pa.Table, groups: list[str]) -> np.ndarray:
    """Running number of each row's group in a table sorted by group."""
    new = np.zeros(table.num_rows, bool)
    for name in groups:
        codes = table.column(name).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _numbers(table: pa.Table, name: str, missing: float | int, dtype: type) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(missing).to_numpy(zero_copy_only=False).astype(dtype)


def _bounds(group: np.ndarray, index: np.ndarray, radius: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the range of ``member`` rows of its group with an index within the radius."""
    starts, ends = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    before = np.concatenate([[0], np.cumsum(member)])
    for first, last in zip(edges[:-1], edges[1:]):
        line, reach = index[first:last], radius[first:last]
        starts[first:last] = before[first + np.searchsorted(line, line - reach, "left")]
        ends[first:last] = before[first + np.searchsorted(line, line + reach, "right")]
    return starts, ends


#: Rows that are settled together at least.
_ROWS = 8192


def with_range_medians(
    batches: Iterator[pa.RecordBatch], groups: list[str], index: str, radius: str, value: str, least: int, name: str
) -> Iterator[pa.RecordBatch]:
    """Append to each row the median ``value`` of the other rows of its group with an index within its radius.

    Rows come sorted by group and index, and a group has one radius. Rows without ``value`` have no median and are nobody's neighbour, like rows
    without index; fewer than ``least`` neighbours give no median. A row leaves when a later index shows that its range
    is complete, so what is held is what the ranges of waiting rows reach over, whatever the length of a group.
    """
    held, waiting, parts, fresh = None, 0, [], 0

    def settle(table: pa.Table, first: int, final: bool) -> tuple[pa.Table, int, int]:
        """The rows from ``first`` on whose range is complete, the next first row and the first row still needed."""
        group = _group_numbers(table, groups)
        line = _numbers(table, index, np.iinfo(np.int64).min >> 2, np.int64)
        reach = _numbers(table, radius, 0, np.int64)
        open_ = np.zeros(table.num_rows, bool) if final else (group == group[-1]) & (line + reach >= line[-1])
        ready = first + int(np.argmax(open_[first:])) if open_[first:].any() else table.num_rows
        needed = ready
        if ready < table.num_rows:
            top = int(np.searchsorted(group, group[-1], "left"))
            needed = top + int(np.searchsorted(line[top:], line[ready] - reach[ready], "left"))
        have = table.column(value).is_valid().to_numpy() & table.column(index).is_valid().to_numpy()
        values = _numbers(table, value, 0.0, np.float64)
        starts, ends = _bounds(group, line, reach, have)
        asked = have & (ends - starts > max(least, 1))
        asked[:first] = asked[ready:] = False
        median = np.full(table.num_rows, np.nan)
        if asked.any():
            median[asked] = medians_of_others(values[have], starts[asked], ends[asked], values[asked])
        column = pa.array(median[first:ready], pa.float64(), mask=~asked[first:ready])
        return table.slice(first, ready - first).append_column(name, column), ready, needed

    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            fresh += batch.num_rows
        # As many new rows as held ones: a wide range is not gone through again for every batch.
        if fresh < max(_ROWS, held.num_rows if held else 0):
            continue
        table = pa.concat_tables([*([held] if held else []), pa.Table.from_batches(parts)])
        done, ready, needed = settle(table, waiting, False)
        yield from done.to_batches()
        held, waiting, parts, fresh = table.slice(needed), ready - needed, [], 0
    if held or parts:
        table = pa.concat_tables([*([held] if held else []), *([pa.Table.from_batches(parts)] if parts else [])])
        yield from settle(table, waiting, True)[0].to_batches()
