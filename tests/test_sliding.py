import numpy as np
import pyarrow as pa
import pytest

from gazeframe.functions import sliding


def test_kth_in_ranges():
    rng = np.random.default_rng(0)
    for n in (1, 2, 37):
        values = rng.integers(0, 9, n).astype(float)
        starts = rng.integers(0, n, 50)
        ends = starts + 1 + (rng.random(50) * (n - starts)).astype(int)
        ks = (rng.random(50) * (ends - starts)).astype(int)
        want = [np.sort(values[a:b])[k] for a, b, k in zip(starts, ends, ks)]
        assert sliding.kth_in_ranges(values, starts, ends, ks).tolist() == want


@pytest.mark.parametrize("rows", [3, 16, 8192])
@pytest.mark.parametrize("one_radius", [True, False])
def test_range_medians(monkeypatch, rows, one_radius):
    """Any batch borders; ties, missing values and indexes, groups of one row, a group without a key."""
    monkeypatch.setattr(sliding, "_ROWS", rows)
    rng = np.random.default_rng(rows)
    for _ in range(20):
        n = int(rng.integers(0, 120))
        group = np.sort(rng.integers(0, 4, n))
        index = np.concatenate([np.sort(rng.integers(-5, 40, (group == k).sum())) for k in range(4)])
        lost = np.array([j == 0 or group[j] != group[j - 1] for j in range(n)], bool) & (rng.random(n) < 0.5)
        radius = np.full(n, 4) if one_radius else rng.integers(1, 9, 4)[group]
        value, missing = rng.integers(1, 12, n).astype(float), rng.random(n) < 0.2
        table = pa.table(
            {
                "k": pa.array([[None, "a", "b", "c"][g] for g in group], pa.string()),
                "i": pa.array(index, pa.int64(), mask=lost),
                "r": pa.array(radius, pa.int64()),
                "v": pa.array(value, mask=missing),
                "n": np.arange(n),
            }
        )
        batches = iter(table.to_batches(max_chunksize=7))
        got = [r for b in sliding.with_range_medians(batches, ["k"], "i", "r", "v", 4, "m") for r in b.to_pylist()]
        assert [r["n"] for r in got] == list(range(n))
        known = ~missing & ~lost
        for j in range(n):
            near = [
                value[q]
                for q in range(n)
                if q != j and group[q] == group[j] and known[q] and abs(index[q] - index[j]) <= radius[j]
            ]
            assert got[j]["m"] == (float(np.median(near)) if known[j] and len(near) >= 4 else None)


def test_holds_only_what_ranges_reach(monkeypatch):
    monkeypatch.setattr(sliding, "_ROWS", 64)
    sizes = []
    bounds = sliding._bounds
    monkeypatch.setattr(sliding, "_bounds", lambda group, *rest: sizes.append(len(group)) or bounds(group, *rest))
    n = 20_000
    table = pa.table({"k": np.zeros(n, int), "i": np.arange(n), "r": np.full(n, 10), "v": np.ones(n)})
    got = sliding.with_range_medians(iter(table.to_batches(max_chunksize=50)), ["k"], "i", "r", "v", 4, "m")
    assert sum(b.num_rows for b in got) == n
    assert max(sizes) < 200
