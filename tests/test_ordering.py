import random

from pyspark.sql import functions as F

from gazeframe.operators import ordering as O


def table(spark):
    rnd = random.Random(1)
    rows = []
    for key, n in ((1, 900), (2, 40), (3, 1)):
        places = rnd.sample(range(5000), n)
        rows += [(key, p, f"n{rnd.randint(0, 10**6):07d}", rnd.random() if p % 5 else None) for p in places]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k int, p int, name string, v double"), rows


def test_ordinals(spark):
    df, rows = table(spark)
    got = O.ordinal_within(df, ["k"], ["p"], O.by_index(F.col("p"), 64)).collect()
    by_name = O.ordinal_within(O.by_range(df, ["k"], ["name"], 7), ["k"], ["name"]).collect()
    assert len(got) == len(rows) == len(by_name)
    for key in (1, 2, 3):
        want = sorted(r[1] for r in rows if r[0] == key)
        assert [r.p for r in sorted((r for r in got if r.k == key), key=lambda r: r.ordinal)] == want
        assert sorted(r.ordinal for r in got if r.k == key) == list(range(len(want)))
        names = sorted(r[2] for r in rows if r[0] == key)
        assert [
            r.name for r in sorted((r for r in by_name if r.k == key), key=lambda r: r.ordinal)
        ] == names


def test_running_max_and_neighbours(spark):
    df, rows = table(spark)
    seg = O.by_index(F.col("p"), 64)
    top = {(r.k, r.p): r.m for r in O.running_max(df, ["k"], ["p"], F.col("v"), seg, "m").collect()}
    near = {
        (r.k, r.p): (r.b, r.a)
        for r in O.neighbour_values(df, ["k"], ["p"], F.col("v"), seg, "b", "a").collect()
    }
    for key in (1, 2, 3):
        line = sorted((r[1], r[3]) for r in rows if r[0] == key)
        best = None
        for i, (p, v) in enumerate(line):
            assert top[key, p] == best
            before = line[i - 1][1] if i else None
            after = line[i + 1][1] if i + 1 < len(line) else None
            assert near[key, p] == (before, after)
            if v is not None:
                best = v if best is None else max(best, v)
