"""The prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gazeframe.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, place long, p string, `meta.url` string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    rest = lambda c: c - int(c / 5) * 5
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - rest(c), [])[:h] + turns[h:]
    return out


def trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for key in members:
        if key:
            kids[key[:-1]].add(key)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, who in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in kids
            saved[key[:d]] += (len(who) - 1) * len(key[-1][1].encode()) if key else 0
    out = []
    for key, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(key))
        out.append((min(who), len(key), min(members[key[:-1]]) if key else None, len(who), len(kids[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made():
    r = random.Random(2)
    rows = []
    for c in [*range(-12, 60), 10**15, 10**15 + 3, 2**63 - 1, -(2**63)]:
        if c % 7 == 3:
            continue
        n = r.choice((1, 2, 3, 5, 8, 9, 17, 40))
        pool = "ab" if c % 3 else "abcdef"
        turns = [("user" if k % 2 else None, r.choice(pool) * r.randint(0, 2) if k > 20 or r.random() < 0.3 else "same é") for k in range(n)]
        rows += [(c, None if k == 0 and c % 4 == 0 else k, *x) for k, x in enumerate(turns)]
    return rows + [(None, 1, "user", "nobody's"), (70, 3, None, None), (75, 0, "user", "")]


def run(spark, rows, block=conversations.BLOCK):
    df = spark.createDataFrame([(*x, 1, "p", "u") for x in rows], SCHEMA).repartition(3)
    return sorted((tuple(x) for x in conversations.family_trie(df, block).nodes.collect()), key=str)


def test_trie(spark):
    rows = made()
    assert run(spark, rows) == trie(rebuilt(rows))


def test_small_blocks_and_borders(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCKS_AT_ONCE", 2)
    monkeypatch.setattr(conversations, "IDS_AT_ONCE", 3)
    rows = [x for x in made() if x[0] is not None and -12 <= x[0] < 40]
    assert run(spark, rows, 2) == trie(rebuilt(rows))


def test_copies_and_one_long_conversation(spark):
    """Thousands of equal conversations, and one that is most of the table."""
    rows = [(c, k, "user", f"t{k}") for c in range(0, 4000, 5) for k in range(3)]
    rows += [(9, k, "user", f"t{k}" if k < 3 else f"{k}") for k in range(3000)]
    got = run(spark, rows)
    want = rebuilt(rows)
    assert len(got) == max(len(t) for t in want.values()) + 1
    head = {x[1]: x for x in got}
    assert head[3][:4] == (0, 3, 0, 801) and head[0][6] == sum(2 * 800 for _ in range(3))
    ends = ",".join(map(str, range(0, 4000, 5)))
    assert head[3][7] == hashlib.sha256(ends.encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")]])
def test_nothing(spark, rows):
    assert run(spark, rows) == []


def test_turnless(spark):
    c = next(k for k in range(1, 100) if k % 5 and zlib.crc32(str(k).encode()) % 9 > 2)
    rows = [(c, 0, "user", "hi"), (c, 0, "user", "hi")]
    assert run(spark, rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
