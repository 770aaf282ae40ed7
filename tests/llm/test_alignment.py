"""Token alignment against whole-text encoding and plain counting."""

import hashlib
import os
import random
from collections import Counter

import pytest

from gazeframe.llm import alignment

pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.FOLDER), reason="no vocabulary files")

ODD = [
    None, "", " ", "  ", "a", " a", "a  b", "a \n b", "\n\n", "x  y", "x   y", "é été à la", "中文 字 a 中", "a  b c   d",
    "🙂‍🙂 👩‍👩‍👧", "\U00010348 \U0001f9ff\U0001f9ff", "▁", "a▁b ▁ c", "<|endoftext|> </s> <s> <unk> <0x41>", "it's we'll 'S", "\x00 \x1c a\x1f b",
    "tab\t x\r\n y\x0b z\x0c w", "q7Zk2Lx9Wv4Tn8Rb3Yp6Mc1D" * 40, "y" * 5000, "ab" * 3000 + " " * 700, "é ñ \u0001f", "ﬁ Ⅸ ① ½",
]


def plain(texts):
    """Counts and groups of each text, from encodings of whole texts and decoded bytes alone."""
    t = alignment.load(*(os.path.join(alignment.FOLDER, f) for f in (alignment.A_FILE, alignment.B_FILE)))
    found, pairs = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = t.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = t.b.encode(text) if text else []
        x, y = [t.a_bytes[i] for i in a], [t.b_bytes[i] for i in b]
        if not text or b"".join(x) != whole or b"".join(y) != whole:
            found.append(None)
            continue
        ends = lambda tokens: [sum(map(len, tokens[: k + 1])) for k in range(len(tokens))] if len(tokens) < 50 else running(tokens)
        x, y = ends(x), ends(y)
        cuts = sorted(set(x) & set(y))
        groups, i, j = [], 0, 0
        for cut in cuts:
            p, q = x.index(cut, i) + 1, y.index(cut, j) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        links = Counter((u, v) for g in groups for u in g[0] for v in g[1])
        pairs.update(links.keys())
        found.append((len(a), len(b), groups, links))
    top: dict = {}
    for (u, _), n in pairs.items():
        top[u] = max(top.get(u, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for (u, v), n in links.items() if pairs[u, v] == top[u])
        out.append((n_a, n_b, len(groups), links.total(), best, sum(n * pairs[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out, pairs, top


def running(tokens):
    out, at = [], 0
    for x in tokens:
        at += len(x)
        out.append(at)
    return out


def check(spark, texts, parts):
    docs = spark.createDataFrame([(i, t, "g", 3) for i, t in enumerate(texts)], "doc_id long, text string, groups string, pairs int")
    got = alignment.align(docs.repartition(parts), digest=True)
    want, pairs, top = plain(texts)
    assert {r.doc_id: tuple(r)[1:] for r in got.documents.collect()} == dict(enumerate(want))
    rows = {(r.a_id, r.b_id): (r.documents, r.best) for r in got.pairs.collect()}
    assert rows == {k: (n, n == top[k[0]]) for k, n in pairs.items()}
    return want


def test_against_whole_texts(spark, rows):
    texts = [r[1] for r in rows if len(r[1] or "") < 20_000] + ODD
    want = check(spark, texts, 4)
    zero = {t for t, w in zip(texts, want, strict=True) if not w[0]}
    assert zero == {None, "", "▁", "a▁b ▁ c"}


def test_tables_that_fill_up(spark, rows, monkeypatch):
    monkeypatch.setattr(alignment, "PARTS", 40)
    monkeypatch.setattr(alignment, "PAIRS_PER_ROW", 7)
    monkeypatch.setattr("gazeframe.llm.words.SLICE_BYTES", 200)
    # Workers import the module anew; the limits reach the code that runs in this process.
    t = alignment.load(*(os.path.join(alignment.FOLDER, f) for f in (alignment.A_FILE, alignment.B_FILE)))
    known = alignment._Numbering(t)
    known.learn(["some words", "other words", "some words"])
    assert not known.full and len(known.number) == len(known.documents) > 0
    known.learn([f"word{k}" for k in range(40)])
    assert known.full
    rows = list(alignment._pairs(known, 5))
    assert sum(len(b.column("pairs")[0]) for b in rows) == len(known.number)
    assert [b.column("place")[0].as_py() for b in rows] == [7 * k for k in range(len(rows))]


def test_parts_are_encoded_like_whole_texts():
    t = alignment.load(*(os.path.join(alignment.FOLDER, f) for f in (alignment.A_FILE, alignment.B_FILE)))
    assert t.cut
    r = random.Random(3)
    pool = ["a", "B", "'s", "7", "é", "中", " ", " ", "\u0085", "\t", "\n", "\r\n", ".", "!", "\x1d", "🙂", "‍", "the", "́", "\U00012345"]
    for _ in range(6000):
        text = "".join(" " * r.choice((1, 1, 1, 2, 3)) if r.random() < 0.4 else r.choice(pool) for _ in range(r.randint(1, 14)))
        parts = alignment.parts_of(text)
        assert " ".join(parts) == text
        whole = t.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for p in parts for i in t.a.encode(" " + p, add_special_tokens=False).ids] == whole, repr(text)
        assert [i for p in parts for i in t.b.encode(p)] == t.b.encode(text), repr(text)


def test_parts_in_any_order_are_encoded_like_each_alone():
    t = alignment.load(*(os.path.join(alignment.FOLDER, f) for f in (alignment.A_FILE, alignment.B_FILE)))
    r = random.Random(4)
    pool = ["a", "B", "'s", "7", "é", "ñ", "中", " ", "\u0085", "\u3000", "\t", "\n", ".", "!", "🙂", "‍", "the", "́", "▁"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(1, 6))) for _ in range(3000)]
    parts = sorted({p for x in texts for p in alignment.parts_of(x)} | {"", " "})
    r.shuffle(parts)
    together = alignment._Numbering(t)
    together.learn(parts[:2000])
    together.learn(parts[2000:])
    said = lambda known, p: (known.known[known.part[p]], known.counts[known.part[p]].tolist(), known.groups[known.part[p]])
    for p in parts:
        alone = alignment._Numbering(t)
        alone.learn([p])
        assert said(together, p) == said(alone, p), repr(p)


def test_tokenizers_get_little_more_than_the_parts(monkeypatch):
    t = alignment.load(*(os.path.join(alignment.FOLDER, f) for f in (alignment.A_FILE, alignment.B_FILE)))
    given = []

    class Seen:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch(self, texts, **how):
            given.extend(texts)
            return self.inner.encode_batch(texts, **how)

    monkeypatch.setattr(t, "a", Seen(t.a))
    r = random.Random(5)
    parts = sorted({"".join(r.choice("aeinrstéñ") for _ in range(r.randint(2, 7))) + r.choice(("", "", "", ".")) for _ in range(5000)})
    alignment._Numbering(t).learn(parts)
    assert sum(map(len, given)) < 1.1 * sum(len(p) + 1 for p in parts)


def test_odd_tables(spark, odd):
    got = alignment.align(odd).documents.collect()
    assert len(got) == odd.count()
    assert alignment.align(odd.limit(0)).documents.collect() == []
    same = [tuple(r) for r in got if r.doc_id == 7]
    assert len(same) == 2 and same[0] == same[1]
