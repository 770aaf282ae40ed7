"""Every text operator against its plain version, on texts of all kinds."""

import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gazeframe.llm import (
    fingerprints,
    mixing,
    near_dedup,
    packing,
    pii,
    quality,
    secret_scan,
    sharding,
    substrings,
    warc,
)
from tests.llm import plain


def table(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def test_repeated_windows(docs, rows):
    got = table(substrings.remove_repeats(docs), "n_words", "n_removed", "kept_sha256")
    assert got == plain.repeats([r[:2] for r in rows])


def test_frequent_minimisers_change_nothing(docs, rows, monkeypatch):
    spread = substrings.frequent_minimisers(
        docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")), 4096
    )
    assert len(spread)
    monkeypatch.setattr(substrings, "BUCKETS_PER_TASK", 512)
    got = table(substrings.remove_repeats(docs), "n_words", "n_removed", "kept_sha256")
    assert got == plain.repeats([r[:2] for r in rows])


def test_near_duplicates(docs, rows):
    got = table(near_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert got == plain.near([r[:2] for r in rows])


def test_near_duplicates_in_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    got = table(near_dedup.near_duplicates(docs.where("doc_id >= 80")), "n_shingles", "component_id", "kept")
    assert got == plain.near([r[:2] for r in rows if r[0] >= 80])


def test_personal_data(docs, rows):
    got = table(pii.find_pii(docs), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t, *_ in rows:
        base = plain.pii(t)
        per = Counter(k for k, *_ in base)
        assert got[i][:5] == (*(per[k] for k in ("email", "ip", "card", "phone")), plain.sha(plain.written(base)))
        assert {plain.written([s]) for s in base} <= set(got[i][5].split(","))
    assert got[3][:4] == (1, 1, 1, 1)


RANDOM_ALPHABETS = {
    "lower": (string.ascii_lowercase, 0.97),
    "upper": (string.ascii_uppercase, 0.97),
    "letters": (string.ascii_letters, 0.97),
    "alnum": (string.ascii_letters + string.digits, 0.97),
    "base64": (string.ascii_letters + string.digits + "+/", 0.97),
    "lower and digits": (string.ascii_lowercase + string.digits, 0.9),
    "upper and digits": (string.ascii_uppercase + string.digits, 0.85),
}


@pytest.mark.parametrize("name", RANDOM_ALPHABETS)
def test_planted_random_strings(spark, name):
    alphabet, least = RANDOM_ALPHABETS[name]
    rnd = random.Random(name)
    key = lambda: "".join(rnd.choice(alphabet) for _ in range(rnd.choice((20, 24, 32, 48))))
    planted = [(k, f"see {word} there", 4, 4 + len(word)) for k, word in enumerate(key() for _ in range(600))]
    docs = spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secret_scan.find_secrets(docs).select("doc_id", "spans").collect()}
    found = sum(spans[k] == f"random:{a}:{b}" or spans[k].startswith(("hex:", "access:")) for k, _, a, b in planted)
    assert found >= least * len(planted)


def test_words_and_names_are_no_secrets(spark):
    plain_words = (
        "Donaudampfschifffahrtsgesellschaft Rechtsschutzversicherungsgesellschaften electroencefalografista lentokonesuihkuturbiini "
        "najneobhospodarovavatelnejsi to-do-or-not-to-do-it-now AbstractSingletonProxyFactoryBean load_user_profile_by_id_2 "
        "----------------------- ======================= 9876543210_9876543210_9 usr/local/share/python3/site-packages "
        "123e4567-e89b-12d3-a456-426614174000 " + "9F3A7C1E" * 5
    ).split()
    rnd = random.Random(3)
    long_one = "".join(rnd.choice(string.ascii_lowercase) for _ in range(100_000))
    docs = spark.createDataFrame([*enumerate(plain_words), (100, long_one), (101, "qzxkvwjmbtrplfdnhgsckjwq qzxkvwjmbtrplfdnhgsc7")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secret_scan.find_secrets(docs).collect()}
    assert {k for k, v in spans.items() if v} == {100, 101}
    assert spans[100] == "random:0:100000" and spans[101] == "random:0:24,random:25:46"


def test_secrets(docs, rows):
    got = table(secret_scan.find_secrets(docs), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for i, t, *_ in rows:
        base = plain.secrets(t)
        per = Counter(k for k, *_ in base)
        assert got[i][:4] == (per["assign"], per["access"], per["hex"], plain.sha(plain.written(base)))
    assert got[4][:3] == (1, 1, 2) and "random:" in got[4][4]
    assert sum("random:" in x[4] for x in got.values()) == 1


def test_quality(docs, rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = table(quality.judge(docs), *names)
    for i, t, *_ in rows:
        assert got[i][:6] == plain.quality(t)
        assert not (got[i][5] and got[i][6])


def test_mixing(docs, rows):
    got = mixing.mix_copies(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(plain.words(r[1]))
    want = plain.targets(sizes)
    largest, taken = {}, Counter()
    for r in got:
        assert r["size"] == len(plain.words(rows[r.doc_id][1])) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = mixing.mix_copies(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_residuals_meet_in_a_tree(docs, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 3)
    monkeypatch.setattr(mixing, "FAN", 2)
    got = mixing.mix_copies(docs).groupBy("source").agg(
        F.abs(F.sum("taken") - F.first("target")).alias("miss"), F.max("size").alias("largest")
    )
    assert got.where("miss > largest").isEmpty()


def check_shards(df, n):
    got = df.select("size", "shard", "slot").toPandas()
    assert len(got) == n and got["shard"].between(0, 15).all()
    per = got.groupby("shard").agg(n=("slot", "size"), top=("slot", "max"), each=("slot", "nunique"), bytes=("size", "sum"))
    assert (per.top == per.n - 1).all() and (per.each == per.n).all()
    fair = got["size"].sum() / 16
    assert (abs(per.bytes - fair) <= got["size"].max() + 0.01 * fair).all()


def test_sharding(docs, rows, spark):
    out = sharding.shard(docs)
    check_shards(out, len(rows))
    same = out.groupBy("row.text").agg(F.count_distinct("shard").alias("n"), F.count_distinct("text_crc32").alias("c"))
    assert same.where("c <> 1").isEmpty()
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "same").otherwise(F.col("id").cast("string")).alias("text"))
    check_shards(sharding.shard(hot), 4000)


def test_sharding_is_native(docs):
    plan = sharding.shard(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_packing(docs, rows):
    got = packing.pack(docs, buckets=5, budget=400).toPandas()
    assert dict(zip(got.doc_id, got.n_words)) == {r[0]: len(plain.words(r[1])) for r in rows}
    assert (got.padding == got.bucket_length - got.n_words).all() and (got.padding >= 0).all()
    per = got.groupby(["bucket", "batch"]).agg(n=("slot", "size"), top=("slot", "max"), length=("bucket_length", "first"))
    assert (per.top == per.n - 1).all() and ((per.n * per.length <= 400) | (per.n == 1)).all()
    lengths = sorted(set(got.n_words))
    count = Counter(got.n_words)
    best = {(-1, 0): 0}
    for k in range(1, 6):  # plain dynamic programme
        for j in range(len(lengths)):
            cost = lambda i: sum(count[x] * (lengths[j] - x) for x in lengths[i + 1 : j + 1])
            best[(j, k)] = min(best[(i, k - 1)] + cost(i) for i in range(-1, j) if (i, k - 1) in best) if any((i, k - 1) in best for i in range(-1, j)) else 10**9
    assert got.padding.sum() == min(best[(len(lengths) - 1, k)] for k in range(1, 6))


def least_padding(lengths, buckets):
    """The plain dynamic programme, for few lengths."""
    at, count = sorted(set(lengths)), Counter(lengths)
    best = {(-1, 0): 0}
    for k in range(1, buckets + 1):
        for j in range(len(at)):
            cost = lambda i: sum(count[x] * (at[j] - x) for x in at[i + 1 : j + 1])
            ways = [best[i, k - 1] + cost(i) for i in range(-1, j) if (i, k - 1) in best]
            if ways:
                best[j, k] = min(ways)
    return min(v for (j, _), v in best.items() if j == len(at) - 1)


@pytest.mark.parametrize("most", [400_000, 5])
def test_packing_of_very_long_texts(spark, monkeypatch, most):
    monkeypatch.setattr(packing, "LENGTHS", most)
    lengths = [20_001, 33_333, 2, 100_000, 100_007, 33_331, 20_001, 16_384, 16_385, 5, 64_001]
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    for buckets in (3, 5, 16):
        got = packing.pack(docs, buckets=buckets).collect()
        assert {r.bucket_length for r in got} <= set(lengths)
        padding, least = sum(r.padding for r in got), least_padding(lengths, buckets)
        assert padding == least if most > 5 else least <= padding <= least + sum(lengths) / 8192


@pytest.mark.parametrize("most", [5, 1])
def test_packing_does_not_depend_on_the_number_of_lengths(spark, monkeypatch, most):
    lengths = [100_000, 100_007, 100_007, 64_001, 64_003, 33_331, 33_333, 33_333, 20_001, 20_003, 16_385, 16_384, 5, 2]
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    want = sorted(packing.pack(docs, buckets=11).collect())
    monkeypatch.setattr(packing, "LENGTHS", most)
    assert sorted(packing.pack(docs, buckets=11).collect()) == want
    assert sum(r.padding for r in want) == least_padding(lengths, 11)


def test_likeness_of_very_long_repetitive_texts(spark):
    n = [30_000, 40_000, 100_000]
    docs = spark.createDataFrame([(i, "w " * k) for i, k in enumerate(n)] + [(9, "other words than these")], "doc_id long, text string")
    got = fingerprints.fingerprint_edits(docs).orderBy("doc_id").collect()
    assert all(r.near_edited > 0.99 for r in got[:3]) and all(r.near_next > 0.99 for r in got[:2])
    assert got[2].near_next < 0.5


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    texts = [r[1] or "" for r in rows]
    for i, t in enumerate(texts):
        k = len(t) // 4
        e = t[: len(t) - k] + texts[(i + 1) % len(texts)][:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), plain.sha(e))
        mine, edited = fingerprints.written(*fingerprints.vectors([t.encode(), e.encode()]))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (mine, edited)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    long = [r for r in got.values() if r.n_chars > 300 and r.near_next < 0.4]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)


def test_fingerprint_sums():
    a, b = b"one two three four", b"five six seven"
    whole, turned, first, second = (fingerprints.vectors([x]) for x in (a + b"\n" + b, b + b"\n" + a, a, b))
    for k in range(2):
        assert (whole[k] == turned[k]).all() and (whole[k] == first[k] + second[k]).all()


def test_archives(spark, docs, rows):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), F.col("source"), F.lit(".org/p")).alias("url"), F.col("text").alias("html"))
    got = sorted(tuple(r) for r in warc.archive_round_trip(spark, pages).collect())
    assert got == sorted(plain.archive([r[:2] for r in rows]), key=lambda x: x[0])


def test_archive_index_has_small_blocks(tmp_path):
    import pyarrow as pa

    store = str(tmp_path)
    keys = sorted((f"k{i // 7:03d}".encode(), i % 7) for i in range(500))
    lines = [(k.decode(), p, "f", 10 * n, 10) for n, (k, p) in enumerate(keys)]
    names = ["surt", "page", "file", "offset", "length"]
    old, warc.LINES_PER_BLOCK = warc.LINES_PER_BLOCK, 4
    try:
        manifest = []
        for lo in range(0, 500, 170):
            part = lines[lo : lo + 170]
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=names)
            manifest += [tuple(r.values()) for b in warc._index(iter([batch]), store) for r in b.to_pylist()]
    finally:
        warc.LINES_PER_BLOCK = old
    index = warc.Index(store, manifest)
    for key, line in zip(keys, lines, strict=True):
        assert [tuple(x) for x in index.find(key)] == [line]
    assert not list(index.find((b"k0005", 1))) and not list(index.find((b"", 0))) and not list(index.find((b"z", 0)))


OPERATORS = {
    "substrings": substrings.remove_repeats,
    "near": near_dedup.near_duplicates,
    "pii": pii.find_pii,
    "secrets": secret_scan.find_secrets,
    "quality": quality.judge,
    "mixing": mixing.mix_copies,
    "sharding": lambda d: sharding.shard(d).select("row.*", "shard", "slot"),
    "packing": packing.pack,
    "fingerprints": fingerprints.fingerprint_edits,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_nothing(name, odd):
    run = OPERATORS[name]
    got = run(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert run(odd.limit(0)).collect() == []
    # Rows that repeat get answers of their own that differ at most in their place.
    if name in ("substrings", "near", "pii", "secrets", "quality"):
        again = Counter(tuple(r) for r in rows if r.doc_id == 7)
        assert list(again.values()) == [2]


def test_components_across_tasks(spark, monkeypatch):
    """The star rounds, which only long edge lists need, on chains, a hub and random edges."""
    import random

    from gazeframe.llm import components

    monkeypatch.setattr(components, "EDGES_PER_TASK", 5)
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(500, k) for k in range(100, 140)]
    edges += [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(3), "a", "b")
    want = {x: root(x) for x in list(parent) if any(x in e and e[0] != e[1] for e in edges)}
    assert {c.node: c.component for c in got.collect()} == want and got.count() == len(want)


def test_form_feeds_at_the_ends(spark):
    texts = ["f", "f foo", "x = f", "page one\f", "\fpage one", "\f", "\x0b\ff\f\x0b", "if of\r\f\n", "a\fb f"]
    docs = spark.createDataFrame(
        [(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"
    )
    want = {i: len(plain.words(t)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in mixing.mix_copies(docs).collect()} == want
    assert {r.doc_id: r.n_words for r in packing.pack(docs).collect()} == want


def test_near_duplicates_under_null_and_repeated_ids(spark):
    import random

    r = random.Random(5)
    prose = lambda n=120: [r.choice("abcdefgh") + str(r.randrange(500)) for _ in range(n)]
    near = lambda t, k: " ".join([*t[:k], "other", *t[k + 1 :]])
    a, b, c, d, e, f = (prose() for _ in range(6))
    whole = " ".join
    table_ = [
        (None, whole(a)), (None, near(a, 30)), (None, whole(a)),  # near copies without an id
        (None, whole(b)), (3, near(b, 50)),  # a copy without an id of a numbered one
        (None, whole(c)), (None, None),
        (5, whole(d)), (5, whole(e)), (5, None), (2, near(e, 60)), (9, near(d, 20)),  # different texts of one id
        (7, whole(f)), (7, near(f, 10)), (8, near(f, 90)), (1, ""),
    ]
    docs = spark.createDataFrame(table_, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(table_)
    assert {(x.doc_id, x.component_id, x.kept) for x in got if x.doc_id is not None} == {
        (3, 3, True), (5, 2, False), (2, 2, True), (9, 2, False), (7, 7, True), (8, 7, False), (1, 1, True)
    }
    assert sorted(x.component_id or 0 for x in got if x.doc_id is None) == [0] * 5 + [3]
    kept = [tuple(x) for x in near_dedup.keep_one(docs).collect()]
    assert len(kept) == len(set(kept))
    lone = {t for i, t in kept if i is None}
    assert len(lone & {whole(a), near(a, 30)}) == 1 and lone - {whole(a), near(a, 30)} == {whole(c), None}
    assert {x for x in kept if x[0] is not None} == {(3, near(b, 50)), (2, near(e, 60)), (7, whole(f)), (7, near(f, 10)), (1, "")}


def test_every_language_has_its_own_reference(docs, spark, monkeypatch):
    names = ("kept", "class_distance", "word_distance")
    want, accepted = table(quality.judge(docs), *names), Counter(map(tuple, quality.accepted(docs).collect()))
    monkeypatch.setattr(quality, "LANGUAGES", 1)
    assert table(quality.judge(docs), *names) == want
    assert Counter(map(tuple, quality.accepted(docs).collect())) == accepted
    # Two further languages with one word list and different scripts: each is near its own mean.
    texts = [("aa", "plain words in small letters " * 12), ("ab", "ЖЩ ДЮ ФЯ ЦЭ " * 30), ("ab", "ЖЩ ДЮ ФЯ ЦЭ " * 31)]
    other = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate([("en", "the cat " * 40)] * 4 + texts)], "doc_id long, text string, lang string")
    assert all(r.class_distance < 0.01 for r in quality.judge(other).collect())


def test_shared_openings_under_one_id(spark):
    opening = " ".join(f"o{k}" for k in range(30))
    ends = [" ".join(f"e{n}x{k}" for k in range(12)) for n in range(3)]
    for i in (None, 4):
        docs = spark.createDataFrame([(i, f"{opening} {e}") for e in ends], "doc_id long, text string")
        for parts in (1, 3):
            got = [r.n_removed for r in substrings.remove_repeats(docs.repartition(parts)).collect()]
            assert sorted(got) == [0, 30, 30]
