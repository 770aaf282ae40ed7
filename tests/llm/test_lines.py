"""Shared lines against plain counting."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from gazeframe.llm import line_dedup
from tests.llm import plain


def dropped(rows, chars=20, least=3):
    """(n_lines, n_dropped, rest) of each row; a row without an id is a document by its text."""
    key = lambda line: plain.lowered(re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line))
    name = lambda i, t: (i is None, i or 0, "" if i is not None else t or "")
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(name(i, t))
    last = {}
    for x, documents in held.items():
        if len(x) >= chars and len(documents) >= least:
            numbered = [d for d in documents if not d[0]]
            last[x] = documents - ({max(numbered)} if len(numbered) == len(documents) else {d for d in documents if d[0]})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if name(i, t) not in last.get(key(x), ())]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark):
    r = random.Random(8)
    pool = ["A line that is shared by MANY texts", "  a line that is shared by many texts\r", "short one", "ÉCLAIR à la carte, s'il vous plaît", "éclair à la carte, s'il vous plaît",
            "x" * 20, "x" * 19, "ß" * 20, "\t" + "🙂" * 20 + "\x0b", "🙂" * 19, "", " ", "lone line of words number"]
    texts = ["\n".join(r.choice(pool) + (str(k) if r.random() < 0.1 else "") for _ in range(r.randint(0, 9))) for k in range(120)]
    texts += [None, "", "\n", "\n\n", "x" * 20, "\n".join(["x" * 20] * 3000 + [str(k) for k in range(40_000)]), "word " * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*x, 1, 2, "l") for x in rows], "doc_id long, text string, pos int, h long, `meta.url` string").repartition(4)
    got = line_dedup.drop_shared_lines(docs).collect()
    assert sorted((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in got) == sorted(dropped(rows))
    assert line_dedup.drop_shared_lines(docs.limit(0)).collect() == []


def test_one_document_in_several_rows(spark):
    a, b = "a line of more than twenty letters", "another line of more than twenty"
    rows = [(1, a), (1, a), (1, f"{a}\n{b}"), (2, f"{a}\nrest"), (3, b), (3, b)]
    run = lambda rows: sorted((x.doc_id, x.text, x.n_dropped) for x in line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert run(rows) == sorted((i, t, 0) for i, t in rows)  # two documents each
    got = run([*rows, (4, a), (0, b)])
    assert got == sorted([(1, "", 1), (1, "", 1), (1, "", 2), (2, "rest", 1), (3, b, 0), (3, b, 0), (4, a, 0), (0, "", 1)])


def test_texts_without_ids(spark):
    a = "a line of more than twenty letters"
    rows = [(None, a), (None, a), (None, f"{a}\n1"), (7, a)]
    got = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted(x.text for x in got if x.doc_id is None)
    assert [x.text for x in got if x.doc_id == 7] == [""]
    # One of the two different texts is the last document; its copies keep the line alike.
    assert texts in (["1", a, a], ["", "", f"{a}\n1"])


def test_a_line_in_every_document(spark):
    hot = F.lit("this very line stands in every document")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", hot, F.col("id").cast("string"), hot).alias("text"))
    got = line_dedup.drop_shared_lines(docs)
    assert got.agg(F.sum("n_dropped")).first()[0] == 2 * 19_999
    assert [x.text for x in got.where("n_dropped = 0").collect()] == ["this very line stands in every document\n19999\nthis very line stands in every document"]
