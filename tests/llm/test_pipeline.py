"""Each stage of the pipeline against a plain version, and the whole."""

from collections import Counter

import pytest

import corpus_pipeline
from gazeframe.llm import pii
from gazeframe.llm.quality import judge
from tests.llm import plain

STAGE = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_stage(spark, docs):
    kept = {r.doc_id for r in judge(docs).where("kept").collect()}
    out = STAGE["quality_rules"](spark, docs, "")
    assert out.columns == docs.columns
    assert rows_of(out) == Counter({tuple(r): 1 for r in docs.collect() if r.doc_id in kept})
    assert kept == {r.doc_id for r in docs.collect() if not plain.quality(r.text)[5]} - {r.doc_id for r in docs.collect() if "!!" in (r.text or "")}


def test_near_stage(spark, docs, rows):
    out = STAGE["near_dedup"](spark, docs, "")
    want = plain.near([r[:2] for r in rows])
    assert rows_of(out) == Counter({tuple(r): 1 for r in docs.collect() if want[r.doc_id][2]})


def test_private_stage(spark, docs):
    out = {r.doc_id: r for r in STAGE["personal_data"](spark, docs, "").collect()}
    for r in docs.collect():
        new = out[r.doc_id]
        assert (new.text is None) == (r.text is None) and new.source == r.source
        if r.text is not None:
            assert new.n_chars == len(new.text) and not plain.pii(new.text)
            if not plain.pii(r.text):
                assert new.text == r.text
    assert all(f"[{k}]" in out[3].text for k in ("EMAIL", "PHONE", "CARD", "IP"))


def test_redaction_of_overlaps():
    assert pii.redact("ab12cd", [("card", 1, 4), ("ip", 2, 5)]) == "a[CARD]d"
    assert pii.redact("abc", []) == "abc"
    assert pii.redact("abc", [("ip", 0, 1), ("ip", 2, 3)]) == "[IP]b[IP]"


def test_mix_stage(spark, docs):
    from gazeframe.llm.mixing import mix_copies

    times = {r.doc_id: r.copies for r in mix_copies(docs).collect()}
    want = Counter({tuple(r): times[r.doc_id] for r in docs.collect() if times[r.doc_id]})
    out = STAGE["source_mix"](spark, docs, "")
    assert out.columns == docs.columns and rows_of(out) == want


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_stages_on_odd_tables(spark, odd, kind):
    now = odd if kind == "odd" else odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, "")
        if name != "length_packing":
            assert out.columns == odd.columns
        assert kind == "odd" or out.isEmpty()


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {"doc_id", "n_words", "bucket", "bucket_length", "batch", "slot", "padding"}
    assert 0 < out.count() <= 3 * docs.count()
