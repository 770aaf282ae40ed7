"""Homomorphic fingerprints: sums of wide vectors hashed from paragraphs.

A paragraph (a line) gives a vector of 8 lanes modulo 2^64, drawn from its bytes, and of 256 lanes
modulo 2^32, in which every run of three of its words (all its words, if fewer) adds or takes one in one lane. The
fingerprint of a text is the sum over its paragraphs, lane by lane. So it does not depend on their
order, and a paragraph is put in or taken out by adding or subtracting its vector. The first lanes
decide equality; the angle between the second ones estimates how much two texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.words import U, Words, mix, slices, window_rows, windows

WIDE, FINE = 8, 256
RUN = 3
_LAST_ID = (1 << 63) - 1
_SALTS = mix(np.arange(1, WIDE + 1, dtype=np.uint64))


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Wide (uint64) and fine (uint32) sums of each text's paragraphs."""
    lines, owner = [], []
    for i, t in enumerate(texts):
        own = [x for x in t.split(b"\n") if x]
        lines += own
        owner += [i] * len(own)
    owner = np.array(owner, np.int64)
    # A line's own hash is that of its bytes, taken as one word with every white byte made visible.
    marks = Words(pa.array([x.translate(_VISIBLE) for x in lines], pa.binary()))
    wide = np.zeros((len(texts), WIDE), np.uint64)
    if len(lines):
        np.add.at(wide, owner, mix(marks.hashes()[:, None] ^ _SALTS[None, :]))
    words = Words(pa.array(lines, pa.binary()))
    h = words.hashes()
    at, row = window_rows(words, RUN)
    value = windows(h, RUN)[at]
    for n in range(1, RUN):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            value = np.concatenate([value, mix(windows(h, n)[words.first[short]] + U(n))])
            row = np.concatenate([row, short])
    value = mix(value)
    slot = owner[row] * FINE + (value >> U(56)).astype(np.int64) if len(row) else np.empty(0, np.int64)
    sign = np.where(value & U(1), 1.0, -1.0)
    fine = np.bincount(slot, weights=sign, minlength=len(texts) * FINE).reshape(len(texts), FINE)
    return wide, fine.astype(np.int64).astype(np.uint32)


# White bytes become bytes that never occur in UTF-8, so that a line is one word.
_VISIBLE = bytes.maketrans(bytes([9, 11, 12, 13, 32]), bytes([0xF8, 0xF9, 0xFA, 0xFB, 0xFC]))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of fine lanes as signed numbers, row by row, from 0 to 1; two empty ones are alike."""
    x, y = (v.astype(np.int32).astype(np.float64) for v in (a, b))
    dot, size = (x * y).sum(axis=1), np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    both_empty = ~x.any(axis=1) & ~y.any(axis=1)
    out = np.clip(np.where(size > 0, dot / np.where(size > 0, size, 1), both_empty.astype(float)), 0.0, 1.0)
    return np.where((a == b).all(axis=1), 1.0, out)


def written(wide: np.ndarray, fine: np.ndarray) -> list[str]:
    return [w.astype(">u8").tobytes().hex() + f.astype(">u4").tobytes().hex() for w, f in zip(wide, fine, strict=True)]


def _folded(fine: np.ndarray) -> bytes:
    """Signed lanes in two bytes each where they fit, else in four."""
    lanes = fine.astype(np.int32)
    narrow = lanes.astype(np.int16)
    return (narrow if (narrow == lanes).all() else lanes).tobytes()


def _unfolded(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if len(raw) == 2 * FINE else np.int32).astype(np.int32).astype(np.uint32)


def edit(text: str, after: str) -> str:
    """The last quarter of the code points, replaced by as many first ones of ``after`` (or all)."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _deal(batches: Iterator[pa.RecordBatch], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Range number of each row, and its fingerprint; the first id of a range goes to the end of the previous range too."""
    n = len(starts)
    for batch in slices(batches):
        ids = np.asarray(batch.column("id"))
        part = np.maximum(np.searchsorted(starts, ids, side="right") - 1, 0)
        wide, fine = vectors(batch.column("text").to_pylist())
        full = pa.RecordBatch.from_arrays(
            [
                pa.array(part.astype(np.int32)),
                pa.array(np.zeros(len(ids), np.int32)),
                *(batch.column(c) for c in ("id", "text")),
                pa.array([w.tobytes() for w in wide], pa.binary()),
                pa.array([_folded(f) for f in fine], pa.binary()),
            ],
            names=["part", "halo", "id", "text", "wide", "fine"],
        )
        yield full
        edge = np.flatnonzero(ids == starts[part])
        if len(edge):
            twin = full.take(pa.array(edge))
            before = (part[edge] - 1) % n
            yield pa.RecordBatch.from_arrays(
                [pa.array(before.astype(np.int32)), pa.array(np.ones(len(edge), np.int32)), *twin.columns[2:]], names=full.schema.names
            )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted range meets the next one; the last meets the range's halo row."""
    held, closed, seen = None, False, None
    for batch in slices(batches):
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "halo", "id", "text", "wide", "fine")), strict=True))
        pairs = []
        for row in rows:
            if row[0] != seen:
                held, closed, seen = None, False, row[0]
            if closed:
                continue
            if held is not None:
                pairs.append((held, row))
            closed = bool(row[1])
            held = row
        if pairs:
            yield _answers(pairs)


def _answers(pairs: list) -> pa.RecordBatch:
    wide = np.array([np.frombuffer(own[4], np.uint64) for own, _ in pairs])
    fine, next_fine = (np.array([_unfolded(row[5]) for row in rows]) for rows in zip(*pairs, strict=True))
    texts = [own[3].decode("utf-8", "replace") for own, _ in pairs]
    edited = [edit(t, after[3].decode("utf-8", "replace")) for t, (_, after) in zip(texts, pairs, strict=True)]
    # Only paragraphs from the first changed one on are taken out and put in.
    cut = [t.rfind("\n", 0, len(t) - len(t) // 4) + 1 for t in texts]
    out_wide, out_fine = vectors([t[c:].encode() for t, c in zip(texts, cut, strict=True)])
    in_wide, in_fine = vectors([e[c:].encode() for e, c in zip(edited, cut, strict=True)])
    new_wide, new_fine = wide - out_wide + in_wide, fine - out_fine + in_fine
    ids = [own[2] for own, _ in pairs]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None if i == _LAST_ID else i for i in ids], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(written(wide, fine), pa.string()),
            pa.array(written(new_wide, new_fine), pa.string()),
            pa.array(likeness(fine, new_fine), pa.float64()),
            pa.array(likeness(fine, next_fine), pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (``doc_id``, ``text``), of its edited form, and likenesses.

    The next document is that with the next ``doc_id``; after the last comes the first. Rows with one id
    follow each other by text. A null id comes last, as the largest number; a null text is empty. Of a
    single document, itself is the next. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST_ID)).alias("id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range starts are ids that occur, so the first row of each range is known without looking.
    ranks = [i / parts for i in range(parts)]
    found = source.agg(F.min("id"), F.percentile_approx("id", ranks, 10 * max(parts, 100))).first()
    starts = np.array(sorted({found[0], *found[1]} if found[0] is not None else {0}), np.int64)
    schema = "part int, halo int, id bigint, text binary, wide binary, fine binary"
    ranged = source.mapInArrow(partial(_deal, starts=starts), schema)
    return (
        ranged.repartitionById(len(starts), F.col("part"))
        .sortWithinPartitions("part", "halo", "id", "text")
        .mapInArrow(
            _compare,
            "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double",
        )
    )
