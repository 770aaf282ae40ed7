"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is 20 consecutive words. Its minimiser is the smallest hash among its word triples;
consecutive windows with one minimiser form a super-k-mer, which travels as one packed string (its
words joined by spaces) to the bucket of the minimiser, so equal windows meet. In a bucket windows are
sorted by hash and position, and equal ones compared word for word.

Skew: equal super-k-mers of one slice of texts travel once, their later copies are settled on the
spot. Minimisers that hold more than a small share of all super-k-mers are found beforehand, and their
windows travel one by one to buckets of their own hashes, so one frequent triple
never fills a bucket. Packed strings of one slice and bucket share one compressed block; a task
reads its buckets in order, one at a time.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.words import U, Words, groups, mix, ragged, slices, window_rows, windows
from gazeframe.session import scratch_path

WINDOW = 20
TRIPLE = 3
#: Texts taken together for packing: more make larger blocks and settle more copies before the shuffle.
PACK_BYTES = 16 << 20
BUCKETS_PER_TASK = 4
_LAST_ID = (1 << 63) - 1


def minimisers(h: np.ndarray) -> np.ndarray:
    """The smallest triple hash of each window of word hashes, by doubling."""
    low = windows(h, TRIPLE)
    need, width = WINDOW - TRIPLE + 1, 1
    while width < need:
        step = min(width, need - width)
        if len(low) <= step:
            return np.empty(0, np.uint64)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low


def super_kmers(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window (a word number), number of windows, text and minimiser of each run."""
    at, row = window_rows(words, WINDOW)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    low = minimisers(words.hashes())[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), row[first], low[first]


def _count(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Minimisers frequent within a task: a globally frequent one is so in some task at least."""
    seen: Counter = Counter()
    total = 0
    for batch in slices(batches):
        values, n = np.unique(super_kmers(Words(batch.column("text")))[3], return_counts=True)
        total += int(n.sum())
        seen.update(dict(zip(values.tolist(), n.tolist(), strict=True)))
        if len(seen) > 1 << 18:  # what is rare so far cannot pass the task's threshold unnoticed by more than it
            floor = total * share / 4
            seen = Counter({k: c for k, c in seen.items() if c > floor})
    keep = [(k, c) for k, c in seen.items() if c >= max(2, total * share / 2)]
    keys = np.array([k for k, _ in keep], np.uint64).view(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array([*keys.tolist(), None], pa.int64()), pa.array([*(c for _, c in keep), total], pa.int64())], names=["low", "n"]
    )


def frequent_minimisers(texts: DataFrame, buckets: int) -> np.ndarray:
    """Minimisers that hold more than about a quarter of an even bucket; at most ``32 * buckets``."""
    share = 1 / (4 * buckets)
    counted = texts.select("text").mapInArrow(partial(_count, share=share), "low bigint, n bigint")
    summed = counted.groupBy("low").agg(F.sum("n").alias("n"))
    total = summed.where("low is null").agg(F.sum("n")).first()[0] or 0
    rows = summed.where(F.col("low").isNotNull() & (F.col("n") >= max(16, total * share / 8))).select("low").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


_PACKED = "bucket int, block binary"
_HEAD = "<qq"


def _pack_block(ids, tags, starts, texts, known) -> bytes:
    """Super-k-mers (id, tag of the text, first word, packed string) and settled ranges, compressed."""
    body = b"\n".join(texts)
    raw = b"".join(
        [
            struct.pack(_HEAD, len(texts), len(known)),
            np.array([ids, tags, starts], np.int64).tobytes(),
            np.array(known, np.int64).tobytes(),
            body,
        ]
    )
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack_block(block: bytes):
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, k = struct.unpack_from(_HEAD, raw)
    at = struct.calcsize(_HEAD)
    heads = np.frombuffer(raw, np.int64, 3 * n, at).reshape(3, n)
    at += 24 * n
    known = np.frombuffer(raw, np.int64, 4 * k, at).reshape(k, 4)
    return heads, known, raw[at + 32 * k :]


def _packs(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, dict[bytes, tuple[int, int, int]]] = {}
    known: dict[int, list] = {}
    size = 0

    def flush():
        keys, blocks = [], []
        for b in sorted(held.keys() | known.keys()):
            own = held.get(b, {})
            ids, tags, starts = zip(*own.values(), strict=True) if own else ((), (), ())
            keys.append(b)
            blocks.append(_pack_block(ids, tags, starts, own.keys(), known.get(b, [])))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    for batch in slices(batches):
        words = Words(batch.column("text"))
        size += int(words.offsets[-1])
        at, n, row, low = super_kmers(words)
        if len(at):
            # Frequent minimisers: every window is a run of its own, dealt by its whole content.
            hot = np.isin(low, frequent) if len(frequent) else np.zeros(len(low), dtype=bool)
            deal = low.copy()
            if hot.any():
                single = ragged(at[hot], n[hot])
                full = windows(words.hashes(), WINDOW)[single]
                at = np.concatenate([at[~hot], single])
                row = np.concatenate([row[~hot], np.repeat(row[hot], n[hot])])
                deal = np.concatenate([low[~hot], full])
                n = np.concatenate([n[~hot], np.ones(len(single), np.int64)])
            bucket = (mix(deal) % U(buckets)).astype(np.int64)
            # Packed string: the bytes from first to last word; single spaces are the rule, others are rebuilt.
            data = words.data.tobytes()
            begin, end = words.start[at], words.end[at + n + WINDOW - 2]
            gaps = words.start[1:] - words.end[:-1]
            plain = data[: words.offsets[-1]]
            odd = np.concatenate([[0], np.cumsum((gaps != 1) | (words.data[words.end[:-1]] != 32))]) if len(gaps) else np.zeros(1, np.int64)
            tidy = odd[at + n + WINDOW - 2] == odd[at]
            ids = np.asarray(batch.column("doc_id"))[row].tolist()
            tags = np.asarray(batch.column("tag"))[row].tolist()
            starts = (at - words.first[row]).tolist()
            for b, s, e, ok, i, tag, first, count in zip(
                bucket.tolist(), begin.tolist(), end.tolist(), tidy.tolist(), ids, tags, starts, n.tolist(), strict=True
            ):
                text = plain[s:e] if ok else b" ".join(plain[s:e].split())
                own = held.setdefault(b, {})
                old = own.get(text)
                if old is None:
                    own[text] = (i, tag, first)
                elif old != (i, tag, first):
                    later = (i, tag, first)
                    if later < old:
                        own[text], later = later, old
                    known.setdefault(b, []).append((*later, later[2] + count + WINDOW - 1))
        if size >= PACK_BYTES:
            yield flush()
            held, known, size = {}, {}, 0
    if held or known:
        yield flush()


_RANGES = "doc_id bigint, tag bigint, start bigint, stop bigint"


def _ranges(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(4)], names=["doc_id", "tag", "start", "stop"])


def repeated_windows(heads: np.ndarray, words: Words) -> np.ndarray:
    """Ranges (id, tag, first word, stop) of the windows in packed strings that also start earlier."""
    at, row = window_rows(words, WINDOW)
    if not len(at):
        return np.empty((0, 4), np.int64)
    value = windows(words.hashes(), WINDOW)[at]
    doc, tag, start = heads[0][row], heads[1][row], heads[2][row] + at - words.first[row]
    order = np.argsort(value)
    ranked = value[order]
    twin = np.zeros(len(at), dtype=bool)
    twin[1:] = ranked[1:] == ranked[:-1]
    twin[:-1] |= twin[1:]
    order = order[twin]
    order = order[np.lexsort((start[order], tag[order], doc[order], value[order]))]
    value, doc_o, tag_o, start_o = value[order], doc[order], tag[order], start[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = value[1:] != value[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    later = (doc_o != doc_o[lead]) | (tag_o != tag_o[lead]) | (start_o != start_o[lead])
    # Equal hashes are confirmed on the words themselves.
    data = words.data.tobytes()
    s, e = words.start[at[order]], words.end[at[order] + WINDOW - 1]
    hits = []
    for i in np.flatnonzero(later).tolist():
        j = int(lead[i])
        if data[s[i] : e[i]] == data[s[j] : e[j]]:
            hits.append(i)
        else:  # one hash, several contents: look for the earliest with the same words
            same = next((k for k in range(j, i) if data[s[k] : e[k]] == data[s[i] : e[i]]), None)
            if same is not None and (doc_o[same], tag_o[same], start_o[same]) != (doc_o[i], tag_o[i], start_o[i]):
                hits.append(i)
    hit = order[np.array(hits, np.int64)]
    return np.stack([doc[hit], tag[hit], start[hit], start[hit] + WINDOW], axis=1)


def _joined(rows: np.ndarray) -> np.ndarray:
    """Ranges of one text that touch or overlap become one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)
    far = rows[1:, 2] > rows[:-1, 3]  # windows are equally long or settled; a missed join is only one more row
    new[1:] = far | (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    at = np.flatnonzero(new)
    out = rows[at].copy()
    out[:, 3] = np.maximum.reduceat(rows[:, 3], at)
    return out


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, ["bucket"]):
        heads, texts, known = [], [], [np.empty((0, 4), np.int64)]
        for block in group.column("block").to_pylist():
            h, k, body = _unpack_block(block)
            heads.append(h)
            known.append(k)
            if h.shape[1]:
                texts += body.split(b"\n")
        found = repeated_windows(np.concatenate(heads, axis=1), Words(pa.array(texts, pa.binary()))) if texts else known[0]
        yield _ranges(_joined(np.concatenate([*known, found])))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = ([], [], [], [])
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = (text or b"").split()
            n = len(words)
            if spans:
                gone = np.zeros(n + 1, np.int64)
                edges = np.array([(s["start"], s["stop"]) for s in spans], np.int64)
                np.add.at(gone, edges[:, 0], 1)
                np.add.at(gone, edges[:, 1], -1)
                keep = (np.cumsum(gone[:n]) == 0).tolist()
                words = [w for w, k in zip(words, keep, strict=True) if k]
            kept = b" ".join(words)
            for column, x in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for every row of ``docs`` (``doc_id``, ``text``).

    Every word covered by a window of 20 words that also starts earlier (in a smaller ``doc_id``, or earlier in
    the same) is removed. A null text has no words. Rows that repeat both id and text are one
    document and get the same answer each; different texts of one id follow each other by a hash of the text. A null ``doc_id`` comes last, as the largest number.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST_ID)).alias("doc_id"),
        F.xxhash64("text").alias("tag"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_PER_TASK * tasks
    frequent = frequent_minimisers(source, buckets)
    packed = source.mapInArrow(partial(_packs, frequent=frequent, buckets=buckets), _PACKED)
    path = scratch_path(spark, "repeat-ranges")
    (
        packed.repartition(tasks, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_repeats, _RANGES)
        .write.parquet(path)
    )
    ranges = spark.read.parquet(path)
    spans = ranges.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = source.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(
        _cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    )
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST_ID)))
