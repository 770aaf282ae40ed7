"""Which tokens of two tokenizers cover the same bytes, and how often id pairs meet in a corpus.

Tokenizer A is byte-level, with character offsets; tokenizer B has pieces with byte fallback, with spans
in its proto. Offsets and spans are coarse cuts: they settle every token that holds whole characters. Tokens
inside a multibyte character, and byte-fallback tokens, are placed by the bytes they decode to. Where both
tokenizers end a token the text is cut into groups.

Neither tokenizer joins what stands before a single space with what follows it (checked for B's pieces
when its file is read), so a text is encoded as parts between such spaces, and each different part of a task is encoded and
aligned once; new parts are encoded many at once, with a space between them as in a text. A task numbers the id
pairs it meets; documents refer to the numbers. Per task a pair travels once to be counted over the corpus, and
its count travels back to the task's documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.words import ragged, slices
from gazeframe.session import scratch_path

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Parts and pairs that a task holds before it starts numbering anew; its memory is bounded by them.
PARTS, PAIRS = 500_000, 400_000
PAIRS_PER_ROW = 20_000
#: Parts that are encoded as one text, such texts at once, and links from which a group counts distinct ids.
JOINED, ENCODED_AT_ONCE, LARGE_GROUP = 300, 16, 1_024
_BARRIER = " . "
_AFTER_ID = (",", "|", ";", "")

_SPACE = "▁"
# A cut before a space is safe after an ASCII character that is not white, and between a character beyond
# ASCII and an ASCII character that is not white; both tokenizers then begin a token at the space. B has no token
# for an empty text, so the last space is never cut at.
_CUT = re.compile(r" (?!\Z)(?:(?<=[\x21-\x7e] )|(?<=[^\x00-\x7f] )(?=[\x21-\x7e]))")


def byte_values() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, others
    for 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Tokenizers:
    a: object
    b: object
    a_bytes: dict[int, bytes]
    b_bytes: list[bytes]
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    written: pa.Array  # every id with each of _AFTER_ID
    cut: bool


@lru_cache(maxsize=2)
def load(a_file: str, b_file: str) -> Tokenizers:
    """Both tokenizers with the bytes of every id; once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_file)
    a.encode_special_tokens = True
    value = byte_values()
    a_bytes = {
        i: bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        for token, i in a.get_vocab(with_added_tokens=True).items()
    }
    b = sentencepiece.SentencePieceProcessor(model_file=b_file)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    b_bytes = [
        bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)
    ]
    inner = re.compile(f"[^{_SPACE}]{_SPACE}")
    cut = not any(inner.search(p) for i, p in enumerate(pieces) if not b.is_control(i))
    a_sizes = np.zeros(max(a_bytes) + 1, np.int64)
    a_sizes[list(a_bytes)] = [len(x) for x in a_bytes.values()]
    written = pa.array([f"{i}{c}" for i in range(max(len(a_sizes), len(b_bytes))) for c in _AFTER_ID], pa.string())
    return Tokenizers(a, b, a_bytes, b_bytes, a_sizes, np.array([len(x) for x in b_bytes], np.int64), written, cut)


def parts_of(text: str, cut: bool = True) -> list[str]:
    """The text between safe single spaces; the spaces cut at are left out."""
    return _CUT.split(text) if cut else [text]


def refined_ends(lo: np.ndarray, hi: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of consecutive tokens: a coarse span's end where the span is as long as the token's decoded bytes,
    else these bytes counted from the last such end."""
    sure = hi - lo == sizes
    decoded = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(sizes)), -1))
    return np.where(last < 0, decoded, hi[last] + decoded - decoded[last])


def char_starts(text: str) -> np.ndarray:
    """Byte offset of every character, and of the end."""
    data = np.frombuffer(text.encode(), np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def links_of(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, n: int):
    """Every pair of ids that share one of ``n`` groups: group, pair code and number of links."""
    n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    size = n_a * n_b
    small = np.flatnonzero(size <= LARGE_GROUP)
    each = size[small]
    group = np.repeat(small, each)
    k = ragged(np.zeros(len(small), np.int64), each)
    width = n_b[group]
    codes = [a[first_a[group] + k // width] << 32 | b[first_b[group] + k % width]]
    groups, times = [group], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(size > LARGE_GROUP):  # distinct ids of each side once, with the product of their numbers
        x, m = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        y, w = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        codes.append((x[:, None] << 32 | y[None, :]).ravel())
        times.append((m[:, None] * w[None, :]).ravel())
        groups.append(np.full(len(x) * len(y), g))
    return np.concatenate(groups), np.concatenate(codes), np.concatenate(times), n_a, n_b


class _Numbering:
    """Alignments of the parts seen and numbers of their pairs, until either table is full."""

    def __init__(self, t: Tokenizers):
        self.t = t
        self.part: dict[str, int] = {}
        self.number: dict[int, int] = {}
        self.documents = np.zeros(0, np.int64)  # of each number
        self.known = np.zeros(0, bool)  # whether both tokenizers give the part back
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.groups: list[str] = []
        self.first = np.zeros(1, np.int64)  # of each part's entries in the next two
        self.numbers, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers_of(self, parts: list[str]) -> np.ndarray:
        """Numbers of different parts; new ones are added."""
        self.learn([x for x in parts if x not in self.part])
        return np.fromiter(map(self.part.__getitem__, parts), np.int64, len(parts))

    def learn(self, parts: list[str]) -> None:
        """Add new parts, each once. Many are encoded as one text."""
        joined, alone = [], []
        for x in parts:
            # A piece with the sign for a space is never given back as it was.
            can_join = x and ("\x21" <= x[-1] <= "\x7e" or x[-1] > "\x7f") and _SPACE not in x
            (joined if can_join and self.t.cut else alone).append(x)
        found, again = self._aligned([joined[k : k + JOINED] for k in range(0, len(joined), JOINED)])
        more, lost = self._aligned([[x] for x in chain(alone, *again)])
        found += more
        order = [x for run, *_ in found for x in run] + [x for run in lost for x in run]
        self.part.update(zip(order, range(len(self.known), len(self.known) + len(order)), strict=True))
        n_lost = sum(map(len, lost))
        self.known = np.concatenate([self.known, np.ones(len(order) - n_lost, bool), np.zeros(n_lost, bool)])
        self.counts = np.concatenate([self.counts, *(f[1] for f in found), np.zeros((n_lost, 4), np.int64)])
        for f in found:
            self.groups += f[2]
        self.groups += [""] * n_lost
        codes = np.concatenate([_NONE, *(f[4] for f in found)])
        distinct, at = np.unique(codes, return_inverse=True)
        number = np.array([self.number.setdefault(c, len(self.number)) for c in distinct.tolist()], np.int64)
        entries = np.concatenate([_NONE, *(f[3] for f in found), np.zeros(n_lost, np.int64)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(entries)])
        self.numbers = np.concatenate([self.numbers, number[at]])
        self.times = np.concatenate([self.times, *(f[5] for f in found)])
        self.documents = np.concatenate([self.documents, np.zeros(len(self.number) - len(self.documents), np.int64)])

    def _aligned(self, runs: list[list[str]]) -> tuple[list[tuple], list[list[str]]]:
        """Parts of many runs with their alignment, and the runs that are not given back byte by byte."""
        found, failed = [], []
        for k in range(0, len(runs), ENCODED_AT_ONCE):
            some = [_Run(x) for x in runs[k : k + ENCODED_AT_ONCE]]
            encoded = self.t.a.encode_batch([" " + x.text for x in some], add_special_tokens=False)
            good = []
            for run, e in zip(some, encoded, strict=True):
                same = run.given_back(e, self.t.b.encode(run.text, return_type="proto"), self.t)
                good.append(run) if same else failed.append(run.parts)
            if got := _align(good, self.t):
                found.append(got)
            else:
                failed += [x.parts for x in good]
        return found, failed

    @property
    def full(self) -> bool:
        return len(self.part) >= PARTS or len(self.number) >= PAIRS


class _Run:
    """Parts as one text, a full stop between two where a bare space is not safe; tokens never reach over it.
    All but a single part end with a character that is not white."""

    def __init__(self, parts: list[str]):
        self.parts = parts
        self.barred = [x[-1] > "\x7f" and not "\x21" <= y[0] <= "\x7e" for x, y in pairwise(parts)] + [False]
        gaps = [_BARRIER if x else " " for x in self.barred]
        gaps[-1] = ""
        self.text = "".join(chain.from_iterable(zip(parts, gaps, strict=True)))

    def given_back(self, encoded, proto, t: Tokenizers) -> bool:
        """Keep the tokens; whether the joined bytes of both sides are space+text."""
        whole, pieces = (" " + self.text).encode(), list(proto.pieces)
        self.size, self.a, self.a_offsets = len(whole), encoded.ids, encoded.offsets
        self.b, self.b_ends = [p.id for p in pieces], [p.end for p in pieces]
        return b"".join([t.a_bytes[i] for i in self.a]) == whole and b"".join([t.b_bytes[i] for i in self.b]) == whole


def _align(runs: list[_Run], t: Tokenizers) -> tuple | None:
    """All parts of the runs; of each part: counts, groups as text, number of pairs; then all pairs and their links.
    None where a part does not end with a token on both sides."""
    parts = [x for run in runs for x in run.parts]
    if not parts:
        return None
    flat = lambda lists: np.fromiter(chain.from_iterable(lists), np.int64)
    a, b = flat(x.a for x in runs), flat(x.b for x in runs)
    # The texts behind each other, each after its space, are one text in which each run's offsets count from its start.
    at = char_starts("".join([" " + x.text for x in runs]))
    before = lambda sizes: np.cumsum([0, *sizes[:-1]])
    offsets = flat(chain.from_iterable(x.a_offsets for x in runs)).reshape(-1, 2)
    spans = at[offsets + np.repeat(before([len(x.text) + 1 for x in runs]), [len(x.a) for x in runs])[:, None]]
    a_ends = refined_ends(spans[:, 0], spans[:, 1], t.a_sizes[a])
    # Spans of B follow each other and count from the text's first byte; the space before it belongs to the first piece.
    hi = flat(x.b_ends for x in runs) + 1
    hi += np.repeat(before([x.size for x in runs]), [len(x.b) for x in runs])
    b_ends = refined_ends(np.concatenate([[0], hi[:-1]]), hi, t.b_sizes[b])
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    # Ends of the parts, each with its space and the barrier before it.
    barred = np.array([y for x in runs for y in x.barred])
    size = np.array([len(x.encode()) + 1 for x in parts], np.int64)
    size[1:] += np.where(barred[:-1], len(_BARRIER) - 1, 0)
    stops = np.cumsum(size)
    last = np.searchsorted(cuts, stops)
    if (cuts[np.minimum(last, len(cuts) - 1)] != stops).any():
        return None
    # The group of a barrier is the one right after a part.
    owner = np.searchsorted(stops, cuts)
    inside = np.ones(len(cuts), bool)
    inside[last[barred] + 1] = False
    a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
    keep_a, keep_b = inside[a_group], inside[b_group]
    a, a_group, b, b_group = a[keep_a], a_group[keep_a], b[keep_b], b_group[keep_b]
    group, codes, times, n_a, n_b = links_of(a, a_group, b, b_group, len(cuts))
    # One entry for each pair of a part.
    entry = np.lexsort((codes, owner[group]))
    part, codes, times = owner[group][entry], codes[entry], times[entry]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (part[1:] != part[:-1])
    starts = np.flatnonzero(fresh)
    times = np.add.reduceat(times, starts)
    per = lambda x: np.bincount(owner, weights=x, minlength=len(parts)).astype(np.int64)
    counts = np.stack([per(n_a), per(n_b), per(inside), per(n_a * n_b)], axis=1)
    entries = np.bincount(part[starts], minlength=len(parts))
    return parts, counts, _written(a, a_group, b, b_group, owner, t), entries, codes[starts], times


def _written(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, owner: np.ndarray, t: Tokenizers) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each part in order."""
    key = np.concatenate([2 * a_group, 2 * b_group + 1])
    order = np.argsort(key, kind="stable")
    ids, key = np.concatenate([a, b])[order], key[order]
    part = owner[key >> 1]
    borders = np.flatnonzero(part[1:] != part[:-1])
    step = np.full(len(key), 3)  # what stands after an id: , | ; or the part's end
    step[:-1] = np.where(key[1:] == key[:-1], 0, np.where(key[1:] >> 1 == key[:-1] >> 1, 1, 2))
    step[borders] = 3
    texts = t.written.take(pa.array(len(_AFTER_ID) * ids + step))
    bounds = np.concatenate([[0], borders + 1, [len(ids)]])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), texts), "").to_numpy(zero_copy_only=False).tolist()


_ROW = pa.schema(
    [
        ("kind", pa.int32()), ("task", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("place", pa.int32()),
        ("pairs", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())),
    ]
)
_ROW_SQL = (
    "kind int, task bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
    "place int, pairs array<bigint>, numbers array<int>, times array<bigint>"
)
_DOCUMENT, _PAIRS = 0, 1
_NONE = np.empty(0, np.int64)


def _documents(texts: list[str], sizes: list[int], flat: np.ndarray, known: _Numbering, digest: bool) -> dict[str, pa.Array]:
    """Counts, groups and pair numbers of each text, which has the next ``sizes`` of the parts ``flat``."""
    n = len(texts)
    row = np.repeat(np.arange(n), sizes)
    good = np.bincount(row, weights=~known.known[flat], minlength=n) == 0
    good &= np.fromiter((x != "" for x in texts), bool, n)
    flat, row = flat[good[row]], row[good[row]]
    sums = np.zeros((len(flat) + 1, 4), np.int64)
    np.cumsum(known.counts[flat], axis=0, out=sums[1:])
    counts = np.diff(sums[np.searchsorted(row, np.arange(n + 1))], axis=0)
    groups = map(known.groups.__getitem__, flat.tolist())
    written = []
    for k, ok in zip(sizes, good.tolist(), strict=True):
        text = ";".join(islice(groups, k)) if ok else ""
        written.append(hashlib.sha256(text.encode()).hexdigest() if digest and ok else text)
    size = known.first[flat + 1] - known.first[flat]
    entry = ragged(known.first[flat], size)
    key = np.repeat(row, size) << 32 | known.numbers[entry]
    order = np.argsort(key)
    key, times = key[order], known.times[entry[order]]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(fresh)
    distinct, times = key[starts], np.add.reduceat(times, starts) if len(starts) else times
    numbers, owner = distinct & 0xFFFFFFFF, distinct >> 32
    known.documents += np.bincount(numbers, minlength=len(known.documents))
    bounds = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
    columns = {c: pa.array(counts[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    return columns | {
        "groups": pa.array(written, pa.string()),
        "numbers": pa.ListArray.from_arrays(bounds, pa.array(numbers.astype(np.int32))),
        "times": pa.ListArray.from_arrays(bounds, pa.array(times)),
    }


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else _NONE
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat).cast(kind))


def _batch(columns: dict, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _ROW], schema=_ROW)


def _encode(batches: Iterator[pa.RecordBatch], files: tuple[str, str], digest: bool) -> Iterator[pa.RecordBatch]:
    t = load(*files)
    known = _Numbering(t)
    task = TaskContext.get().partitionId() << 32
    for batch in slices(batches):
        ids = batch.column("doc_id")
        texts = ["" if x is None else x.decode() for x in batch.column("text").to_pylist()]
        parts = [parts_of(x, t.cut) for x in texts]
        words = pa.array(list(chain.from_iterable(parts)), pa.string()).dictionary_encode()
        flat = known.numbers_of(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        columns = _documents(texts, [len(x) for x in parts], flat, known, digest)
        columns |= {"kind": pa.array(np.full(len(texts), _DOCUMENT, np.int32)), "task": pa.array(np.full(len(texts), task)), "doc_id": ids}
        yield _batch(columns, len(texts))
        if known.full:
            yield from _pairs(known, task)
            known, task = _Numbering(t), task + 1
    yield from _pairs(known, task)


def _pairs(known: _Numbering, task: int) -> Iterator[pa.RecordBatch]:
    pairs = np.fromiter(known.number, np.int64, len(known.number))
    for k in range(0, len(pairs), PAIRS_PER_ROW):
        columns = {
            "kind": pa.array(np.array([_PAIRS], np.int32)), "task": pa.array(np.array([task])), "place": pa.array(np.array([k], np.int32)),
            "pairs": _lists([pairs[k : k + PAIRS_PER_ROW]], pa.int64()), "times": _lists([known.documents[k : k + PAIRS_PER_ROW]], pa.int64()),
        }
        yield _batch(columns, 1)


_OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task after its pair counts; both come sorted, counts first."""
    task, counts, best = None, _NONE, _NONE
    for batch in batches:
        tasks, kinds = np.asarray(batch.column("task")), np.asarray(batch.column("kind"))
        rows: list[int] = []
        sums: list[tuple[int, int]] = []
        for i in range(batch.num_rows):
            if task != tasks[i]:
                task, counts, best = int(tasks[i]), _NONE, _NONE
            if kinds[i] == 0:
                counts = np.concatenate([counts, np.asarray(batch.column("counts")[i].values)])
                best = np.concatenate([best, np.asarray(batch.column("times")[i].values)])
                continue
            n, times = np.asarray(batch.column("numbers")[i].values), np.asarray(batch.column("times")[i].values)
            sums.append((int((best[n] * times).sum()), int((counts[n] * times).sum())))
            rows.append(i)
        own = batch.take(pa.array(rows, pa.int64()))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        yield pa.RecordBatch.from_arrays(
            [*(own.column(c) for c in names), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()), own.column("groups")],
            names=[*names, "n_best", "count_sum", "groups"],
        )


@dataclass
class Alignment:
    """``documents``: counts, groups and pair sums of every row. ``pairs``: ``a_id, b_id, documents, best``."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, folder: str = FOLDER, digest: bool = False) -> Alignment:
    """Align the tokens of A and B in every row of ``docs`` (``doc_id``, ``text``).

    ``documents`` has ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``; ``groups`` is the written form
    ``a1,a2|b1;a3|b2`` or, with ``digest``, its SHA-256. ``n_best`` counts links whose pair is the most frequent one of its A id,
    ties included; ``count_sum`` adds the documents of each link's pair. A null or empty text, and a text that
    either tokenizer does not give back byte by byte, has zeros and ''. Ids may be null or repeat: each row
    is a document and counts on its own. Other columns are ignored; an empty table gives an empty result.

    ``folder`` must be there on every executor, as the libraries read files, not Spark's paths.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "aligned")
    files = (os.path.join(folder, A_FILE), os.path.join(folder, B_FILE))
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    own.mapInArrow(partial(_encode, files=files, digest=digest), _ROW_SQL).write.partitionBy("kind").parquet(path)
    read = spark.read.schema(_ROW_SQL).parquet(path)
    met = read.where(F.col("kind") == _PAIRS).select("task", "place", F.posexplode(F.arrays_zip("pairs", "times")).alias("k", "z"))
    met = met.select("task", (F.col("place") + F.col("k")).alias("number"), F.col("z.pairs").alias("pair"), F.col("z.times").alias("n"))
    counted = met.groupBy("pair").agg(F.sum("n").alias("count"))
    a_id = F.shiftright("pair", 32)
    # One row for each id of A at most: as small as its vocabulary.
    highest = counted.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("most"))
    counts_path = scratch_path(spark, "pair-counts")
    counted.join(F.broadcast(highest), a_id == F.col("a_id")).select(
        "a_id", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "pair", "count", (F.col("count") == F.col("most")).alias("best")
    ).write.parquet(counts_path)
    pairs = spark.read.parquet(counts_path)
    back = met.join(pairs, "pair").select("task", "number", "count", F.col("best").cast("bigint").alias("best"))
    block = F.floor(F.col("number") / PAIRS_PER_ROW).cast("int")
    rows = back.groupBy("task", block.alias("place")).agg(F.sort_array(F.collect_list(F.struct("number", "count", "best"))).alias("z"))
    none = lambda kind: F.lit(None).cast(kind)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "numbers")
    kinds = ("bigint", "bigint", "bigint", "bigint", "bigint", "string", "array<int>")
    first = rows.select(
        "task", F.lit(0).alias("kind"), "place", *[none(k).alias(c) for c, k in zip(columns, kinds, strict=True)],
        F.col("z.best").alias("times"), F.col("z.count").alias("counts"),
    )
    documents = read.where(F.col("kind") == _DOCUMENT).select(
        "task", F.lit(1).alias("kind"), F.lit(0).alias("place"), *columns, "times", none("array<bigint>").alias("counts")
    )
    together = documents.union(first.select(documents.columns)).repartition("task").sortWithinPartitions("task", "kind", "place")
    return Alignment(
        together.mapInArrow(_sum_counts, _OUT), pairs.select("a_id", "b_id", F.col("count").alias("documents"), "best")
    )
