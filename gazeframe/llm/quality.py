"""Quality rules: exact counts per text, and distance of its histograms from its language's.

Two histograms describe a text: character classes, and the common words of its language (all other
words are one more entry). The reference of a language is the mean of the normalised histograms of all its
texts, gathered in one pass with one row of sums per slice. A text is far off if the
Jensen-Shannon distance (base two, 0 to 1) of either histogram exceeds its limit; texts too short for
a histogram to mean anything are not judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.llm.words import U, Words, mix, slices, whole_row, window_rows, windows
from gazeframe.session import scratch_path

LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
REPEAT_WINDOW = 5
#: Limits of the distances, and the sizes from which they are judged.
CLASS_LIMIT, CLASS_LEAST_CHARS = 0.32, 200
WORD_LIMIT, WORD_LEAST_WORDS = 0.31, 150
#: The most frequent languages' references travel with the tasks; those of all others are joined by language.
LANGUAGES = 256
#: Parts of each further language, none of which has more than one in ``LANGUAGES`` of the texts.
SALTS = 8

# Frequent function words by language code.
COMMON = {
    "en": "the of and to a in is that for it was on with be as by this are at from",
    "fr": "de la le et les des en un du une que pour est qui dans par pas au sur avec",
    "de": "der die und in den von zu das sich mit auf des für ist nicht im dem ein eine als",
    "es": "de la que el en y los se del las por un no con su una es para al lo",
}
_LISTS = {k: [w.encode() for w in v.split()] for k, v in COMMON.items()}
_LISTS[""] = sorted({w for words in _LISTS.values() for w in words})

CLASSES = 8
_CLASS = np.full(256, 7, np.uint8)  # other symbols
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[ord("!")] = 5
_CLASS[0xC0:] = 6  # the first byte of a character beyond ASCII
_CLASS[0x80:0xC0] = 8  # bytes after the first: no character of their own
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _list_of(lang: str | None) -> str:
    code = (lang or "").lower()[:2]
    return code if code in _LISTS else ""


def _hash_words(items: list[bytes]) -> np.ndarray:
    return Words(pa.array(items, pa.binary())).hashes()


_HASHES = {k: _hash_words(v) for k, v in _LISTS.items()}


def class_histograms(words: Words) -> np.ndarray:
    size = int(words.offsets[-1])
    row = np.repeat(np.arange(words.rows), np.diff(words.offsets))
    flat = np.bincount(row * (CLASSES + 1) + _CLASS[words.data[:size]], minlength=words.rows * (CLASSES + 1))
    return flat.reshape(words.rows, CLASSES + 1)[:, :CLASSES].astype(float)


def word_histograms(lowered: Words, langs: list[str]) -> list[np.ndarray]:
    """Counts of the listed words of each text's language, and last of all others."""
    h = lowered.hashes()
    out: list[np.ndarray] = [np.empty(0)] * lowered.rows
    for kind in set(langs):
        known = np.sort(_HASHES[kind])
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        code = np.where(known[at] == h, at, len(known))
        width = len(known) + 1
        flat = np.bincount(lowered.row_of_word() * width + code, minlength=lowered.rows * width).reshape(-1, width)
        for i, lang in enumerate(langs):
            if lang == kind:
                out[i] = flat[i].astype(float)
    return out


def _share(h: np.ndarray) -> np.ndarray:
    total = h.sum()
    return h / total if total else h


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base two; 0 if either is empty."""
    if not p.any() or not q.any():
        return 0.0
    m = (p + q) / 2
    part = lambda x: float(np.sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0)))
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of normalised histograms: one row per language and slice."""
    for batch in slices(batches):
        langs = batch.column("lang").to_pylist()
        words = Words(batch.column("text"))
        classes = class_histograms(words)
        common = word_histograms(Words(batch.column("text"), lower=True), [_list_of(x) for x in langs])
        sums: dict[str, list] = {}
        for i, lang in enumerate(langs):
            s = sums.setdefault(lang, [0, np.zeros(CLASSES), np.zeros(len(common[i]))])
            s[0] += 1
            s[1] += _share(classes[i])
            s[2] += _share(common[i])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.string()),
                pa.array([s[0] for s in sums.values()], pa.int64()),
                pa.array([[*s[1], *s[2]] for s in sums.values()], pa.list_(pa.float64())),
            ],
            names=["lang", "n", "sums"],
        )


Reference = tuple[np.ndarray, np.ndarray]


def _reference(n: int, sums: list[float]) -> Reference:
    x = np.round([v / n for v in sums], 12)
    return _share(x[:CLASSES]), _share(x[CLASSES:])


def references(docs: DataFrame) -> tuple[dict[str, Reference], DataFrame | None]:
    """Mean histograms of every language, from all texts.

    Those of the ``LANGUAGES`` most frequent ones reach the driver, fewer than a hundred numbers each. All
    others stay in a table of ``lang, n, sums``; it is None if there are none.
    """
    spark = docs.sparkSession
    per_slice = docs.mapInArrow(_gather, "lang string, n bigint, sums array<double>")
    per_dim = per_slice.select("lang", "n", F.posexplode("sums").alias("dim", "x"))
    summed = per_dim.groupBy("lang", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    path = scratch_path(spark, "language-sums")
    summed.groupBy("lang").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("dims")
    ).select("lang", "n", F.col("dims.x").alias("sums")).write.parquet(path)
    table = spark.read.parquet(path)
    rows = table.orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    frequent = {r["lang"]: _reference(r["n"], r["sums"]) for r in rows[:LANGUAGES]}
    return frequent, table.where(~F.col("lang").isin(list(frequent))) if len(rows) > LANGUAGES else None


def _with_references(rows: DataFrame, lang: str, text: str, refs: tuple, step, schema: str) -> DataFrame:
    """Run ``step`` over ``rows``; rows of less frequent languages bring their reference in ``n`` and ``sums``."""
    frequent, others = refs
    if others is None:
        return rows.mapInArrow(partial(step, refs=frequent), schema)
    listed = F.coalesce(F.col(lang), F.lit("")).isin(list(frequent))
    joined = _joined(rows.where(~listed), lang, text, others)
    return rows.where(listed).mapInArrow(partial(step, refs=frequent), schema).union(
        joined.mapInArrow(partial(step, refs={}), schema)
    )


def _joined(rows: DataFrame, lang: str, text: str, others: DataFrame) -> DataFrame:
    """``rows`` with ``n`` and ``sums`` of their language; frequent languages meet in parts."""
    salt = F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")
    side = others.select(
        F.col("lang").alias("_lang"), "n", "sums", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    )
    keyed = rows.select("*", F.coalesce(F.col(lang), F.lit("")).alias("_lang"), salt.alias("_salt"))
    return keyed.join(side, ["_lang", "_salt"]).select(*rows.columns, "n", "sums")


def _references_of(batch: pa.RecordBatch, langs: list[str], refs: dict[str, Reference]) -> dict[str, Reference]:
    """The references of a batch's languages: those of ``refs``, or of the batch's own columns."""
    if "sums" not in batch.schema.names:
        return refs
    first = {lang: i for i, lang in enumerate(langs)}
    n, sums = batch.column("n"), batch.column("sums")
    return {lang: _reference(n[i].as_py(), sums[i].as_py()) for lang, i in first.items()}


def _counts(batch: pa.RecordBatch) -> tuple[Words, dict[str, np.ndarray]]:
    words = Words(batch.column("text"))
    data, at = words.data[: words.offsets[-1]], words.offsets
    kind = _CLASS[data]
    start, row = window_rows(words, REPEAT_WINDOW)
    h = words.hashes()
    key = mix(windows(h, REPEAT_WINDOW)[start] + row.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(h) + REPEAT_WINDOW + 1, np.int64)
    np.add.at(step, start[twice], 1)
    np.add.at(step, start[twice] + REPEAT_WINDOW, -1)
    repeated = np.cumsum(step)[: len(h)] > 0
    lines = np.zeros(words.rows, np.int64)
    raw = data.tobytes()
    for i in range(words.rows):
        text = raw[at[i] : at[i + 1]]
        if text.count(b"\n"):
            inked = [x for x in text.split(b"\n") if x.strip(b" \t\v\f\r")]
            lines[i] = len(inked) - len(set(inked))
    return words, {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _row_sums((kind != 3) & (kind != 8), at),
        "n_symbols": _row_sums(_SYMBOL[data], at),
        "n_dup_lines": lines,
        "n_repeat_words": _row_sums(repeated, words.first),
    }


def _judge(batches: Iterator[pa.RecordBatch], refs: dict) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, out = _counts(batch)
        langs = batch.column("lang").to_pylist()
        kinds = [_list_of(x) for x in langs]
        own = _references_of(batch, langs, refs)
        classes = class_histograms(words)
        common = word_histograms(Words(batch.column("text"), lower=True), kinds)
        far_c, far_w = np.zeros(words.rows), np.zeros(words.rows)
        chars = classes.sum(axis=1)
        for i, lang in enumerate(langs):
            ref = own[lang]
            if chars[i] >= CLASS_LEAST_CHARS:
                far_c[i] = distance(_share(classes[i]), ref[0])
            if out["n_words"][i] >= WORD_LEAST_WORDS:
                far_w[i] = distance(_share(common[i]), ref[1])
        failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * out["n_words"])
        kept = ~failed & (far_c <= CLASS_LIMIT) & (far_w <= WORD_LIMIT)
        out |= {"base_failed": failed, "kept": kept, "class_distance": far_c, "word_distance": far_w}
        rest = [n for n in batch.schema.names if n not in ("text", "lang", "n", "sums")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in rest), *map(pa.array, out.values())], names=[*rest, *out]
        )


VERDICT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, class_distance double, word_distance double"
)


def _inputs(docs: DataFrame, *extra) -> DataFrame:
    return docs.select(
        *extra,
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )


def judge(docs: DataFrame) -> DataFrame:
    """Counts, distances and verdict for every row of ``docs`` (``doc_id``, ``text``, ``lang``).

    A null text is empty and fails; a null ``lang`` is a language of its own. Repeated rows get the same
    answer each. Other columns are ignored. An empty table gives an empty result.
    """
    refs = references(_inputs(docs))
    return _with_references(_inputs(docs, "doc_id"), "lang", "text", refs, _judge, f"doc_id bigint, {VERDICT}")


def _verdict(text: pa.Array, lang: pa.Array, refs: dict, *reference: pa.Array) -> pa.Array:
    columns = [text, lang, *reference]
    batch = pa.RecordBatch.from_arrays(columns, names=["text", "lang", "n", "sums"][: len(columns)])
    kept = [judged.column("kept") for judged in _judge(iter([batch]), refs)]
    return pa.concat_arrays(kept) if kept else pa.array([], pa.bool_())


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an accepting verdict, all columns, whatever their names.

    Null texts are empty and go; a null ``lang`` is a language of its own; rows that repeat go or stay together; an empty
    table stays empty. Only text and language visit Python, and a truth value comes back.
    """
    frequent, others = references(_inputs(docs))

    @F.arrow_udf("boolean")
    def verdict(text: pa.Array, lang: pa.Array) -> pa.Array:
        return _verdict(text, lang, frequent)

    @F.arrow_udf("boolean")
    def verdict_by_row(text: pa.Array, lang: pa.Array, n: pa.Array, sums: pa.Array) -> pa.Array:
        return _verdict(text, lang, {}, n, sums)

    text, lang = F.coalesce(docs["text"], F.lit("")).cast("binary"), F.coalesce(docs["lang"], F.lit(""))
    if others is None:
        return docs.where(verdict(text, lang))
    listed = lang.isin(list(frequent))
    rest = docs.where(~listed).select(whole_row(docs), text.alias("text"), lang.alias("lang"))
    judged = _joined(rest, "lang", "text", others).where(verdict_by_row("text", "lang", "n", "sums"))
    return docs.where(listed).where(verdict(text, lang)).union(judged.select("row.*"))
