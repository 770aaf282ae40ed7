"""Optimal length buckets: boundaries from a dynamic programme, token-budget batches inside each.

The histogram has one row per length that occurs, at any size of the input. A dynamic programme over it finds the
boundaries with the least padding when every text is padded to the boundary of its bucket. Only the histogram reaches the
driver, as two numbers for a length: ``m`` different lengths need texts of ``m * (m - 1) / 2`` words in all, so that it grows with the
root of the input at most (a million lengths: half a trillion words). Inside a
bucket texts are ranked in hash order, across any number of tasks, and cut into batches of as many
texts as the token budget holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.mixing import WORD_COUNT
from gazeframe.llm.words import ragged
from gazeframe.session import scratch_path

BUCKETS = 16
TOKEN_BUDGET = 16_384
LENGTHS = 400_000  # cuts weighed at once by the driver, about; no result depends on it
PART = 50_000  # texts ranked by one window, about


def length_histogram(sized: DataFrame) -> np.ndarray:
    """Length, texts and words, ascending; one row per length."""
    found = sized.groupBy("n_words").agg(F.count(F.lit(1)).alias("n")).toArrow()
    lengths, texts = (found[c].to_numpy() for c in ("n_words", "n"))
    order = np.argsort(lengths)
    return np.column_stack([lengths, texts, lengths * texts])[order].astype(np.int64)


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, words: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` runs of ``lengths`` with the least total padding.

    ``counts`` texts and ``words`` words stand at each of the ascending ``lengths``. The cost of a run is convex in
    the sense of Monge, so the best last cut moves one way only: each layer is solved by halving,
    all middles of a depth at once.
    """
    m = len(lengths)
    if m == 0:
        return []
    n = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    w = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    top = np.asarray(lengths, dtype=np.int64)
    cost = lambda i, j: top[j] * (n[j + 1] - n[i]) - (w[j + 1] - w[i])  # run i..j
    best = cost(np.zeros(m, int), np.arange(m))
    cuts = [np.zeros(m, int)]
    for _ in range(1, min(buckets, m)):
        now, cut = best.copy(), np.zeros(m, int)
        lo, hi = np.array([0]), np.array([m - 1])
        left, right = np.array([0]), np.array([m - 1])
        while len(lo):
            mid = (lo + hi) // 2
            last = np.minimum(mid, right)
            first = np.minimum(left, last)
            size = last - first + 1
            pick = np.empty(len(mid), int)
            turn = (np.cumsum(size) - 1) // LENGTHS
            for some in np.split(np.arange(len(mid)), np.flatnonzero(np.diff(turn)) + 1):
                many = size[some]
                i = ragged(first[some], many)
                value = np.where(i > 0, best[i - 1], 0) + cost(i, np.repeat(mid[some], many))
                least = np.minimum.reduceat(value, np.cumsum(many) - many)
                hit = np.flatnonzero(value == np.repeat(least, many))
                owner = np.repeat(np.arange(len(some)), many)[hit]
                pick[some] = i[hit[np.searchsorted(owner, np.arange(len(some)))]]
                now[mid[some]] = least
            cut[mid] = pick
            lo, hi, left, right = (
                np.concatenate([lo, mid + 1]),
                np.concatenate([mid - 1, hi]),
                np.concatenate([left, pick]),
                np.concatenate([pick, right]),
            )
            ok = lo <= hi
            lo, hi, left, right = lo[ok], hi[ok], left[ok], right[ok]
        best = now
        cuts.append(cut)
    ends, j = [], m - 1
    for cut in reversed(cuts):
        ends.append(int(lengths[j]))
        j = int(cut[j]) - 1
        if j < 0:
            break
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``doc_id, n_words, bucket, bucket_length, batch, slot, padding`` for every row of ``docs``.

    Length is the number of words of ``text`` (null: 0). A batch holds texts of one bucket, padded to
    its length, within ``budget`` words; a text longer than the budget is a batch of its own. Repeated
    rows are packed each; their order among themselves is open. Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pack-lengths")
    docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(WORD_COUNT).alias("n_words"), F.xxhash64("text").alias("tag")
    ).write.parquet(path)
    sized = spark.read.parquet(path)
    table = length_histogram(sized)
    ends = best_boundaries(*table.T, buckets) or [0]
    ends_sql = F.array(*[F.lit(e).cast("bigint") for e in ends])
    bucket = F.size(F.filter(ends_sql, lambda e: e < F.col("n_words")))
    rows = sized.withColumn("bucket", bucket).withColumn("bucket_length", F.element_at(ends_sql, F.col("bucket") + 1))

    # Ranks: texts are dealt by the leading bits of their hash, so parts follow the rank order.
    largest = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    parts = 1 << max(0, int(largest // PART)).bit_length()
    place = F.xxhash64("doc_id", "n_words", "tag").bitwiseAND(F.lit((1 << 62) - 1))
    rows = rows.withColumn("place", place).withColumn("part", F.floor(F.col("place") / F.lit((1 << 62) // parts)).cast("int"))
    sums = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("place", "doc_id")) - 1
    ranked = rows.withColumn("local", local).join(offsets, ["bucket", "part"])
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("bigint")
    rank = F.col("offset") + F.col("local")
    return ranked.select(
        "doc_id",
        "n_words",
        "bucket",
        "bucket_length",
        F.floor(rank / each).cast("bigint").alias("batch"),
        (rank % each).cast("bigint").alias("slot"),
        (F.col("bucket_length") - F.col("n_words")).alias("padding"),
    )
