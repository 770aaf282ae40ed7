"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; a text's wanted number of copies is target / source size, the same for
all texts of a source. Whole copies are given at once. The fractions are rounded in pairs: of two
texts one takes over words from the other, in a random direction that keeps both expectations, until one fraction is
0 or 1; the sum of words never changes. One residual per source and chunk remains; residuals
meet in a tree of ever coarser chunks until each source has one, which is drawn. Texts are paired in
the order of falling size, so the residuals are small and a source misses its target by less than one of its texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gazeframe.llm.words import U, mix, whole_row
from gazeframe.operators.ordering import by_range, ordinal_within
from gazeframe.session import durable, scratch_path

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
CHUNK = 1_000  # texts per chunk, about
FAN = 64  # chunks that meet in the next level of the tree
BROADCAST_SOURCES = 50_000
_NEAR = 1e-12

WORD_COUNT = (
    "CASE WHEN text IS NULL OR btrim(text, ' \\t\\n\\u000B\\u000C\\r') = '' THEN 0L "
    "ELSE CAST(size(split(btrim(text, ' \\t\\n\\u000B\\u000C\\r'), '[\\\\x20\\\\x09-\\\\x0D]+')) AS BIGINT) END"
)


def source_targets(sized: DataFrame) -> DataFrame:
    """``source, ordinal, texts, source_size, target`` from ``source, size`` rows.

    Sources in code point order, null last, weigh 5, 2, 1, repeating. Whoever would exceed three times its
    size gets just that, and the rest is shared anew by weight among the others; the driver sees two sums per round.
    """
    sums = sized.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("source_size"))
    sums = sums.withColumn("absent", F.col("source").isNull())
    ranked = ordinal_within(by_range(sums, [], ["absent", "source"]), [], ["absent", "source"])
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("ordinal") % len(WEIGHTS) + 1).cast("int"))
    table = durable(ranked.withColumn("weight", weight.cast("double")).withColumn("most", MOST_COPIES * F.col("source_size")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        over = F.col("most") <= level * F.col("weight")
        full, open_weight = table.agg(
            F.sum(F.when(over, F.col("most")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        new = (total - (full or 0)) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    target = F.least(F.col("most").cast("double"), level * F.col("weight"))
    return table.select("source", "ordinal", "texts", "source_size", target.alias("target"))


def _pair(i: list, j: list, u: float) -> None:
    """Move words between two [fraction, size] units until one fraction is 0 or 1."""
    (p, a), (q, b) = i[:2], j[:2]
    up = min(1 - p, q * b / a)
    down = min(p, (1 - q) * b / a)
    move = up if u * (up + down) < down else -down
    i[0], j[0] = p + move, q - move * a / b
    for x in (i, j):
        x[0] = 0.0 if x[0] < _NEAR else 1.0 if x[0] > 1 - _NEAR else x[0]


_STATE = "ordinal bigint, chunk bigint, doc_id bigint, tag bigint, size bigint, part double"


def _round(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Pair neighbours of each (source, chunk) run of a sorted stream; only one unit is carried."""
    names = [x.split()[0] for x in _STATE.split(", ")]
    held, key = None, None
    for batch in batches:
        out = []
        columns = [batch.column(n).to_pylist() for n in names]
        # One draw per row, from what the row is.
        with np.errstate(over="ignore"):
            tags = np.asarray(batch.column("tag")).view(np.uint64)
            draws = (mix(tags + U(seed)) >> U(11)).astype(np.float64) / (1 << 53)
        for row, u in zip(zip(*columns, strict=True), draws.tolist(), strict=True):
            unit = [row[5], row[4], row]
            if row[:2] != key:
                if held:
                    out.append((*held[2][:5], held[0]))
                held, key = None, row[:2]
            if held is None:
                held = unit
            else:
                _pair(held, unit, u)
                if held[0] in (0.0, 1.0):
                    held, unit = unit, held
                out.append((*unit[2][:5], unit[0]))
            if held[0] in (0.0, 1.0):
                out.append((*held[2][:5], held[0]))
                held = None
        if out:
            yield _state(out, names)
    if held:
        yield _state([(*held[2][:5], held[0])], names)


def _state(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def mix_copies(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken, key`` for every row of ``docs``.

    A null text has size 0; texts of size 0 get the whole copies only. A null ``source`` is a source of
    its own, the last. Random draws come from ids, sizes and texts, so reruns agree; repeated rows are
    separate and interchangeable. ``key`` hashes id, source and text. Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    narrow = scratch_path(spark, "mix-sizes")
    docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "source",
        F.expr(WORD_COUNT).alias("size"),
        F.xxhash64("doc_id", "source", "text").alias("key"),
    ).write.parquet(narrow)
    sized = spark.read.parquet(narrow)
    sources = source_targets(sized)
    bounds = sources.agg(F.count(F.lit(1)), F.max("texts")).first()
    side = F.broadcast(sources) if bounds[0] <= BROADCAST_SOURCES else sources
    s = side.withColumnRenamed("source", "_source")
    rows = sized.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wish = F.least(wish, F.lit(float(MOST_COPIES)))
    rows = rows.withColumn("whole", F.floor(wish + _NEAR).cast("bigint")).withColumn("part", F.greatest(wish - F.col("whole"), F.lit(0.0)))
    chunks = F.ceil(F.col("texts") / CHUNK).cast("bigint")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(seed)), chunks))
    rows = rows.withColumn("tag", F.xxhash64("key", F.lit(seed + 1)))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in _STATE.split(", ")]
    ready = (F.col("part") <= _NEAR) | (F.col("size") == 0)
    state = rows.where(~ready).select(*names, "key", "whole", "source", "source_size", "target")
    # What a text is travels once; the rounds carry only what they need and meet it again by key.
    todo = state.select(*names[:2], F.col("key").alias("doc_id"), *names[3:])
    done = None
    levels = max(1, math.ceil(math.log(max(2, -(-(bounds[1] or 1) // CHUNK)), FAN)))
    for level in range(levels + 1):
        if level:
            todo = todo.withColumn("chunk", F.floor(F.col("chunk") / FAN).cast("bigint"))
        paired = durable(
            todo.repartition(n, "ordinal", "chunk")
            .sortWithinPartitions("ordinal", "chunk", F.desc("size"), "tag", "doc_id")
            .mapInArrow(partial(_round, seed=seed + 1000 * level), _STATE)
        )
        over = paired.where("part > 0 and part < 1")
        fixed = paired.where("part = 0 or part = 1")
        done = fixed if done is None else done.union(fixed)
        todo = over
    draw = F.pmod(F.xxhash64("tag", F.lit(seed + 2)), F.lit(1 << 30)) / float(1 << 30)
    done = done.union(todo.withColumn("part", F.when(draw < F.col("part"), 1.0).otherwise(0.0)))
    ups = done.groupBy(F.col("doc_id").alias("key")).agg(F.sum("part").cast("bigint").alias("ups"))
    # Rows with one key are the same text; the first ``ups`` of them get the further copy.
    nth = F.row_number().over(_by_key())
    kept = rows.select("doc_id", "source", "size", "source_size", "target", "whole", "key").join(ups, "key", "left")
    more = F.when(nth <= F.coalesce("ups", F.lit(0)), 1).otherwise(0)
    out = kept.withColumn("copies", (F.col("whole") + more).cast("bigint"))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key"
    )


def _by_key() -> WindowSpec:
    return Window.partitionBy("key").orderBy("key")


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` with every row as often as :func:`mix_copies` says, all columns."""
    copies = mix_copies(docs, seed).groupBy("key").agg(F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n"))
    more = (F.col("all") - F.col("least") * F.col("n")).alias("more")
    rows = docs.select(F.xxhash64("doc_id", "source", "text").alias("key"), whole_row(docs))
    met = rows.join(copies.select("key", "least", more), "key").withColumn("nth", F.row_number().over(_by_key()))
    times = (F.col("least") + F.when(F.col("nth") <= F.col("more"), 1).otherwise(0)).cast("int")
    return met.where(times > 0).select(F.explode(F.array_repeat("row", times)).alias("row")).select("row.*")
