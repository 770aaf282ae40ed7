"""Sixteen shards of near equal bytes by histogram sort, in DataFrame functions only.

Rows are ordered by (hash of the text, document id), so equal texts stand together. The driver asks for exact
bytes and rows below candidate boundaries, summed across all partitions, and refines only the
intervals in which a wanted split still lies, eight bits of the key at a time, until each split is within
tolerance of its place (or no finer key exists). Then every row knows its part by a binary search and is exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.words import whole_row
from gazeframe.session import scratch_path

SHARDS = 16
#: Allowed miss of a split, as a share of a shard's bytes.
TOLERANCE = 0.002
_LAST_ID = (1 << 63) - 1
_LEAST = -(1 << 63)
_SHIFTS = (52, 44, 36, 28, 20, 12, 4, 0)


@dataclass
class Split:
    """Rows at or above (``hash``, ``id``) lie above the split; ``bytes`` and ``rows`` lie below."""

    hash: int
    id: int
    bytes: int
    rows: int


def _sums(keys: DataFrame, level: int, inside: list[tuple]) -> dict[tuple, list[tuple]]:
    """Per open interval, (next digits, bytes, rows) in order. Level counts the digits of hash, then of id."""
    n = len(_SHIFTS)
    name, shift = ("hash", _SHIFTS[level]) if level < n else ("id", _SHIFTS[level - n])
    digit = F.shiftright(name, shift).alias("digit")
    if level == 0:
        rows = keys.groupBy(digit).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        return {(): sorted((r["digit"], r["bytes"], r["rows"]) for r in rows)}
    # At most one open interval for each split, so this table is no longer than the list of splits.
    if level <= n:
        at, first = F.shiftright("hash", _SHIFTS[level - 1]), [(p[0], None) for p in inside]
        opened = keys.sparkSession.createDataFrame(first, "at bigint, under bigint").drop("under")
        met = keys.withColumn("at", at).join(F.broadcast(opened), "at").withColumn("under", F.lit(None).cast("bigint"))
    else:
        opened = keys.sparkSession.createDataFrame(inside, "at bigint, under bigint")
        met = keys.withColumn("at", F.col("hash")).withColumn("under", F.shiftright("id", _SHIFTS[level - n - 1]))
        met = met.join(F.broadcast(opened), ["at", "under"])
    out: dict[tuple, list[tuple]] = {}
    for r in met.groupBy("at", "under", digit).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect():
        key = (r["at"],) if r["under"] is None else (r["at"], r["under"])
        out.setdefault(key, []).append((r["digit"], r["bytes"], r["rows"]))
    return {k: sorted(v) for k, v in out.items()}


def find_splits(keys: DataFrame, parts: int, tolerance: float = TOLERANCE) -> tuple[list[Split], int, int]:
    """``parts - 1`` splits of ``hash, id, size`` rows into near equal bytes; all bytes, all rows."""
    top = _sums(keys, 0, [])[()]
    if not top:
        return [], 0, 0
    total, count = sum(b for _, b, _ in top), sum(r for *_, r in top)
    slack = total / parts * min(1.0, tolerance * parts / SHARDS)
    found: list[Split | None] = [None] * (parts - 1)
    # Open splits: number -> (interval, bytes below, rows below).
    state = {j: ((), 0, 0) for j in range(parts - 1)}
    n = len(_SHIFTS)
    for level in range(2 * n):
        groups = {(): top} if level == 0 else _sums(keys, level, sorted({s[0] for s in state.values()}))
        running = {}
        for at, bins in groups.items():
            b, r, edges = 0, 0, []
            for digit, size, rows in bins:
                edges.append((b, r, digit, size, rows))
                b, r = b + size, r + rows
            running[at] = ([e[0] for e in edges], edges)
        nxt = {}
        for j, (at, below, rows_below) in state.items():
            want = total * (j + 1) / parts
            starts, edges = running[at]
            i = max(0, bisect_right(starts, want - below) - 1)
            b, r, digit, size, rows = edges[i]
            left = want - below - b
            edge = lambda d, bb, rr: _edge(level, at, d, below + bb, rows_below + rr)
            low, high = (digit, b, r), (digit + 1, b + size, r + rows)
            near = low if left <= size - left else high
            if min(abs(left), abs(size - left)) <= slack or rows == 1 or level == 2 * n - 1:
                found[j] = edge(*near)
            else:
                shift_done = level < n and _SHIFTS[level] == 0
                inner = (digit,) if level < n else (at[0], digit)
                nxt[j] = (inner if not shift_done else (digit,), below + b, rows_below + r)
        state = nxt
        if not state:
            break
    out = sorted(found, key=lambda s: (s.rows, s.hash, s.id))
    return out, total, count


def _edge(level: int, at: tuple, digit: int, below: int, rows: int) -> Split:
    n = len(_SHIFTS)
    if level < n:
        first = digit << _SHIFTS[level]
        return Split(first, _LEAST, below, rows) if first <= _LAST_ID else Split(_LAST_ID, _LAST_ID, below, rows)
    first = digit << _SHIFTS[level - n]
    return Split(at[0], first, below, rows) if first <= _LAST_ID else Split(at[0] + 1, _LEAST, below, rows)


def _part(splits: list[Split]) -> Column:
    """Number of splits at or below the row's key, by binary search in two literal arrays."""
    if not splits:
        return F.lit(0)
    hashes, ids = (F.array(*[F.lit(getattr(s, n)).cast("bigint") for s in splits]) for n in ("hash", "id"))
    steps = [1 << k for k in reversed(range(len(splits).bit_length()))]

    def step(pos: Column, width: Column) -> Column:
        to = pos + width
        h, i = F.try_element_at(hashes, to), F.try_element_at(ids, to)
        inside = (to <= len(splits)) & ((h < F.col("hash")) | ((h == F.col("hash")) & (i <= F.col("id"))))
        return F.when(inside, to).otherwise(pos)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def shard(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in ``row``, with ``size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: shards differ in bytes by the tolerance or by one text. Size is the text's UTF-8 bytes plus one
    (null: 1). A null ``doc_id`` sorts as the largest. Rows that repeat both text and id are never
    split from each other; their slots differ. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(
        whole_row(docs),
        F.xxhash64("text").alias("hash"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST_ID)).alias("id"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    path = scratch_path(spark, "shard-keys")
    keyed.select("hash", "id", "size").write.parquet(path)
    per = max(1, min(1024, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS)))
    splits, _, _ = find_splits(spark.read.parquet(path), SHARDS * per)
    below = [0, *(s.rows for s in splits)]
    offset = [b - below[i // per * per] for i, b in enumerate(below)]
    offsets = F.array(*[F.lit(x).cast("bigint") for x in offset])
    nth = F.row_number().over(Window.partitionBy("part").orderBy("hash", "id", "size"))
    dealt = keyed.withColumn("part", _part(splits)).withColumn("nth", nth)
    return dealt.select(
        "row",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("part") / per).cast("int").alias("shard"),
        (F.element_at(offsets, F.col("part") + 1) + F.col("nth") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
