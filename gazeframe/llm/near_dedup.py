"""Near duplicates by HyperMinHash: compressed registers, bands, corrected estimate, exact check.

1. Each text becomes its set of five-word shingles (64-bit hashes). Equal sets are one *class*,
   found by a 128-bit sum over the set, so copies never meet each other again. A class has a number
   of its own and one of its texts stands for it; ids come in again only at the end.
2. The registers: a shingle's hash picks one of 256 buckets; a bucket keeps the smallest rest as a
   leading-zero count (6 bits) and 10 mantissa bits. Empty buckets borrow from a filled one by a
   fixed order of preference, the same for all texts.
3. 64 bands of 4 registers. Two sets at the least similarity share no band with a probability
   of about 3e-11 (higher for sets far smaller than the register count, near 1e-6).
4. The estimate (matching registers, less the expected chance collisions) drops pairs six
   deviations below the limit; all others are confirmed on the full sets.
5. Only links between different components matter. First each member of a band group meets the group's
   smallest, which joins most. Components that a plausible pair of some band group still spans form
   a *family*. Families are dealt out in blocks of bounded size; a task compares two blocks, leaves out pairs
   already joined, and returns at most one link per member. So no link between components is missed, and
   what is written grows with the members, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.components import components, contract
from gazeframe.llm.words import U, Words, groups, mix, slices, window_rows, windows, whole_row
from gazeframe.session import durable, scratch_path

SHINGLE = 5
LEAST_PERCENT = 75
REGISTERS, BANDS, ROWS = 256, 64, 4
MANTISSA = 10
#: Members of a band group or family that one task holds at once, from each of two sides.
BLOCK = 512
_REST = 56  # bits of the hash below the bucket number
_EMPTY = np.uint16(0xFFFF)
_LAST_ID = (1 << 63) - 1
#: Texts that one task remembers while it leaves out repeated rows.
_SEEN = 1 << 16
#: For each register, its order of preference among the buckets it may borrow from.
_ORDER = np.argsort(np.argsort(np.random.default_rng(20_011).random((REGISTERS, REGISTERS)), axis=1), axis=1).astype(np.int16)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by (text, hash), and their text numbers."""
    h = words.hashes()
    at, row = window_rows(words, SHINGLE)
    value = windows(h, SHINGLE)[at]
    counts = words.counts
    for n in range(1, SHINGLE):  # fewer words: the whole sequence is the one shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            value = np.concatenate([value, mix(windows(h, n)[words.first[short]] + U(n))])
            row = np.concatenate([row, short])
    order = np.argsort(value)
    order = order[np.argsort(row[order], kind="stable")]
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def registers(value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """HyperMinHash registers (rows x 256, 16 bits); a text without shingles has only empty ones."""
    top = np.full((rows, REGISTERS), ~U(0))
    h = mix(value + U(0x5851F42D4C957F2D))
    slot = row * REGISTERS + (h >> U(_REST)).astype(np.int64)
    np.minimum.at(top.reshape(-1), slot, h & U((1 << _REST) - 1))
    filled = top != ~U(0)
    rest = np.where(filled, top, U(1)) | U(0)
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    bits = np.clip(bits, 1, _REST)
    zeros = _REST - bits
    normal = (rest << zeros.astype(np.uint64)) >> U(_REST - 1 - MANTISSA)
    packed = (np.minimum(zeros, 62) << MANTISSA).astype(np.uint64) | (normal & U((1 << MANTISSA) - 1))
    packed = np.where(filled, packed.astype(np.uint16), _EMPTY)
    for i in np.flatnonzero(~filled.all(axis=1) & filled.any(axis=1)):
        own = np.flatnonzero(filled[i])
        gaps = np.flatnonzero(~filled[i])
        packed[i, gaps] = packed[i, own[np.argmin(_ORDER[np.ix_(gaps, own)], axis=1)]]
    return packed


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree although the smallest hashes differ."""
    level = np.arange(1, 40)[:, None]
    hit = lambda size: (1 - 0.5**level) ** (size / REGISTERS) - (1 - 0.5 ** (level - 1)) ** (size / REGISTERS)
    return (hit(n) * hit(m)).sum(axis=0) / (1 << MANTISSA)


def plausible(same: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the corrected estimate leaves room for the least similarity. ``same``: equal registers."""
    collide = chance(np.maximum(n, 1), np.maximum(m, 1))
    estimate = (same / REGISTERS - collide) / (1 - collide)
    least = LEAST_PERCENT / 100
    spread = np.sqrt(least * (1 - least) / np.minimum(REGISTERS, np.maximum(n, m)))
    sizes = 100 * np.minimum(n, m) >= LEAST_PERCENT * np.maximum(n, m)
    return sizes & (estimate >= least - 6 * spread)


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    at = np.arange(len(rows) + 1, dtype=np.int32) * (flat.shape[1] if len(rows) else 0)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(flat.tobytes())])


def _unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


_SKETCH = "doc_id bigint, tag binary, n_shingles bigint, high bigint, low bigint, registers binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        value, row = shingle_sets(words := Words(batch.column("text"), lower=True))
        n = np.bincount(row, minlength=words.rows)
        sums = []
        for salt in (0x1234567, 0x7654321):
            total = np.zeros(words.rows, np.uint64)
            np.add.at(total, row, mix(value ^ U(salt)))
            sums.append(total.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.array(n, pa.int64()), *map(pa.array, sums), _binary(registers(value, row, words.rows))],
            names=["doc_id", "tag", "n_shingles", "high", "low", "registers"],
        )


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves out most rows that repeat id and text within a task, so that a frequent row does not fill one later."""
    seen: set = set()
    for batch in batches:
        keep = []
        for key in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))
        if len(seen) > _SEEN:
            seen.clear()


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            h = _unpack(part.column("registers")).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = mix(np.arange(BANDS, dtype=np.uint64))[None, :] * np.ones((len(h), 1), np.uint64)
            for i in range(ROWS):
                key = mix(key + h[:, :, i] * U(0x9E3779B97F4A7C15) + U(i))
            rep = np.repeat(np.asarray(part.column("rep")), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1).view(np.int64)), pa.array(rep)], names=["band", "rep"]
            )


def _sides(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two blocks that meet in a group; the same ones if a block meets itself."""
    own, low = np.asarray(group.column("own")), group.column("i")[0].as_py()
    if low == group.column("j")[0].as_py():
        rows = np.arange(group.num_rows)
        return rows, rows, True
    return np.flatnonzero(own == low), np.flatnonzero(own != low), False


def _plausible_pairs(group: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of one block, the plausible rows of other components in the other, with equal registers."""
    label, n = np.asarray(group.column("label")), np.asarray(group.column("n"))
    if (label == label[0]).all():
        return
    regs = _unpack(group.column("registers"))
    left, right, inner = _sides(group)
    for x in left.tolist():
        other = right[label[right] != label[x]]
        if inner:
            other = other[other > x]
        if len(other):
            same = (regs[other] == regs[x]).sum(axis=1)
            ok = plausible(same, np.full(len(other), n[x]), n[other])
            if ok.any():
                yield x, other[ok], same[ok]


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (list(x) for x in zip(*pairs, strict=True)) if pairs else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components that plausible pairs of one band group span, as stars of their labels."""
    for group in groups(batches, ["band", "i", "j"]):
        label = np.asarray(group.column("label"))
        ends = [(np.full(len(o), label[x]), label[o]) for x, o, _ in _plausible_pairs(group)]
        if ends:
            nodes, least = contract(*(np.concatenate(side) for side in zip(*ends, strict=True)))
            keep = nodes != least
            yield _pairs_batch(list(zip(nodes[keep].tolist(), least[keep].tolist(), strict=True)))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components of one family across two blocks, likeliest pairs first."""
    for group in groups(batches, ["family", "i", "j"]):
        rep, label = group.column("rep").to_pylist(), group.column("label").to_pylist()
        found = [(np.full(len(o), x), o, same) for x, o, same in _plausible_pairs(group)]
        if not found:
            continue
        x, y, same = (np.concatenate(side) for side in zip(*found, strict=True))
        order = np.argsort(-same, kind="stable")
        texts, sets = group.column("text"), {}
        parent = {k: k for k in label}

        def root(k, parent=parent):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        links = []
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            one, other = root(label[i]), root(label[j])
            if one == other:
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingle_sets(Words(texts.slice(k, 1), lower=True))[0]
            if similar(sets[i], sets[j]):
                parent[one] = other
                links.append((rep[i], rep[j]))
        if links:
            yield _pairs_batch(links)


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets reach the least similarity."""
    if not len(one) or not len(other):
        return False
    at = np.minimum(np.searchsorted(one, other), len(one) - 1)
    both = int((one[at] == other).sum())
    return 100 * both >= LEAST_PERCENT * (len(one) + len(other) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Estimate, then exact similarity of the full shingle sets. Keeps the linked pairs."""
    last, held = None, None
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        a_texts, b_texts = batch.column("ta"), batch.column("tb")
        a_ids = batch.column("a").to_pylist()
        same = np.concatenate(
            [
                (_unpack(part.column("ra")) == _unpack(part.column("rb"))).sum(axis=1)
                for part in (batch.slice(lo, 2048) for lo in range(0, batch.num_rows, 2048))
            ]
            or [np.empty(0, np.int64)]
        )
        likely = plausible(same, np.asarray(batch.column("na")), np.asarray(batch.column("nb")))
        for i in np.flatnonzero(likely).tolist():
            if a_ids[i] != last or held is None:
                held = shingle_sets(Words(a_texts.slice(i, 1), lower=True))[0]
                last = a_ids[i]
            other = shingle_sets(Words(b_texts.slice(i, 1), lower=True))[0]
            keep[i] = similar(held, other)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda s: texts.select(
        F.col("rep").alias(s), F.col("text").alias(f"t{s}"), F.col("registers").alias(f"r{s}"), F.col("n").alias(f"n{s}")
    )
    met = pairs.join(side("b"), "b").join(side("a"), "a")
    return durable(met.select("a", "b", "ta", "tb", "ra", "rb", "na", "nb").mapInArrow(_confirm, "a bigint, b bigint"))


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    joined = components(links, "a", "b").withColumnRenamed("node", "rep")
    return members.join(joined, "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("label"))


def _dealt(rows: DataFrame, keys: list[str], step, schema: str) -> DataFrame:
    """Run ``step`` over each group of ``keys``, one group at a time in a task's sorted stream."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(step, schema)


def _meeting(own: Column, others: Column) -> list[Column]:
    """Block numbers of a row, once for each block that its own one meets."""
    other = F.explode(others)
    return [own.alias("own"), other.alias("other")]


def _family_edges(now: DataFrame, regs: DataFrame) -> DataFrame:
    """Labels that a plausible pair of one band group spans."""
    mixed = now.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
    mixed = mixed.where("lo < hi").select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    met = now.join(mixed, "band").select("band", "rep", "label", *_meeting(own, F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "label")
    return _dealt(met.join(regs, "rep"), ["band", "i", "j"], _families, "a bigint, b bigint")


def _family_links(now: DataFrame, families: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact links between the components of each family.

    The largest component's members never meet each other: they are known to be joined.
    """
    rows = now.select("rep", "label").distinct().join(families.select(F.col("node").alias("label"), F.col("component").alias("family")), "label")
    sizes = rows.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("family").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")
    )
    rest, main = F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK), F.ceil(F.col("n_main") / BLOCK)
    sizes = sizes.select("family", "main", rest.cast("int").alias("rest"), main.cast("int").alias("most"))
    in_main, place = F.col("label") == F.col("main"), F.xxhash64("rep")
    own = F.when(in_main, F.col("rest") + F.pmod(place, F.col("most"))).otherwise(F.pmod(place, F.col("rest"))).cast("int")
    last = F.when(in_main, F.col("rest") - 1).otherwise(F.col("rest") + F.col("most") - 1)
    met = rows.join(sizes, "family").select("family", "rep", "label", *_meeting(own, F.sequence(F.lit(0), last)))
    met = met.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "label")
    return _dealt(met.join(texts, "rep"), ["family", "i", "j"], _settle, "a bigint, b bigint")


def _texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` (a null one is the largest number), ``tag`` (128 bits of the text) and ``text`` as bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST_ID)).alias("doc_id"),
        F.unhex(F.md5(text.cast("binary"))).alias("tag"),
        text.cast("binary").alias("text"),
    )


def _verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, n_shingles, component, kept`` for every row; a null id is the largest number here."""
    spark = docs.sparkSession
    source = _texts_of(docs)
    path = scratch_path(spark, "near-sketches")
    source.mapInArrow(_sketch, _SKETCH).write.parquet(path)
    sketches = spark.read.parquet(path)
    per_set = ["high", "low", "n_shingles"]
    rep_path = scratch_path(spark, "near-classes")
    sketches.where("n_shingles > 0").groupBy(*per_set).agg(
        F.min(F.struct("doc_id", "tag")).alias("first"), F.first("registers").alias("registers")
    ).select(
        F.monotonically_increasing_id().alias("rep"), *per_set, "first.doc_id", "first.tag", "registers"
    ).write.parquet(rep_path)
    reps = spark.read.parquet(rep_path)

    bands = reps.select("rep", "registers").mapInArrow(_bands, "band bigint, rep bigint")
    shared = bands.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last")
    member_path = scratch_path(spark, "near-members")
    bands.join(shared.select("band", "hub"), "band").write.parquet(member_path)
    members = spark.read.parquet(member_path)

    # Texts and registers of all that share a band with another: what comparisons read from now on.
    text_path = scratch_path(spark, "near-texts")
    active = members.select("rep").distinct()
    regs = reps.select("rep", "doc_id", "tag", "registers", F.col("n_shingles").alias("n")).join(active, "rep", "left_semi")
    bodies = source.mapInArrow(_once, "doc_id bigint, tag binary, text binary")
    regs.join(bodies, ["doc_id", "tag"]).distinct().drop("doc_id", "tag").write.parquet(text_path)
    texts = spark.read.parquet(text_path)
    regs = texts.select("rep", "registers", "n")

    # Texts of one id are one node: the classes of every repeated id are linked.
    numbered = sketches.where(F.col("doc_id") != _LAST_ID).select("doc_id", *per_set)
    repeated = numbered.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")
    twins = durable(numbered.join(repeated, "doc_id", "left_semi").join(reps.select(*per_set, "rep"), per_set).select("doc_id", "rep"))
    hubs = twins.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last"))
    one_id = twins.join(hubs.where("a < last").select("doc_id", "a"), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))

    tried = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = durable(_linked(tried, texts).union(one_id))
    labels = durable(_labelled(members, links))
    families = components(_family_edges(labels, regs), "a", "b")
    final = components(links.union(_family_links(labels, families, texts)), "a", "b")

    # A component is named by the smallest id in it; among texts without id, by the smallest tag.
    joined = reps.select("rep", "doc_id", "tag").join(final.withColumnRenamed("node", "rep"), "rep")
    heads = joined.groupBy("component").agg(F.min(F.struct("doc_id", "tag")).alias("head"))
    headed = final.join(heads, "component").select(F.col("node").alias("rep"), "head")
    classes = reps.join(headed, "rep", "left").select(
        *per_set, "rep", F.coalesce("head", F.struct("doc_id", "tag")).alias("head")
    )
    rows = sketches.select("doc_id", "tag", *per_set)
    # A text without words follows the other texts of its id.
    bare = (F.col("n_shingles") == 0) & (F.col("doc_id") != _LAST_ID)
    of_id = hubs.select("doc_id", F.col("a").alias("rep")).join(classes.select("rep", "head"), "rep").drop("rep")
    out = rows.where(~bare).join(classes.drop("rep"), per_set, "left").select("doc_id", "tag", "n_shingles", "head")
    out = out.union(rows.where(bare).join(of_id, "doc_id", "left").select("doc_id", "tag", "n_shingles", "head"))
    component = F.coalesce("head.doc_id", "doc_id")
    chosen = (F.col("doc_id") != _LAST_ID) | (F.col("tag") == F.coalesce("head.tag", "tag"))
    return out.select("doc_id", "tag", "n_shingles", component.alias("component"), ((F.col("doc_id") == component) & chosen).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id``, ``text``).

    Null and wordless texts are empty sets and stand alone, unless their id has other texts. Rows with the
    same ``doc_id`` are one node of the graph, so their components are one. Rows with a null ``doc_id`` are
    nodes by their text; the null takes part as the largest possible number and comes back as null. If a
    component has no other id, one of its texts is kept. Other
    columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    null = F.lit(_LAST_ID)
    return _verdicts(docs).select(
        F.nullif("doc_id", null).alias("doc_id"), "n_shingles", F.nullif("component", null).alias("component_id"), "kept"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, one of each component, all columns.

    Rows that repeat both ``doc_id`` and text collapse into one; other rows with a kept ``doc_id`` stay.
    """
    kept = _verdicts(docs).where("kept").select(F.col("doc_id").alias("id"), "tag").distinct()
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST_ID)).alias("id"),
        F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("tag"),
        F.col("text").alias("body"),
        whole_row(docs),
    )
    same = Window.partitionBy("id", "body").orderBy("id")
    once = rows.join(kept, ["id", "tag"], "left_semi").withColumn("n", F.row_number().over(same)).where("n = 1")
    return once.select("row.*")
