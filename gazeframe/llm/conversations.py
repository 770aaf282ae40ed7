"""A prefix trie of conversations, built from blocks of turns.

A turn is two 64-bit hashes of its role and text; the digest of a prefix is the sum of the hashes of its
turns, each keyed with its place, modulo powers of two. So digests of all prefixes are running sums, which are taken per
block of ``BLOCK`` turns and carried over blocks in two levels. Conversations are grouped by the digests at the ends of their blocks first.
Where all conversations behind one block start share the next block, its turns are nodes as they are; only
where blocks differ are the digests at single turns compared.

Sums over subtrees need no walk: a node belongs to its smallest member, whose nodes are an end of its own path. Each
owner adds what it owns, summed from the end of its path, to all prefixes of that path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.operators.ordering import by_index, ordinal_within
from gazeframe.session import scratch_path

BLOCK = 8
#: Blocks of one conversation that one window runs over.
BLOCKS_AT_ONCE = 4096
#: Neighbouring ids that are written as one piece of a list of ids.
IDS_AT_ONCE = 1 << 16
#: The rebuilding rule: families of ids, and the modulus of the head's length.
FAMILY, HEADS = 5, 9

_LOW = (1 << 32) - 1
_LANES = ("l0", "l1", "l2", "l3")
_KEY = ["depth", "p", "q"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, h, g, n_bytes`` of every turn with an id."""
    c = conversations
    role, text = (F.coalesce(c[x].cast("string"), F.lit("")) for x in ("role", "text"))
    return c.select(
        c["conv_id"].cast("bigint").alias("conv_id"), c["turn"].alias("turn"),
        F.xxhash64(role, text).alias("h"), F.xxhash64(F.lit(1), role, text).alias("g"), F.octet_length(text).cast("bigint").alias("n_bytes"),
    ).where(F.col("conv_id").isNotNull())


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place, h, g, n_bytes`` with the place of each turn in its conversation, from 1."""
    order = [F.asc_nulls_first("turn"), F.asc("h"), F.asc("g")]
    segment = F.coalesce(by_index(F.col("turn")), F.lit(-(1 << 62)))
    ranked = ordinal_within(turns, ["conv_id"], order, segment, "ordinal")
    return ranked.select("conv_id", (F.col("ordinal") + 1).alias("place"), "h", "g", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the head of its family's first: ``(conv_id, n_turns)`` and ``(conv_id, place, h, g, n_bytes)``.

    ``turns`` come from :func:`numbered_turns`.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("head")
    own = sizes.select("conv_id", "n", base, head)
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("head", F.coalesce("n_base", F.lit(0)))
    info = own.join(first, "base", "left").select("conv_id", "head", taken.alias("taken"), F.greatest(F.col("n") - F.col("head"), F.lit(0)).alias("rest"))
    later = turns.join(info, "conv_id").where(F.col("place") > F.col("head"))
    later = later.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "h", "g", "n_bytes")
    # Heads are at most HEADS - 1 turns, copied to the members of the family that exist.
    near = F.array(*[F.try_add(F.col("conv_id"), F.lit(k)) for k in range(1 - FAMILY, FAMILY)])
    heads = turns.where((F.col("place") < HEADS) & (F.col("conv_id") % FAMILY == 0))
    heads = heads.withColumn("member", F.explode(near)).where(F.col("member") - F.col("member") % FAMILY == F.col("conv_id"))
    known = info.select(F.col("conv_id").alias("member"), "taken")
    heads = heads.join(known, "member").where(F.col("place") <= F.col("taken"))
    heads = heads.select(F.col("member").alias("conv_id"), "place", "h", "g", "n_bytes")
    return info.select("conv_id", (F.col("taken") + F.col("rest")).alias("n_turns")), later.unionByName(heads)


def _packed(low: Column, high: Column) -> Column:
    mask = F.lit(_LOW)
    return F.shiftleft(high.bitwiseAND(mask), 32).bitwiseOR(low.bitwiseAND(mask))


def _before(rows: DataFrame, columns: list[str], descending: bool = False) -> DataFrame:
    """Add ``b_<column>``: its sum over all earlier (later) blocks of the conversation, in two levels."""
    segment = F.floor(F.col("block") / BLOCKS_AT_ONCE)
    rows = rows.withColumn("_seg", segment)
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    local = Window.partitionBy("conv_id", "_seg").orderBy(turn("block")).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv_id").orderBy(turn("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "_seg").agg(*[F.sum(c).alias(c) for c in columns])
    carried = totals.select("conv_id", "_seg", *[F.sum(c).over(across).alias(f"_c_{c}") for c in columns]).where(f"_c_{columns[0]} IS NOT NULL")
    summed = rows.withColumns({f"_b_{c}": F.coalesce(F.sum(c).over(local), F.lit(0)) for c in columns})
    joined = summed.join(carried, ["conv_id", "_seg"], "left")
    sums = {f"b_{c}": F.col(f"_b_{c}") + F.coalesce(F.col(f"_c_{c}"), F.lit(0)) for c in columns}
    return joined.withColumns(sums).drop("_seg", *[f"_{k}_{c}" for k in "bc" for c in columns])


def blocks_of(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, block, p0, q0, keys``: the digest before each block, and depth, digest and bytes of its turns."""
    placed = [F.xxhash64("place", "h"), F.xxhash64("place", F.lit(1), "g")]
    lane = [x.bitwiseAND(F.lit(_LOW)) if low else F.shiftrightunsigned(x, 32) for x in placed for low in (True, False)]
    rows = turns.select("conv_id", F.floor((F.col("place") - 1) / block).alias("block"), "place", "n_bytes", *[x.alias(n) for x, n in zip(lane, _LANES, strict=True)])
    per = rows.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("place", *_LANES, "n_bytes"))).alias("t"), *[F.sum(n).alias(n) for n in _LANES]
    )
    per = _before(per, list(_LANES))
    zero = F.lit(0).cast("bigint")
    upto = lambda i, n: F.col(f"b_{n}") + F.aggregate(F.slice("t", 1, i + 1), zero, lambda a, x: a + x[n])
    keys = F.transform(
        "t",
        lambda x, i: F.struct(
            x["place"].alias("depth"), _packed(upto(i, "l0"), upto(i, "l1")).alias("p"), _packed(upto(i, "l2"), upto(i, "l3")).alias("q"), x["n_bytes"].alias("n_bytes")
        ),
    )
    return per.select("conv_id", "block", _packed(F.col("b_l0"), F.col("b_l1")).alias("p0"), _packed(F.col("b_l2"), F.col("b_l3")).alias("q0"), keys.alias("keys"))


def nodes_of(blocks: DataFrame) -> DataFrame:
    """``depth, p, q, up, uq, n_bytes, n_convs, conv_id`` of every node below the root, with its parent's digest."""
    last = F.element_at("keys", -1)
    whole = blocks.groupBy("block", "p0", "q0", last["depth"].alias("end"), last["p"].alias("p"), last["q"].alias("q")).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.any_value("keys").alias("keys")
    )
    starts = whole.groupBy("block", "p0", "q0").agg((F.count(F.lit(1)) > 1).alias("diverge"))
    marked = whole.join(starts, ["block", "p0", "q0"])
    above = F.concat(F.array(F.struct(F.col("p0").alias("p"), F.col("q0").alias("q"))), F.transform("keys", lambda x: F.struct(x["p"].alias("p"), x["q"].alias("q"))))
    turns = marked.select("diverge", "n_convs", "conv_id", F.explode(F.arrays_zip("keys", above.alias("above"))).alias("z")).where("z.keys IS NOT NULL")
    turns = turns.select("diverge", "z.keys.*", F.col("z.above.p").alias("up"), F.col("z.above.q").alias("uq"), "n_convs", "conv_id")
    columns = [*_KEY, "up", "uq", "n_bytes", "n_convs", "conv_id"]
    refined = turns.where("diverge").groupBy(*_KEY, "up", "uq", "n_bytes").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return turns.where("NOT diverge").select(columns).union(refined.select(columns))


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces in order, joined by commas; one hash is held at a time."""
    key, sha = None, None
    done: list[tuple] = []

    def flush():
        columns = list(zip(*done, strict=True)) if done else [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*_KEY, "ends_sha256"])

    for batch in batches:
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
            if now != key:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = now, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield flush()
        done.clear()
    if key is not None:
        done.append((*key, sha.hexdigest()))
        yield flush()


def ends_of(lengths: DataFrame, blocks: DataFrame) -> DataFrame:
    """``depth, p, q, ends_sha256`` of every node where conversations end.

    Ids are written in pieces of neighbouring ones wherever they are; only the hash of a node's list, which goes from its first byte to its
    last, is one task's work, piece by piece.
    """
    last = F.element_at("keys", -1)
    tops = blocks.select("conv_id", last["depth"].alias("depth"), last["p"].alias("p"), last["q"].alias("q"))
    ended = lengths.join(tops, (tops["conv_id"] == lengths["conv_id"]) & (F.col("depth") == F.col("n_turns")), "left").select(
        lengths["conv_id"], F.col("n_turns").alias("depth"), F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q")
    )
    piece = F.floor(F.col("conv_id") / IDS_AT_ONCE).alias("piece")
    written = ended.groupBy(*_KEY, piece).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    dealt = written.repartition(*_KEY).sortWithinPartitions(*_KEY, "piece").select(*_KEY, "ids")
    return dealt.mapInArrow(_list_digests, "depth bigint, p bigint, q bigint, ends_sha256 string")


def subtree_sums(nodes: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``depth, p, q, n_leaves, saved_tokens`` over the subtree of every node, the root included.

    ``nodes`` have ``leaf`` besides the columns of :func:`nodes_of`.
    """
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    owned = nodes.groupBy("conv_id", F.floor((F.col("depth") - 1) / block).alias("block")).agg(
        F.collect_list(F.struct("depth", saved.alias("saved"), F.col("leaf").cast("bigint").alias("leaf"))).alias("own"),
        F.sum(saved).alias("saved"), F.sum(F.col("leaf").cast("bigint")).alias("leaf"),
    )
    owners = nodes.select("conv_id").distinct()
    path = blocks.join(owners, "conv_id", "left_semi").join(owned, ["conv_id", "block"], "left").fillna(0, ["saved", "leaf"])
    path = _before(path, ["saved", "leaf"], descending=True)
    below = lambda x, n: F.col(f"b_{n}") + F.aggregate(
        F.coalesce("own", F.array().cast("array<struct<depth:bigint,saved:bigint,leaf:bigint>>")), F.lit(0).cast("bigint"),
        lambda a, o: a + F.when(o["depth"] >= x["depth"], o[n]).otherwise(0),
    )
    each = path.select(
        F.explode(F.transform("keys", lambda x: F.struct(*[x[c].alias(c) for c in _KEY], below(x, "saved").alias("saved"), below(x, "leaf").alias("leaf")))).alias("z")
    ).select("z.*")
    # What all paths add to their first turn, the root sums once more.
    sums = each.groupBy(*_KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    top = nodes.agg(F.coalesce(F.sum(F.col("leaf").cast("bigint")), F.lit(0)), F.coalesce(F.sum(saved), F.lit(0)))
    zero = [F.lit(0).cast("bigint").alias(c) for c in _KEY]
    return sums.union(top.select(*zero, *top.columns))


@dataclass
class Trie:
    """``nodes``: one row per node. ``prefixes``: ``conv_id, depth, node`` digests ``p, q`` of every conversation's turns."""

    nodes: DataFrame
    prefixes: DataFrame


def prefix_trie(lengths: DataFrame, turns: DataFrame, block: int = BLOCK) -> Trie:
    """The trie of conversations ``(conv_id, n_turns)`` with turns ``(conv_id, place, h, g, n_bytes)``.

    ``nodes`` has ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    The root has depth 0 and every conversation, also one without turns; without conversations there is no root and no row.
    """
    spark = turns.sparkSession
    kept = {}
    for name, df in (("lengths", lengths), ("blocks", blocks_of(turns, block))):
        path = scratch_path(spark, f"trie-{name}")
        df.write.parquet(path)
        kept[name] = spark.read.parquet(path)
    lengths, blocks = kept["lengths"], kept["blocks"]
    path = scratch_path(spark, "trie-nodes")
    nodes_of(blocks).write.parquet(path)
    plain = spark.read.parquet(path)
    children = plain.groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("p"), F.col("uq").alias("q")).agg(F.count(F.lit(1)).alias("n_children"))
    inner = plain.join(children, _KEY, "left").withColumn("leaf", F.col("n_children").isNull())
    path = scratch_path(spark, "trie-inner")
    inner.write.parquet(path)
    inner = spark.read.parquet(path)
    zero = F.lit(0).cast("bigint")
    # The root has as many children as there are different first turns; they need no join to learn its two numbers.
    n_convs, least = lengths.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    first = inner.where("depth = 1")
    least = F.lit(least).cast("bigint")
    root = first.agg(F.count(F.lit(1)).alias("n_children")).where(F.lit(n_convs > 0)).select(
        *[zero.alias(c) for c in _KEY], F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(n_convs).cast("bigint").alias("n_convs"), least.alias("conv_id"), "n_children"
    )
    high = first.withColumn("parent_conv_id", least)
    parents = inner.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up"), F.col("q").alias("uq"), F.col("conv_id").alias("parent_conv_id"))
    deep = inner.where("depth > 1").join(parents, ["depth", "up", "uq"])
    columns = [*_KEY, "parent_conv_id", "n_convs", "conv_id", "n_children"]
    every = root.select(columns).union(high.select(columns)).union(deep.select(columns))
    sums, ends = subtree_sums(inner, blocks, block), ends_of(lengths, blocks)
    nodes = every.join(sums, _KEY, "left").join(ends, _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        # A trie of nothing but its root has one childless node.
        F.greatest("n_leaves", F.lit(1)).cast("bigint").alias("n_leaves"), F.col("saved_tokens").cast("bigint").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    prefixes = blocks.select("conv_id", F.explode("keys").alias("z")).select("conv_id", "z.depth", "z.p", "z.q")
    return Trie(nodes, prefixes)


def family_trie(conversations: DataFrame, block: int = BLOCK) -> Trie:
    """The trie of ``conversations`` (``conv_id, turn, role, text``) after each took the head of its family's first.

    A null role or text is empty; a null turn comes first; turns of one number are ordered by their hashes, so
    the answer does not depend on how rows arrive. Repeated rows are turns of their own. Rows without ``conv_id`` belong to no
    conversation and have no part in the answer. Other columns are ignored; an empty table gives an empty result.
    """
    spark = conversations.sparkSession
    path = scratch_path(spark, "turns")
    numbered_turns(hashed_turns(conversations)).write.parquet(path)
    lengths, turns = rebuilt(spark.read.parquet(path))
    return prefix_trie(lengths, turns, block)
