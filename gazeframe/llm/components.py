"""Connected components of an edge list, in rounds that each contract what one task can hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.session import durable

#: Edges that one task contracts at once, about; its memory is bounded by this number.
EDGES_PER_TASK = 500_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node each is connected to, by hooking and jumping."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
        if (before == parent).all():
            return nodes, nodes[parent]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars with the same components; more than a task's share in several goes."""
    held, size = [], 0
    done = (np.empty(0, np.int64), np.empty(0, np.int64))

    def shrink():
        u = np.concatenate([done[0], *(np.asarray(b.column("u")) for b in held)])
        v = np.concatenate([done[1], *(np.asarray(b.column("v")) for b in held)])
        nodes, least = contract(u, v) if len(u) else (u, v)
        keep = nodes != least
        return nodes[keep], least[keep]

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= EDGES_PER_TASK:
            star = shrink()
            if len(star[0]) >= EDGES_PER_TASK:  # nothing left to gain here: pass it on
                yield pa.RecordBatch.from_arrays([pa.array(star[0]), pa.array(star[1])], names=["u", "v"])
                star = (np.empty(0, np.int64), np.empty(0, np.int64))
            done, held, size = star, [], 0
    star = shrink()
    yield pa.RecordBatch.from_arrays([pa.array(star[0]), pa.array(star[1])], names=["u", "v"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all nodes with an edge to another; a component is named by its smallest node.

    Every round first turns each task's edges into stars. If all edges fit into one task's share, that
    is the answer. Otherwise large-star and small-star steps (Kiveris et al., 2014) bring nodes of a
    component together across tasks, in a logarithmic number of rounds in practice, until a round changes nothing.
    The driver sees one count and one checksum per round; rounds are cut by reliable checkpoints.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = durable(now.mapInArrow(_stars, "u bigint, v bigint"))
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())
        if mark == seen:
            break
        if mark[0] <= EDGES_PER_TASK:
            now = durable(now.coalesce(1).mapInArrow(_stars, "u bigint, v bigint"))
            break
        seen = mark
        now = durable(_small(_large(now).where("u <> v").distinct()).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v"), F.col("v")).distinct()
    )
