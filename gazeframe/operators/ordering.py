"""Ordered work inside groups of any size.

A window over a whole recording would put it into one task. Instead each group is cut into
segments that follow its order; windows run inside segments, and what must cross a border
travels as one row per segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.session import durable

SEGMENT = 65536
_SEG = "_segment"


def by_index(index: Column, width: int = SEGMENT) -> Column:
    """Segment number of a numeric order key."""
    return F.floor(index / width).cast("bigint")


def by_range(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None):
    """Segments for order keys without a numeric measure, such as names.

    Spark samples the range borders, so they differ from run to run; the cut rows are made
    durable before they are read twice.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *keys, *order).withColumn(
        _SEG, F.spark_partition_id().cast("bigint")
    )
    return durable(cut)


def _segmented(df: DataFrame, segment: Column | None) -> DataFrame:
    return df if segment is None else df.withColumn(_SEG, segment)


def _join_segments(df: DataFrame, per_segment: DataFrame, keys: list[str]) -> DataFrame:
    names = [*keys, _SEG]
    renamed = per_segment.withColumnsRenamed({n: f"_r_{n}" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return df.join(renamed, condition, "left").drop(*[f"_r_{n}" for n in names])


def ordinal_within(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    segment: Column | None = None,
    name: str = "ordinal",
    whole: dict[str, Callable[[Column | str], Column]] | None = None,
) -> DataFrame:
    """Zero-based position in the order of the group, two-level.

    ``segment`` must not decrease along ``order``; without it the frame has to come from
    :func:`by_range`. ``whole`` names columns that are replaced by an aggregate of theirs over the whole group, such as
    a minimum, which may be taken of the segments' own: it travels with the positions, one row per segment.
    """
    df = _segmented(df, segment)
    whole = whole or {}
    counts = df.groupBy(*keys, _SEG).agg(F.count(F.lit(1)).alias("_n"), *[fn(c).alias(c) for c, fn in whole.items()])
    group = Window.partitionBy(*keys)
    before = group.orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, _SEG, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), *[fn(c).over(group).alias(c) for c, fn in whole.items()]
    )
    df = df.drop(*whole)
    local = Window.partitionBy(*keys, _SEG).orderBy(*order)
    ranked = df.withColumn("_local", F.row_number().over(local) - 1)
    return (
        _join_segments(ranked, offsets, keys)
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_local", "_offset", _SEG)
    )


def running_max(
    df: DataFrame, keys: list[str], order: list[Column | str], value: Column, segment: Column, name: str
) -> DataFrame:
    """Greatest ``value`` among all earlier rows of the group (NULL for the first)."""
    df = _segmented(df, segment).withColumn("_v", value)
    tops = df.groupBy(*keys, _SEG).agg(F.max("_v").alias("_top"))
    before = Window.partitionBy(*keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, _SEG, F.max("_top").over(before).alias("_carried"))
    local = (
        Window.partitionBy(*keys, _SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = df.withColumn("_seen", F.max("_v").over(local))
    return (
        _join_segments(seen, carried, keys)
        .withColumn(name, F.greatest("_seen", "_carried"))
        .drop("_seen", "_carried", "_v", _SEG)
    )


def neighbour_values(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    segment: Column,
    previous: str,
    following: str,
) -> DataFrame:
    """``value`` of the row before and after in the group's order."""
    df = _segmented(df, segment).withColumn("_v", value)
    position = F.struct(*order)
    # Wrapped in a struct, so that a NULL value at the edge is not skipped.
    held = F.struct(F.col("_v").alias("v"))
    edges = df.groupBy(*keys, _SEG).agg(
        F.min_by(held, position).alias("_first"), F.max_by(held, position).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy(_SEG)
    edges = edges.select(
        *keys,
        _SEG,
        F.lag("_last").over(across)["v"].alias("_in"),
        F.lead("_first").over(across)["v"].alias("_out"),
    )
    local = Window.partitionBy(*keys, _SEG).orderBy(*order)
    # An edge row has no local neighbour; a struct tells that apart from a NULL neighbour.
    near = df.withColumn("_prev", F.lag(held).over(local)).withColumn(
        "_next", F.lead(held).over(local)
    )
    joined = _join_segments(near, edges, keys)
    pick = lambda near_, far: F.when(F.col(near_).isNull(), F.col(far)).otherwise(F.col(f"{near_}.v"))
    return (
        joined.withColumn(previous, pick("_prev", "_in"))
        .withColumn(following, pick("_next", "_out"))
        .drop("_prev", "_next", "_in", "_out", "_v", _SEG)
    )
