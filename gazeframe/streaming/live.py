"""The same checks on frames as they arrive."""

from __future__ import annotations

import warnings
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gazeframe.operators.motion import (
    BUCKET,
    INDEX,
    KEY,
    frame_timestamps,
    published_centers,
)
from gazeframe.operators.results import tracking_status
from gazeframe.operators.segmentation import measure_frames
from gazeframe.session import scratch_path

MOTION = (
    "recording_id bigint, source_frame_index bigint, image_name string, timestamp_seconds double, "
    "center_x_pixels double, center_y_pixels double, displacement_x_pixels double, "
    "displacement_y_pixels double, velocity_x_pixels_per_second double, "
    "velocity_y_pixels_per_second double, speed_pixels_per_second double"
)
#: State holds frames by the block, as Arrow streams: a call and a record for each frame would cost more than all else.
_HELD = "frames binary"
BLOCK = 10_000
_FRAME = "is_home event_ms source_frame_index extraction_index image_name segmentation_valid timestamp_seconds center_x_pixels center_y_pixels".split()
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_frame_qc(frames: DataFrame, threshold: float, mask: str | None = None) -> DataFrame:
    """Component evidence, quality codes and status per arriving frame; keeps no state."""
    return tracking_status(measure_frames(frames, threshold, mask), "segmentation_status")


class Held(NamedTuple):
    """A frame in state: whether its motion is out, event time, order, and what motion needs."""

    done: bool
    home: bool
    ms: int
    index: int
    extraction: int
    name: str
    valid: bool
    t: float | None
    x: float | None
    y: float | None


_HELD_SCHEMA = pa.schema(
    [("done", pa.bool_()), ("home", pa.bool_()), ("ms", pa.int64()), ("index", pa.int64()), ("extraction", pa.int64())]
    + [("name", pa.string()), ("valid", pa.bool_()), ("t", pa.float64()), ("x", pa.float64()), ("y", pa.float64())]
)
_PLACE = [(c, "ascending") for c in ("index", "extraction", "name")]


def _table(columns: list) -> pa.Table:
    """Columns of frames, in the order of :class:`Held`; a number that is NaN is missing."""
    return pa.table([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, _HELD_SCHEMA, strict=True)], _HELD_SCHEMA)


def _blocks(held: pa.Table) -> list[tuple[bytes]]:
    out = []
    for i in range(0, held.num_rows, BLOCK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD_SCHEMA) as stream:
            stream.write_table(held.slice(i, BLOCK))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def settled(held: pa.Table, now: int, eager: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
    """Frames whose motion is final at watermark ``now``; elapsed time and step of each from the frame right before, NaN where
    motion between the two is not defined; and the frames that state keeps.

    A frame is final when the watermark has passed it, as nothing up to it can arrive any more, or with ``eager`` also
    when its predecessor is there. State keeps all other frames, the last frame and those that are right before one
    still held.
    """
    held = held.sort_by(_PLACE)
    done, ms, index, valid, *spot = (held[c].to_numpy() for c in ("done", "ms", "index", "valid", "t", "x", "y"))
    follows = np.diff(index, prepend=index[:1]) == 1
    ready = ms <= now
    if eager:
        ready |= follows | (index == 0)
    step = np.vstack([np.diff(v, prepend=np.nan) for v in spot])
    linked = follows & valid & np.roll(valid, 1) & (step[0] > 0) & ~np.isnan(step).any(axis=0)
    out = ~done & ready
    now_done = done | ready
    front = index[now_done].max(initial=0)
    keep = ~now_done | (index >= front) | np.isin(index, index[~now_done] - 1)
    kept = held.set_column(0, _HELD_SCHEMA.field(0), pa.array(now_done)).filter(pa.array(keep))
    return held.filter(pa.array(out)), np.where(linked, step, np.nan)[:, out], kept


def settle(held: list[Held], now: int, eager: bool) -> tuple[list[tuple[Held, tuple | None]], list[Held]]:
    """:func:`settled` for a list of frames."""
    rows = lambda table: [Held(*r) for r in zip(*(c.to_pylist() for c in table.columns), strict=True)]
    out, step, kept = settled(_table(list(zip(*held, strict=True)) or [[]] * len(_HELD_SCHEMA)), now, eager)
    return [(r, None if np.isnan(m[0]) else tuple(m.tolist())) for r, m in zip(rows(out), step.T, strict=True)], rows(kept)


class _Motion(StatefulProcessor):
    """One bucket of frame numbers of a recording: frames wait in list state for what may still come before them."""

    def __init__(self, idle_ms: int, eager: bool):
        self.idle_ms, self.eager = idle_ms, eager

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)

    def handleInputRows(self, key, rows, timerValues):
        new = pa.concat_tables(_table([np.zeros(len(f), bool), *(f[c] for c in _FRAME)]) for f in rows)
        self.handle.registerTimer(pc.min(new["ms"]).as_py())
        if self.eager:
            yield self._released(key, pa.concat_tables([self._state(), new]), timerValues.getCurrentWatermarkInMs())
        else:
            self.held.appendList(_blocks(new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        held = self._state()
        if not held.num_rows:  # cleared by a timer before
            return
        released = self._released(key, held, now)
        if len(released):
            yield released
        idle = pc.max(held["ms"]).as_py() + self.idle_ms
        if idle <= now:
            self.held.clear()
        else:
            self.handle.registerTimer(idle)

    def _state(self) -> pa.Table:
        return pa.concat_tables([_HELD_SCHEMA.empty_table(), *(pa.ipc.open_stream(b).read_all() for (b,) in self.held.get())])

    def _released(self, key, held: pa.Table, now: int) -> pd.DataFrame:
        out, step, kept = settled(held, now, self.eager)
        if kept.num_rows:
            self.held.put(_blocks(kept))
        waiting = kept.filter(pc.and_(pc.invert(kept["done"]), pc.greater(kept["ms"], now)))
        if waiting.num_rows:
            self.handle.registerTimer(pc.min(waiting["ms"]).as_py())
        home = out["home"].to_numpy()
        own = out.filter(out["home"])
        dt, dx, dy = step[:, home]
        vx, vy = dx / dt, dy / dt
        return pd.DataFrame(
            {
                "recording_id": np.full(own.num_rows, key[0], np.int64),
                INDEX: own["index"].to_numpy(),
                "image_name": pd.Series(own["name"].to_pylist(), dtype=object),
                "timestamp_seconds": own["t"].to_numpy(),
                "center_x_pixels": own["x"].to_numpy(),
                "center_y_pixels": own["y"].to_numpy(),
                "displacement_x_pixels": dx,
                "displacement_y_pixels": dy,
                "velocity_x_pixels_per_second": vx,
                "velocity_y_pixels_per_second": vy,
                "speed_pixels_per_second": np.hypot(vx, vy),
            }
        )

    def close(self) -> None:
        pass


def stream_kinematics(
    frames: DataFrame,
    fps: float | str | None = None,
    event_time: str = "ts",
    delay: str = "10 minutes",
    idle_seconds: int = 3600,
    eager: bool = False,
) -> DataFrame:
    """Frame-to-frame motion of frames that arrive in any order within the watermark; equals the batch form.

    A frame waits in state until the watermark passes its event time; then all frames up to it are there, if event
    times do not decrease along the frame order. With ``eager`` it leaves as soon as its predecessor is there, which is as right where
    no frame number repeats. Frames older than the watermark are dropped by Spark and counted: see :func:`late_rows`.

    State is kept per recording and bucket of frame numbers, the last frame of a bucket being
    repeated in the next one: a long recording spreads over many tasks, a task sees at most
    one bucket of a recording, and a bucket's state is cleared by a timer ``idle_seconds`` of event time after its newest frame.
    A row without ``recording_id`` is no frame: it only moves the watermark, so that a finished recording can be closed.
    State must be in RocksDB (``spark.sql.streaming.stateStore.providerClass``); :func:`run_available` sees to it.
    """
    if "extraction_index" not in frames.columns:
        frames = frames.withColumn("extraction_index", F.col(INDEX))
    index = F.col(INDEX)
    home = F.floor(index / BUCKET).cast("bigint")
    following = F.floor((index + 1) / BUCKET).cast("bigint")
    # An empty list and not a filter, which Spark would move below the watermark.
    places = F.when(F.col(KEY).isNotNull(), F.array_distinct(F.array(home, following))).otherwise(F.array().cast("array<bigint>"))
    timed = (
        published_centers(frame_timestamps(frames, fps))
        .withColumn("_event", F.col(event_time).cast("timestamp"))
        .withWatermark("_event", delay)
        .withColumn("event_ms", F.unix_millis("_event"))
        .withColumn("_bucket", F.explode(places))
        .withColumn("is_home", home == F.col("_bucket"))
        .withColumn("segmentation_valid", F.coalesce("segmentation_valid", F.lit(False)))
        .select(KEY, "_bucket", "_event", *_FRAME)
    )
    moved = timed.groupBy(KEY, "_bucket").transformWithStateInPandas(
        _Motion(idle_seconds * 1000, eager), outputStructType=MOTION, outputMode="Append", timeMode="EventTime"
    )
    motion = [c.split()[0] for c in MOTION.split(", ") if c.split()[1] == "double"]
    return moved.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in motion})


def late_rows(query) -> int:
    """Rows that a query dropped for being older than its watermark (a frame counts once per bucket it is in)."""
    return sum(
        int(operator.get("numRowsDroppedByWatermark", 0))
        for progress in query.recentProgress
        for operator in progress.get("stateOperators", [])
    )


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process everything that has arrived into a Parquet table and read that table.

    Dropped late rows are reported as a warning with their number.
    """
    spark = stream.sparkSession
    if not spark.conf.get(PROVIDER_KEY, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER_KEY, ROCKSDB)
    target = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", f"{target}-progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if late := late_rows(query):
        warnings.warn(f"{name}: {late} row(s) came behind the watermark and were left out.", stacklevel=2)
    return spark.read.schema(stream.schema).parquet(target)


def table_stream(spark, sf_dir: str, table: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table of a folder as a file stream; the table is one file or a folder of files.

    The path ends in a pattern that only the table matches: given a plain path, a stream takes folders alone.
    """
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{table}.parque[t]")
