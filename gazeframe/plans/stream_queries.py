"""Streaming forms, run over everything that has arrived and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazeframe.plans import stand_ins as V
from gazeframe.plans.frame_queries import _MOTION, _STATUS, TRACKING
from gazeframe.plans.pixel_queries import COMPONENTS, MEASURED
from gazeframe.plans.registry import query
from gazeframe.session import scratch_path
from gazeframe.streaming import live

TURNS = 5


@query(
    MEASURED + " segmentation_status:s",
    f"SELECT *, {_STATUS} AS segmentation_status FROM measured",
    COMPONENTS,
)
def stream_frame_qc(spark, sf_dir):
    arriving = V.maps_of(live.table_stream(spark, sf_dir, "embeddings"))
    return live.run_available(live.stream_frame_qc(arriving, 0.7), "frame-qc")


@query(_MOTION, "SELECT * FROM tracked", TRACKING)
def stream_kinematics(spark, sf_dir):
    # The events arrive in five turns, rows dealt to their files in no order; a row without recording closes the stream.
    events = V.table(spark, sf_dir, "events")
    days = events.agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] or 0
    path = scratch_path(spark, "arriving")
    dealt = V.measurements_of(events).repartition(TURNS * spark.sparkContext.defaultParallelism, "image_name")
    dealt.sortWithinPartitions(F.xxhash64("image_name")).write.parquet(f"{path}/frames")
    written = spark.read.parquet(f"{path}/frames")
    schema, files = written.schema, len(written.inputFiles())
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in ("ts", "acquisition_fps")]
    end = F.max("ts") + F.expr(f"INTERVAL {4000 + days} DAYS")
    close = events.agg(end.alias("ts")).select(*nothing, "ts", F.lit(1.0).alias("acquisition_fps"))
    close.select(schema.names).write.parquet(f"{path}/z")
    arriving = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", -(-files // TURNS)).parquet(path)
    return live.run_available(live.stream_kinematics(arriving, delay=f"{1000 + days} days"), "kinematics")
