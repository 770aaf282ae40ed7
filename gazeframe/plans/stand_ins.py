"""Eye-camera shaped views over the generic test tables.

The tables hold no eye data, so operators are exercised on these derivations. They keep
every row, use integer and exact double arithmetic only, and give recording 0 a third of all
frames. Each view has a DataFrame and a portable SQL form.
"""

from __future__ import annotations

import struct
import zlib

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.functions.columns import once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- measured frames, from events -------------------------------------------------------

MEASUREMENTS_SQL = """
measurements AS (
SELECT recording_id, source_frame_index, extraction_index,
       concat('rec', recording_id, '_', printf('%05d', source_frame_index + 1), '.png') AS image_name,
       fps AS acquisition_fps, segmentation_valid, quality_reason, ts,
       CASE WHEN quality_reason = 'empty_mask' THEN NULL ELSE user_id + value / 8 END AS raw_center_x_pixels,
       CASE WHEN quality_reason = 'empty_mask' THEN NULL ELSE value / 4 END AS raw_center_y_pixels,
       CASE WHEN quality_reason = 'empty_mask' THEN 0 ELSE area END AS selected_component_area,
       area / 8 AS estimated_pupil_diameter, area / 4 AS pupil_diameter_input_pixels
FROM (SELECT *, n AS extraction_index, n + n // 17 AS source_frame_index,
             CASE recording_id % 3 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 5.0::DOUBLE ELSE 97.0::DOUBLE END AS fps,
             event_type <> 'error' AS segmentation_valid,
             CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'low_component_confidence'
                  WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'low_component_circularity'
                  WHEN event_type = 'error' THEN 'empty_mask'
                  WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'low_component_dominance'
                  ELSE '' END AS quality_reason,
             100 + user_id % 40 + CASE WHEN value > 120 THEN 250 WHEN value < 4 THEN -80 ELSE 0 END AS area
      FROM (SELECT *, CASE WHEN (event_id // 1000) % 3 = 0 THEN 0 ELSE event_id // 1000 END AS recording_id,
                   CASE WHEN (event_id // 1000) % 3 = 0 THEN (event_id // 3000) * 1000 ELSE 0 END
                     + event_id % 1000 AS n FROM events) a) b)"""


def measurements_of(events: DataFrame) -> DataFrame:
    event, kind = F.col("event_id"), F.col("event_type")
    block = F.expr("event_id div 1000")
    hot = block % 3 == 0
    bad = kind == "error"
    reason = (
        F.when(bad & (event % 3 == 0), "low_component_confidence")
        .when(bad & (event % 3 == 1), "low_component_circularity")
        .when(bad, "empty_mask")
        .when((kind == "signup") & (event % 5 == 0), "low_component_dominance")
        .otherwise("")
    )
    extreme = F.when(F.col("value") > 120, 250).when(F.col("value") < 4, -80).otherwise(0)
    empty = F.col("quality_reason") == "empty_mask"
    rec = F.col("recording_id")
    return (
        events.withColumn("recording_id", F.when(hot, 0).otherwise(block).cast("bigint"))
        .withColumn(
            "extraction_index",
            F.when(hot, F.expr("event_id div 3000") * 1000).otherwise(0) + event % 1000,
        )
        .withColumn("source_frame_index", F.expr("extraction_index + extraction_index div 17"))
        .withColumn("quality_reason", reason)
        .withColumn("_area", 100 + F.col("user_id") % 40 + extreme)
        .select(
            "recording_id",
            "source_frame_index",
            "extraction_index",
            F.format_string("rec%d_%05d.png", rec, F.col("source_frame_index") + 1).alias("image_name"),
            F.when(rec % 3 == 0, 10.0).when(rec % 3 == 1, 5.0).otherwise(97.0).alias("acquisition_fps"),
            (~bad).alias("segmentation_valid"),
            "quality_reason",
            "ts",
            F.when(~empty, F.col("user_id") + F.col("value") / 8).alias("raw_center_x_pixels"),
            F.when(~empty, F.col("value") / 4).alias("raw_center_y_pixels"),
            F.when(empty, 0).otherwise(F.col("_area")).alias("selected_component_area"),
            (F.col("_area") / 8).alias("estimated_pupil_diameter"),
            (F.col("_area") / 4).alias("pupil_diameter_input_pixels"),
        )
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements_of(table(spark, sf_dir, "events"))


# --- 8x8 maps and targets, from embeddings ----------------------------------------------

_GRID_SQL = """(SELECT * FROM embeddings,
  (SELECT unnest(range(8)) AS y) ys, (SELECT unnest(range(8)) AS x) xs)"""

PIXELS_SQL = f"""
pixels AS (
SELECT vec_id AS frame_id, y, x, 8 * y + x AS i, original_width, original_height,
       CASE vec_id % 25 WHEN 7 THEN p * 0.25::DOUBLE
            WHEN 8 THEN CASE WHEN x = y AND x BETWEEN 1 AND 6 THEN 0.99::DOUBLE ELSE 0 END
            WHEN 9 THEN CASE WHEN (x IN (1, 2) AND y BETWEEN 1 AND 4) OR (x IN (5, 6) AND y BETWEEN 2 AND 4)
                             THEN 0.97::DOUBLE ELSE 0 END
            WHEN 10 THEN CASE WHEN x = 4 AND y = 4 THEN 0.99::DOUBLE ELSE 0 END
            WHEN 12 THEN CASE WHEN greatest(abs(x - 4), abs(y - 4)) IN (1, 3) THEN 0.95::DOUBLE ELSE 0 END
            ELSE p END AS p
FROM (SELECT vec_id, y, x, 100 + 7 * (vec_id % 40) AS original_width, 90 + 5 * (vec_id % 30) AS original_height,
             least(1.0::DOUBLE, greatest(0.0::DOUBLE,
               1.25::DOUBLE - ((x - 2.5::DOUBLE - vec_id % 3) * (x - 2.5::DOUBLE - vec_id % 3)
                 + (y - 2.5::DOUBLE - (vec_id // 3) % 3) * (y - 2.5::DOUBLE - (vec_id // 3) % 3))
                 / (2 + label)::DOUBLE + embedding[8 * y + x + 1]::DOUBLE)) AS p
      FROM {_GRID_SQL} g) q)"""

TARGETS_SQL = f"""
targets AS (
SELECT vec_id AS frame_id, y, x, 8 * y + x AS i,
       CASE WHEN vec_id % 25 IN (7, 11) THEN 0
            WHEN vec_id % 25 = 8 THEN CASE WHEN x = y AND x BETWEEN 1 AND 6 THEN 1 ELSE 0 END
            WHEN vec_id % 25 = 12 THEN CASE WHEN greatest(abs(x - 4), abs(y - 4)) IN (1, 3) THEN 1 ELSE 0 END
            WHEN ((x - 2.5::DOUBLE - vec_id % 3) * (x - 2.5::DOUBLE - vec_id % 3)
               + (y - 2.5::DOUBLE - (vec_id // 3) % 3) * (y - 2.5::DOUBLE - (vec_id // 3) % 3)) * 2
               <= 1 + label THEN 1 ELSE 0 END AS t
FROM {_GRID_SQL} g)"""

_SQUARE = """((i % 8 - 2.5D - vec_id % 3) * (i % 8 - 2.5D - vec_id % 3)
  + (i div 8 - 2.5D - (vec_id div 3) % 3) * (i div 8 - 2.5D - (vec_id div 3) % 3))"""

_PROB = f"""transform(sequence(0, 63), i -> CASE vec_id % 25
  WHEN 8 THEN CASE WHEN i % 8 = i div 8 AND i % 8 BETWEEN 1 AND 6 THEN 0.99D ELSE 0D END
  WHEN 9 THEN CASE WHEN (i % 8 IN (1, 2) AND i div 8 BETWEEN 1 AND 4)
                     OR (i % 8 IN (5, 6) AND i div 8 BETWEEN 2 AND 4) THEN 0.97D ELSE 0D END
  WHEN 10 THEN CASE WHEN i = 36 THEN 0.99D ELSE 0D END
  WHEN 12 THEN CASE WHEN greatest(abs(i % 8 - 4), abs(i div 8 - 4)) IN (1, 3) THEN 0.95D ELSE 0D END
  ELSE least(1D, greatest(0D, 1.25D - {_SQUARE} / CAST(2 + label AS DOUBLE)
    + CAST(embedding[i] AS DOUBLE))) * CASE vec_id % 25 WHEN 7 THEN 0.25D ELSE 1D END END)"""

_TARGET = f"""transform(sequence(0, 63), i -> CASE WHEN vec_id % 25 IN (7, 11) THEN 0
  WHEN vec_id % 25 = 8 THEN CASE WHEN i % 8 = i div 8 AND i % 8 BETWEEN 1 AND 6 THEN 1 ELSE 0 END
  WHEN vec_id % 25 = 12 THEN CASE WHEN greatest(abs(i % 8 - 4), abs(i div 8 - 4)) IN (1, 3) THEN 1 ELSE 0 END
  WHEN {_SQUARE} * 2 <= 1 + label THEN 1 ELSE 0 END)"""


def maps_of(embeddings: DataFrame, *extra: Column) -> DataFrame:
    """One row per frame with its 8x8 map; cases 7 empty, 8 diagonal, 9 two blobs, 10 one
    pixel, 12 nested rings."""
    return once(embeddings, prob=F.expr(_PROB)).select(
        F.col("vec_id").alias("frame_id"),
        "prob",
        F.lit(8).alias("map_height"),
        F.lit(8).alias("map_width"),
        (100 + 7 * (F.col("vec_id") % 40)).alias("original_width"),
        (90 + 5 * (F.col("vec_id") % 30)).alias("original_height"),
        *extra,
    )


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps_of(table(spark, sf_dir, "embeddings"))


def labelled_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps with their target masks."""
    source = table(spark, sf_dir, "embeddings")
    return once(source, prob=F.expr(_PROB), target=F.expr(_TARGET)).select(
        F.col("vec_id").alias("frame_id"),
        "prob",
        "target",
        F.lit(8).alias("map_width"),
        F.lit(8).alias("map_height"),
    )


# --- grey images, from embeddings -------------------------------------------------------

GREY_SQL = f"""
grey AS (
SELECT vec_id AS frame_id, 8 * y + x AS i, y, x,
       least(255, greatest(0, 128 + floor(embedding[8 * y + x + 1]::DOUBLE * 100)))::BIGINT AS g
FROM {_GRID_SQL} g)"""

_GREY = """transform(sequence(0, 63),
  i -> CAST(least(255, greatest(0, 128 + floor(CAST(embedding[i] AS DOUBLE) * 100))) AS INT))"""


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 grey images with the target mask as 0/255 levels."""
    source = table(spark, sf_dir, "embeddings")
    mask = F.transform(F.expr(_TARGET), lambda t: t * 255)
    return once(source, image=F.expr(_GREY), mask=mask).select(
        F.col("vec_id").alias("frame_id"), "image", "mask"
    )


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _png(levels: list[int], width: int) -> bytes:
    """A grey image file of eight bits a pixel, rows without a filter."""
    height = len(levels) // width
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    rows = b"".join(b"\0" + bytes(levels[y * width : (y + 1) * width]) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")


def write_grey_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Every grey image as a file in a folder of a hundred, written by the tasks that hold the rows."""

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for frame, levels in zip(batch.column("frame_id").to_pylist(), batch.column("image").to_pylist(), strict=True):
                store.create_dir(f"{root}/set {frame // 100}", recursive=True)
                with store.open_output_stream(f"{root}/set {frame // 100}/eye_{frame % 100 + 1:05d}.png") as out:
                    out.write(_png(levels, 8))
            yield batch.select(["frame_id"])

    grey(spark, sf_dir).select("frame_id", "image").mapInArrow(write, "frame_id bigint").write.format("noop").mode("append").save()


def grey_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps together with the grey image they overlay."""
    return maps_of(table(spark, sf_dir, "embeddings"), F.expr(_GREY).alias("grey"))


# --- catalogues -------------------------------------------------------------------------

VIDEOS_SQL = """
videos AS (
SELECT concat('vid', o_orderkey) AS video_name, 1 + o_custkey % 60 AS frame_count,
       (5 + o_orderkey % 60)::DOUBLE AS encoded_fps, 5.0::DOUBLE AS extraction_fps,
       CASE WHEN o_orderkey % 4 = 0 THEN 20 WHEN o_orderkey % 9 > 1 THEN 10000 END AS max_frames,
       o_orderkey % 5 = 0 AS extract_all FROM orders)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("vid"), key).alias("video_name"),
        (1 + F.col("o_custkey") % 60).alias("frame_count"),
        (5 + key % 60).cast("double").alias("encoded_fps"),
        F.lit(5.0).alias("extraction_fps"),
        F.when(key % 4 == 0, 20).when(key % 9 > 1, 10000).alias("max_frames"),
        (key % 5 == 0).alias("extract_all"),
    )


IMAGE_FILES_SQL = """
image_files AS (
SELECT CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 + doc_id % 10 END AS recording_id,
       CASE WHEN doc_id = 13 THEN 'cover.png'
            WHEN doc_id % 3 > 0 AND doc_id % 10 = 4 THEN concat('eye_', printf('%05d', doc_id - 4), '.png')
            WHEN doc_id % 3 > 0 AND doc_id % 10 = 7 THEN concat(lang, '_', md5(text), '-', doc_id, '-x.png')
            ELSE concat('eye_', printf('%05d', doc_id + 1), '.png') END AS image_name, doc_id
FROM documents)"""


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of frame files: one hot, one zero-based, one without digits, one mixed."""
    doc = F.col("doc_id")
    cold = doc % 3 > 0
    plain = lambda n: F.format_string("eye_%05d.png", n)
    return table(spark, sf_dir, "documents").select(
        F.when(~cold, 0).otherwise(1 + doc % 10).alias("recording_id"),
        F.when(doc == 13, "cover.png")
        .when(cold & (doc % 10 == 4), plain(doc - 4))
        .when(
            cold & (doc % 10 == 7),
            F.concat("lang", F.lit("_"), F.md5("text"), F.lit("-"), doc, F.lit("-x.png")),
        )
        .otherwise(plain(doc + 1))
        .alias("image_name"),
        "doc_id",
    )


CHECKPOINTS_SQL = """
checkpoints AS (
SELECT p_partkey, concat(p_partkey, 'pupils', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('_thresh=0.', p_size % 10) END,
              CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('_iou=0.', printf('%04d', (p_partkey * 37) % 10000)) END,
              CASE WHEN p_partkey % 11 = 0 THEN '.json' ELSE '.pth' END) AS file_name,
       CASE WHEN p_partkey % 5 = 0 THEN p_size / 40.0::DOUBLE END AS metadata_threshold
FROM part)"""


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.concat(
            key.cast("string"),
            F.lit("pupils"),
            F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("_thresh=0."), size % 10)),
            F.when(key % 7 == 0, "").otherwise(F.format_string("_iou=0.%04d", (key * 37) % 10000)),
            F.when(key % 11 == 0, ".json").otherwise(".pth"),
        ).alias("file_name"),
        F.when(key % 5 == 0, size / F.lit(40.0)).alias("metadata_threshold"),
    )


IMAGE_SIZES_SQL = """
image_sizes AS (SELECT p_partkey AS image_id, 1 + p_partkey % 400 AS w, 1 + 7 * p_size AS h,
  p_partkey % 148 + p_size / 8.0::DOUBLE AS cx, p_size + p_partkey % 8 / 8.0::DOUBLE AS cy FROM part)"""


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        key.alias("image_id"),
        (1 + key % 400).alias("w"),
        (1 + 7 * size).alias("h"),
        (key % 148 + size / F.lit(8.0)).alias("cx"),
        (size + key % 8 / F.lit(8.0)).alias("cy"),
    )


STEMS_SQL = """
images AS (SELECT concat(source, '_', doc_id, CASE WHEN n_chars % 7 = 0 THEN '_redone' ELSE '' END) AS stem,
                  n_chars FROM documents),
masks AS (SELECT concat(d.source, '_', d.doc_id) AS stem, l.quality FROM labels l
          JOIN documents d ON d.doc_id = l.doc_id)"""


def image_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image stems; some were renamed, which orphans their masks."""
    return table(spark, sf_dir, "documents").select(
        F.concat(
            "source", F.lit("_"), "doc_id", F.when(F.col("n_chars") % 7 == 0, "_redone").otherwise("")
        ).alias("stem"),
        "n_chars",
    )


def mask_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(F.concat("source", F.lit("_"), "doc_id").alias("stem"), "quality")
    )


EPOCHS_SQL = """
epochs AS (SELECT CASE WHEN (event_id // 1000) % 3 = 0 THEN 0 ELSE event_id // 1000 END AS run_id,
                  CASE WHEN (event_id // 1000) % 3 = 0 THEN (event_id // 3000) * 1000 ELSE 0 END
                    + event_id % 1000 + 1 AS epoch,
                  value / 512 AS balanced_iou, user_id, value FROM events)"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training epochs, densely numbered from one in each run; run 0 holds a third of them."""
    block = F.expr("event_id div 1000")
    hot = block % 3 == 0
    return table(spark, sf_dir, "events").select(
        F.when(hot, 0).otherwise(block).cast("bigint").alias("run_id"),
        (
            F.when(hot, F.expr("event_id div 3000") * 1000).otherwise(0)
            + F.col("event_id") % 1000
            + 1
        ).alias("epoch"),
        (F.col("value") / 512).alias("balanced_iou"),
        "user_id",
        "value",
    )


RUNS_SQL = """
runs AS (SELECT p_partkey, p_partkey % 2 = 0 AS finetuned, p_partkey % 3 = 0 AS balanced,
  CASE p_partkey % 4 WHEN 0 THEN 1e-4::DOUBLE WHEN 1 THEN 5e-5::DOUBLE WHEN 2 THEN 3e-3::DOUBLE ELSE 2e-4::DOUBLE END AS finetune_learning_rate,
  CASE p_partkey % 3 WHEN 0 THEN 1e-3::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 20.0::DOUBLE END AS scratch_learning_rate,
  p_size AS seed, CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN concat('run.', p_partkey) END AS run_name,
  p_size / 64.0::DOUBLE AS prediction_threshold, p_partkey % 200 AS best_epoch,
  (p_partkey % 128) / 128.0::DOUBLE AS balanced_iou FROM part)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        (key % 2 == 0).alias("finetuned"),
        (key % 3 == 0).alias("balanced"),
        F.when(key % 4 == 0, 1e-4).when(key % 4 == 1, 5e-5).when(key % 4 == 2, 3e-3).otherwise(2e-4)
        .alias("finetune_learning_rate"),
        F.when(key % 3 == 0, 1e-3).when(key % 3 == 1, 1.0).otherwise(20.0)
        .alias("scratch_learning_rate"),
        F.col("p_size").alias("seed"),
        F.when(key % 5 == 0, F.col("p_name"))
        .when(key % 7 == 0, F.concat(F.lit("run."), key))
        .alias("run_name"),
        (F.col("p_size") / F.lit(64.0)).alias("prediction_threshold"),
        (key % 200).alias("best_epoch"),
        (key % 128 / F.lit(128.0)).alias("balanced_iou"),
    )
