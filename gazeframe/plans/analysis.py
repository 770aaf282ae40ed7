"""The whole flow, from frames or maps to compact tables, for many recordings in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeframe import schemas as S
from gazeframe.functions.columns import once
from gazeframe.operators import review
from gazeframe.operators.augment import resize_with_pad
from gazeframe.operators.motion import track_frames
from gazeframe.operators.results import tracking_status, velocity_columns
from gazeframe.operators.scoring import score_frames
from gazeframe.operators.segmentation import measure_frames
from gazeframe.sources.catalog import frame_catalogue, index_frames
from gazeframe.sources.images import image_scan, list_images


@dataclass(frozen=True)
class AnalysisResult:
    """Results as frames. Indexing image folders cuts its lineage durably when they are built; all
    measuring waits until one of them is used."""

    table: DataFrame
    segmentation: DataFrame
    tracking: DataFrame | None
    threshold: float


def _check(threshold: float, velocity: bool, fps: float | str | None, columns: list[str]) -> None:
    if not 0 < threshold < 1:
        raise ValueError("A prediction threshold lies between 0 and 1.")
    if isinstance(fps, (int, float)) and fps <= 0:
        raise ValueError("The acquisition rate must be above zero.")
    if velocity and fps is None and not {"acquisition_fps", "encoded_fps"} & set(columns):
        raise ValueError("Velocities of image folders need an acquisition rate.")


def prepare_frames(frames: DataFrame, size: int = S.MODEL_SIZE) -> DataFrame:
    """Model input of scanned images: resized, padded, scaled to 0..1."""
    ready = resize_with_pad(
        frames, "pixels", "original_width", "original_height", size, True, "model_image"
    )
    return ready.withColumn(
        "model_image", F.transform("model_image", lambda v: (v / 255.0).cast("float"))
    ).drop("pixels")


def analyze_maps(
    maps: DataFrame,
    threshold: float = S.DEFAULT_THRESHOLD,
    calculate_velocity: bool = False,
    acquisition_fps: float | str | None = None,
    mask: str | None = None,
    size: int = S.MODEL_SIZE,
) -> AnalysisResult:
    """Measure probability maps and assemble the diameter or the velocity table.

    Measurements already carry what the tables need, so no join is made; the only shuffle is
    the one of the temporal rules. ``size`` is the side of the scorer's input.
    """
    _check(threshold, calculate_velocity, acquisition_fps, maps.columns)
    measured = measure_frames(maps, threshold, mask, model_size=size)
    return _tables(measured, threshold, calculate_velocity, acquisition_fps)


def _tables(
    measured: DataFrame, threshold: float, calculate_velocity: bool, acquisition_fps: float | str | None
) -> AnalysisResult:
    if calculate_velocity:
        tracked = track_frames(measured, acquisition_fps)
        return AnalysisResult(velocity_columns(tracked), tracked, tracked, threshold)
    table = tracking_status(measured, "segmentation_status").select(
        "recording_id",
        (F.col("source_frame_index") + 1).alias("frame_number"),
        *S.DIAMETER_COLUMNS,
    )
    return AnalysisResult(table, measured, None, threshold)


def analyze_frames(
    images: DataFrame,
    load_scorer: Callable,
    threshold: float = S.DEFAULT_THRESHOLD,
    calculate_velocity: bool = False,
    acquisition_fps: float | str | None = None,
    batch_size: int = 32,
    size: int = S.MODEL_SIZE,
    listing: DataFrame | None = None,
) -> AnalysisResult:
    """From scanned image folders: score and measure in the scan, then join the file index.

    ``listing`` (:func:`gazeframe.sources.images.list_images` of the same folders) gives the names
    without decoding a file; without it the names are read from ``images``, which decodes files a second time
    (:func:`analyze_folders` does neither). Pixels and maps are never shuffled:
    only narrow measurements meet the index.
    """
    _check(threshold, calculate_velocity, acquisition_fps, images.columns)
    keys = ["recording_id", "image_name"]
    names = (images if listing is None else listing).select(*keys)
    index = index_frames(names).select(*keys, "source_frame_index", "extraction_index")
    maps = score_frames(prepare_frames(images, size), load_scorer, size, batch_size)
    measured = measure_frames(maps, threshold, model_size=size).join(index, keys)
    return _tables(measured, threshold, calculate_velocity, acquisition_fps)


def analyze_folders(
    spark: SparkSession,
    folder: str,
    load_scorer: Callable,
    threshold: float = S.DEFAULT_THRESHOLD,
    calculate_velocity: bool = False,
    acquisition_fps: float | None = None,
    batch_size: int = 32,
    size: int = S.MODEL_SIZE,
    root: str | None = None,
) -> AnalysisResult:
    """:func:`analyze_frames` of folders on disk (a glob may name many): names come from the listing, each file is
    decoded once."""
    return analyze_frames(
        image_scan(spark, folder, root), load_scorer, threshold, calculate_velocity, acquisition_fps, batch_size, size,
        listing=list_images(spark, folder, root),
    )


def analyze_videos(
    videos: DataFrame,
    images: DataFrame,
    load_scorer: Callable,
    threshold: float = S.DEFAULT_THRESHOLD,
    calculate_velocity: bool = False,
    acquisition_fps: float | str | None = None,
    batch_size: int = 32,
    size: int = S.MODEL_SIZE,
) -> AnalysisResult:
    """From a video catalogue and the decoded frames it selects.

    Velocity mode takes every frame, whatever cap the catalogue has. Each video's ``acquisition_fps`` is used, else the
    container's rate, unless one is given for all. Images outside the catalogue are measured and
    then dropped by the join, as only narrow measurements are shuffled; leave them out of ``images`` where they are many.
    The catalogue is never broadcast: Spark sizes it by its videos, however many frames they give.
    """
    _check(threshold, calculate_velocity, acquisition_fps, [*videos.columns, *images.columns])
    wanted = videos
    if calculate_velocity:
        wanted = videos.withColumn("extract_all", F.lit(True)).withColumn("max_frames", F.lit(None).cast("bigint"))
    carry = ["acquisition_fps"] + ([acquisition_fps] if isinstance(acquisition_fps, str) else [])
    frames = frame_catalogue(wanted, carry=tuple(dict.fromkeys(carry)))
    frames = frames.withColumnRenamed("video_name", "recording_id")
    maps = score_frames(prepare_frames(images, size), load_scorer, size, batch_size)
    measured = measure_frames(maps, threshold, model_size=size)
    shared = [c for c in frames.columns if c in measured.columns and c not in ("recording_id", "image_name")]
    measured = measured.drop(*shared).join(frames.hint("merge"), ["recording_id", "image_name"])
    return _tables(measured, threshold, calculate_velocity, acquisition_fps)


def overlay_frames(
    frames: DataFrame, threshold: float = S.DEFAULT_THRESHOLD, opacity: float = review.MASK_OPACITY
) -> DataFrame:
    """Overlay pixels of measured frames that still carry ``grey`` and ``prob``."""
    single = frames.schema["prob"].dataType.elementType == T.FloatType()
    coded = once(
        frames, confidence=F.transform("prob", lambda p: review.encode_confidence(p, threshold, single))
    )
    return review.center_marker(review.blend_overlay(coded, "grey", "confidence", opacity=opacity))
