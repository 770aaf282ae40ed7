"""Compact output tables, status summaries and plot series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe import schemas as S
from gazeframe.functions import quality as Q
from gazeframe.functions.columns import require_columns

KEYS = ["recording_id", "image_name"]


def tracking_status(df: DataFrame, name: str = "tracking_status") -> DataFrame:
    """Reduce the evidence to valid, warning or invalid."""
    return df.withColumn(name, Q.tracking_status(F.col("segmentation_valid"), F.col("quality_reason")))


def unmatched_predictions(results: DataFrame, frames: DataFrame) -> DataFrame:
    """Predictions whose image is not among the frames."""
    return results.join(frames.select(*KEYS), KEYS, "left_anti")


def result_violations(
    results: DataFrame, frames: DataFrame, evidence: DataFrame | None = None
) -> DataFrame:
    """Predictions that no table can hold: ``recording_id, image_name, rule``.

    ``no_frame``: the image is not among the frames. ``no_evidence``: ``evidence`` (a segmentation
    or tracking table), if given, has no row for it.
    """
    broken = unmatched_predictions(results, frames).select(*KEYS, F.lit("no_frame").alias("rule"))
    if evidence is not None:
        lacking = results.join(evidence.select(*KEYS), KEYS, "left_anti")
        broken = broken.unionByName(lacking.select(*KEYS, F.lit("no_evidence").alias("rule")))
    return broken


def _meet(left: DataFrame, right: DataFrame, strict: bool, what: str) -> DataFrame:
    """Join on the frame keys; with ``strict``, a row on the left without partner fails the job."""
    if not strict:
        return left.join(right, KEYS)
    joined = left.join(right.withColumn("_met", F.lit(True)), KEYS, "left")
    text = F.concat(F.lit(f"Prediction without {what}: "), "image_name")
    name = F.when(F.col("_met"), F.col("image_name")).otherwise(F.raise_error(text))
    return joined.withColumn("image_name", name).drop("_met")


def _places(frames: DataFrame) -> DataFrame:
    """One place for each frame name, the first if a name repeats, so that no prediction multiplies."""
    return frames.groupBy(*KEYS).agg(F.min("source_frame_index").alias("source_frame_index"))


def diameter_table(
    results: DataFrame,
    frames: DataFrame,
    segmentation: DataFrame | None = None,
    strict: bool = True,
) -> DataFrame:
    """One row per prediction with its status; ``frame_number`` is one-based.

    With a segmentation table the diameters come from it; without one nothing was judged. A
    prediction without frame or segmentation row fails the job when the table is computed;
    ``strict=False`` leaves it out, and :func:`result_violations` lists it.
    """
    matched = _meet(results, _places(frames), strict, "frame")
    numbered = (F.col("source_frame_index") + 1).alias("frame_number")
    if segmentation is None:
        table = (
            matched.withColumn("pupil_visibility", F.lit("not_evaluated"))
            .withColumn("segmentation_valid", F.lit(True))
            .withColumn("quality_reason", F.lit(""))
        )
    else:
        evidence = segmentation.select(
            *KEYS, *S.DIAMETER_COLUMNS[1:4], "segmentation_valid", "quality_reason"
        )
        table = _meet(matched.select(*KEYS, "source_frame_index"), evidence, strict, "segmentation row")
    table = tracking_status(table, "segmentation_status").withColumn(
        "quality_reason", F.coalesce("quality_reason", F.lit(""))
    )
    return table.select("recording_id", numbered, *S.DIAMETER_COLUMNS)


def velocity_columns(tracked: DataFrame) -> DataFrame:
    """The compact velocity layout of a tracked table, no join involved."""
    table = tracking_status(tracked).withColumn(
        "quality_reason", F.coalesce("quality_reason", F.lit(""))
    )
    if "pupil_visibility" not in table.columns:
        table = table.withColumn(
            "pupil_visibility", Q.visibility(F.col("quality_reason"), F.col("segmentation_valid"))
        )
    numbered = (F.col("source_frame_index") + 1).alias("frame_number")
    return table.select("recording_id", numbered, *S.VELOCITY_COLUMNS)


def velocity_table(
    results: DataFrame, frames: DataFrame, tracked: DataFrame, strict: bool = True
) -> DataFrame:
    """One row per prediction with centre, speed and status; ``strict`` as in :func:`diameter_table`."""
    require_columns(tracked, ["segmentation_valid", "quality_reason"], "Tracking table")
    matched = _meet(results.select(*KEYS), _places(frames).select(*KEYS), strict, "frame")
    return velocity_columns(_meet(matched, tracked, strict, "tracking row"))


def plot_series(table: DataFrame) -> DataFrame:
    """Long series of a diameter or velocity table: panel, series, frame, value, status."""
    status = "tracking_status" if "tracking_status" in table.columns else "segmentation_status"
    code = F.coalesce(*[F.when(F.col(status) == k, F.lit(v)) for k, v in S.STATUS_CODES.items()])
    series = [("diameter", "diameter", F.col("estimated_pupil_diameter"))]
    if status == "tracking_status":
        series += [
            ("center", "x", F.col("center_x_pixels")),
            ("center", "y", F.col("center_y_pixels")),
            ("speed", "speed", F.col("speed_pixels_per_second")),
            ("quality", "status", code),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(panel).alias("panel"),
                F.lit(name).alias("series"),
                value.cast("double").alias("value"),
            )
            for panel, name, value in series
        ]
    )
    return table.select(
        "recording_id",
        "frame_number",
        F.inline(rows),
        F.col(status).alias("status"),
        code.alias("status_code"),
    )


def status_summary(table: DataFrame) -> DataFrame:
    """Counts per status, usable share, published speeds and diameter range per recording."""
    status = "tracking_status" if "tracking_status" in table.columns else "segmentation_status"
    speed = "speed_pixels_per_second"
    published = F.count(speed) if speed in table.columns else F.lit(0)
    counts = {k: F.count_if(F.col(status) == k) for k in S.STATUS_CODES}
    return table.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("frames"),
        *[c.alias(f"{k}_frames") for k, c in counts.items()],
        ((counts["valid"] + counts["warning"]) / F.count(F.lit(1))).alias("usable_fraction"),
        published.alias("published_speeds"),
        F.min("estimated_pupil_diameter").alias("min_diameter"),
        F.max("estimated_pupil_diameter").alias("max_diameter"),
    )


def reason_counts(table: DataFrame) -> DataFrame:
    """How often each quality code occurs per recording."""
    codes = F.filter(F.split("quality_reason", ";"), lambda c: c != "")
    return (
        table.select("recording_id", F.explode(codes).alias("reason"))
        .groupBy("recording_id", "reason")
        .agg(F.count(F.lit(1)).alias("frames"))
    )
