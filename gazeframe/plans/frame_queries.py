"""Catalogues, temporal rules, tables and review data, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazeframe import schemas as S
from gazeframe.functions import quality as Q
from gazeframe.operators import motion, results, review
from gazeframe.plans import stand_ins as V
from gazeframe.plans.registry import query
from gazeframe.session import scratch_path
from gazeframe.sources import catalog, checkpoints, tables

# --- catalogues -------------------------------------------------------------------------

_INDEXED = """
stems AS (SELECT *, try_cast(nullif(regexp_extract(regexp_replace(image_name, '\\.png$', ''), '([0-9]+)$', 1), '') AS BIGINT) AS suffix
  FROM image_files),
indexed AS (
SELECT recording_id, image_name, row_number() OVER w - 1 AS extraction_index,
  CASE WHEN bool_and(suffix IS NOT NULL) OVER p THEN suffix - CASE WHEN min(suffix) OVER p >= 1 THEN 1 ELSE 0 END
       ELSE row_number() OVER w - 1 END AS source_frame_index
FROM stems WINDOW p AS (PARTITION BY recording_id),
  w AS (PARTITION BY recording_id ORDER BY coalesce(suffix, 0), image_name))"""


@query(
    "recording_id:i image_name:s source_frame_index:i extraction_index:i",
    "SELECT * FROM indexed",
    (V.IMAGE_FILES_SQL, _INDEXED),
)
def index_frames(spark, sf_dir):
    return catalog.index_frames(V.image_files(spark, sf_dir))


@query(
    "recording_id:i experiment_name:s",
    """SELECT recording_id, array_to_string(string_split(stem, '_')[:len(string_split(stem, '_')) - 1], '_')
         AS experiment_name
       FROM (SELECT recording_id, regexp_replace(arg_min(image_name,
               (source_frame_index, extraction_index, image_name)), '\\.png$', '') AS stem
             FROM indexed GROUP BY recording_id)""",
    (V.IMAGE_FILES_SQL, _INDEXED),
)
def experiment_name(spark, sf_dir):
    return catalog.experiment_name(catalog.index_frames(V.image_files(spark, sf_dir)))


_SAMPLED = """
counted AS (SELECT *, CASE WHEN extract_all THEN least(frame_count, coalesce(max_frames, frame_count))
    ELSE greatest(1, least(frame_count, coalesce(max_frames, frame_count),
      round_even(frame_count / encoded_fps * least(extraction_fps, encoded_fps), 0)::BIGINT)) END AS n
  FROM videos),
sampled AS (SELECT *, extract_all AND n < frame_count AS truncated, CASE WHEN extract_all THEN extraction_index WHEN n = 1 THEN 0
    WHEN extraction_index = n - 1 THEN frame_count - 1
    ELSE floor(extraction_index * ((frame_count - 1) / (n - 1)))::BIGINT END AS source_frame_index
  FROM (SELECT *, unnest(range(n)) AS extraction_index FROM counted) c)"""


@query(
    "video_name:s extraction_index:i source_frame_index:i truncated:b",
    "SELECT * FROM sampled",
    (V.VIDEOS_SQL, _SAMPLED),
)
def sample_frame_indices(spark, sf_dir):
    return catalog.sample_frame_indices(V.videos(spark, sf_dir))


@query(
    "video_name:s image_name:s source_frame_index:i extraction_index:i encoded_fps:d truncated:b",
    """SELECT s.*, concat(video_name, '_', printf('%05d', source_frame_index + 1), '.png') AS image_name
       FROM sampled s LEFT JOIN unreadable u USING (video_name, source_frame_index)
       WHERE u.video_name IS NULL""",
    (
        V.VIDEOS_SQL,
        _SAMPLED,
        """
unreadable AS (SELECT concat('vid', l_orderkey) AS video_name, l_linenumber::BIGINT AS source_frame_index
  FROM lineitem GROUP BY ALL)""",
    ),
)
def frame_catalogue(spark, sf_dir):
    lines = V.table(spark, sf_dir, "lineitem")
    unreadable = lines.select(
        F.concat(F.lit("vid"), "l_orderkey").alias("video_name"),
        F.col("l_linenumber").cast("bigint").alias("source_frame_index"),
    )
    return catalog.frame_catalogue(V.videos(spark, sf_dir), unreadable)


@query(
    "event_id:i image_name:s",
    "SELECT event_id, concat('eye', user_id, '_', printf('%05d', event_id * 37 + 1), '.png') AS image_name FROM events",
)
def source_frame_name(spark, sf_dir):
    name = catalog.source_frame_name(
        F.concat(F.lit("eye"), F.col("user_id").cast("string")), F.col("event_id") * 37
    )
    return V.table(spark, sf_dir, "events").select("event_id", name.alias("image_name"))


_VELOCITY_SCHEMA = (
    "image_name string, estimated_pupil_diameter double, pupil_diameter_input_pixels double, "
    "pupil_visibility string, timestamp_seconds double, center_x_pixels double, "
    "center_y_pixels double, speed_pixels_per_second double, tracking_status string, "
    "quality_reason string, recording_id bigint"
)

_VISIBILITY = """CASE WHEN list_contains(string_split(quality_reason, ';'), 'empty_mask') THEN 'not_detected'
  WHEN list_has_any(string_split(quality_reason, ';'), ['low_component_circularity', 'component_touches_border'])
    THEN 'partially_visible_or_uncertain'
  WHEN NOT segmentation_valid THEN 'uncertain' ELSE 'visible' END"""
_STATUS = """CASE WHEN NOT segmentation_valid THEN 'invalid' WHEN quality_reason <> '' THEN 'warning' ELSE 'valid' END"""

_TRACKED = f"""
radius AS (SELECT *, greatest(1, round_even(acquisition_fps * 0.5e0, 0))::BIGINT AS r FROM measurements),
medians AS (SELECT a.recording_id, a.source_frame_index, median(b.selected_component_area)::DOUBLE AS local_area_median
  FROM radius a JOIN radius b ON a.recording_id = b.recording_id
    AND b.source_frame_index BETWEEN a.source_frame_index - a.r AND a.source_frame_index + a.r
    AND b.source_frame_index <> a.source_frame_index
  WHERE a.segmentation_valid AND b.segmentation_valid
  GROUP BY ALL HAVING count(*) >= 4),
areas AS (SELECT m.* EXCLUDE (quality_reason), quality_reason AS first_reason, local_area_median,
    selected_component_area / local_area_median AS area_to_local_median_ratio
  FROM measurements m LEFT JOIN medians USING (recording_id, source_frame_index)),
flagged AS (SELECT *, CASE WHEN area_to_local_median_ratio < 0.65e0 OR area_to_local_median_ratio > 2e0
    THEN CASE WHEN first_reason = '' THEN 'abrupt_area_change' ELSE concat(first_reason, ';abrupt_area_change') END
    ELSE first_reason END AS quality_reason FROM areas),
placed AS (SELECT *, source_frame_index / acquisition_fps AS timestamp_seconds,
    CASE WHEN segmentation_valid THEN raw_center_x_pixels END AS center_x_pixels,
    CASE WHEN segmentation_valid THEN raw_center_y_pixels END AS center_y_pixels FROM flagged),
moves AS (SELECT *, source_frame_index - lag(source_frame_index) OVER w = 1 AND segmentation_valid
      AND lag(segmentation_valid) OVER w AS usable,
    timestamp_seconds - lag(timestamp_seconds) OVER w AS dt,
    center_x_pixels - lag(center_x_pixels) OVER w AS dx, center_y_pixels - lag(center_y_pixels) OVER w AS dy
  FROM placed WINDOW w AS (PARTITION BY recording_id ORDER BY source_frame_index)),
tracked AS (SELECT *, CASE WHEN usable THEN dx END AS displacement_x_pixels,
    CASE WHEN usable THEN dy END AS displacement_y_pixels,
    CASE WHEN usable THEN dx / dt END AS velocity_x_pixels_per_second,
    CASE WHEN usable THEN dy / dt END AS velocity_y_pixels_per_second,
    CASE WHEN usable THEN sqrt(dx / dt * (dx / dt) + dy / dt * (dy / dt)) END AS speed_pixels_per_second,
    {_VISIBILITY} AS pupil_visibility, {_STATUS} AS tracking_status, source_frame_index + 1 AS frame_number
  FROM moves)"""
TRACKING = (V.MEASUREMENTS_SQL, _TRACKED)

_VELOCITY = (
    "recording_id:i image_name:s estimated_pupil_diameter:d pupil_diameter_input_pixels:d "
    "pupil_visibility:s timestamp_seconds:d center_x_pixels:d center_y_pixels:d "
    "speed_pixels_per_second:d tracking_status:s quality_reason:s"
)


@query(_VELOCITY, "SELECT * FROM tracked", TRACKING)
def analysis_csv_sink(spark, sf_dir):
    path = scratch_path(spark, "analysis")
    tables.write_analysis(
        results.velocity_columns(motion.track_frames(V.measurements(spark, sf_dir))), path
    )
    return tables.read_analysis(spark, path, _VELOCITY_SCHEMA)


@query(_VELOCITY, "SELECT * FROM tracked", TRACKING)
def analysis_recordings(spark, sf_dir):
    """One file per recording, read back under the files' names."""
    path = scratch_path(spark, "recordings")
    tables.write_recordings(results.velocity_columns(motion.track_frames(V.measurements(spark, sf_dir))), path)
    plain = ", ".join(f for f in _VELOCITY_SCHEMA.split(", ") if not f.startswith("recording_id "))
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.csv$", 1)
    rows = tables.read_analysis(spark, path, plain)
    return rows.withColumn("recording_id", name.cast("bigint"))


@query(
    "run_id:i epoch:i train_loss:d val_loss:d macro_dice:d macro_iou:d balanced_iou:d threshold:d "
    "tiny_iou:d medium_iou:d large_iou:d low_circularity_iou:d learning_rate:d",
    """SELECT run_id, epoch, user_id / 1000 AS train_loss, user_id / 500 AS val_loss, value AS macro_dice,
         value AS macro_iou, user_id / 200 AS balanced_iou, (user_id % 100) / 100 AS threshold,
         CASE WHEN user_id % 3 > 0 THEN user_id / 250 END AS tiny_iou, user_id / 125 AS medium_iou,
         value AS large_iou, CASE WHEN user_id % 2 > 0 THEN user_id / 1000 END AS low_circularity_iou,
         CASE WHEN user_id % 2 = 0 THEN 1e-4 ELSE 5e-5 END AS learning_rate FROM epochs""",
    (V.EPOCHS_SQL,),
)
def training_log_scan(spark, sf_dir):
    user, value = F.col("user_id"), F.format_string("%.2f", "value")
    number = lambda c, k: F.format_string(f"%.{k}f", c)
    maybe = lambda on, c: F.when(on, number(c, 4)).otherwise("n/a")
    fields = {
        "Train Loss": number(user / 1000, 4),
        "Val Loss": number(user / 500, 4),
        "Macro Dice": value,
        "Macro IoU": value,
        "Balanced IoU": number(user / 200, 4),
        "Threshold": number((user % 100) / 100, 2),
        "Tiny": maybe(user % 3 > 0, user / 250),
        "Medium": number(user / 125, 4),
        "Large": value,
        "Low-circularity": maybe(user % 2 > 0, user / 1000),
        "LR": F.when(user % 2 == 0, "0.0001").otherwise("5e-05"),
    }
    parts = [F.format_string("Epoch %03d", "epoch")]
    parts += [F.concat(F.lit(f"{label}: "), text) for label, text in fields.items()]
    lines = V.epochs(spark, sf_dir).select("run_id", F.concat_ws(" | ", *parts).alias("value"))
    return checkpoints.parse_training_log(lines, ["run_id"])


@query(
    "file_name:s iou:d",
    """SELECT file_name, iou FROM (SELECT file_name,
           try_cast(nullif(regexp_extract(file_name, 'iou=(0\\.[0-9]+)', 1), '') AS DOUBLE) AS iou FROM checkpoints) c
       WHERE iou IS NOT NULL AND file_name LIKE '%.pth' ORDER BY iou DESC, file_name DESC LIMIT 1""",
    (V.CHECKPOINTS_SQL,),
)
def best_checkpoint(spark, sf_dir):
    return checkpoints.best_checkpoint(V.checkpoints(spark, sf_dir))


@query(
    "file_name:s prediction_threshold:d threshold_source:s",
    """SELECT file_name, coalesce(meta, named, 0.7) AS prediction_threshold,
         CASE WHEN meta IS NOT NULL THEN 'metadata' WHEN named IS NOT NULL THEN 'file_name' ELSE 'fallback' END
           AS threshold_source
       FROM (SELECT file_name, CASE WHEN metadata_threshold > 0 AND metadata_threshold < 1 THEN metadata_threshold END AS meta,
               CASE WHEN n > 0 AND n < 1 THEN n END AS named
             FROM (SELECT *, try_cast(nullif(regexp_extract(file_name,
                     '(?:pred_)?thresh(?:old)?=(0(?:\\.[0-9]+)?|1(?:\\.0+)?)', 1), '') AS DOUBLE) AS n FROM checkpoints) c) d""",
    (V.CHECKPOINTS_SQL,),
)
def resolve_threshold(spark, sf_dir):
    return checkpoints.resolve_threshold(V.checkpoints(spark, sf_dir))


@query(
    "file_name:s prediction_threshold:d threshold_source:s",
    """SELECT c.file_name, CASE WHEN c.file_name LIKE '%.json' THEN 0.7e0 ELSE coalesce(d.t, 0.7e0) END AS prediction_threshold,
         CASE WHEN c.file_name NOT LIKE '%.json' AND d.t IS NOT NULL THEN 'metadata' ELSE 'fallback' END AS threshold_source
       FROM (SELECT replace(file_name, 'thresh=', 'cut=') AS file_name FROM checkpoints) c
       LEFT JOIN (SELECT regexp_replace(replace(file_name, 'thresh=', 'cut='), '[.][^.]*$', '') AS stem,
                    CASE WHEN metadata_threshold < 1 THEN metadata_threshold END AS t FROM checkpoints WHERE metadata_threshold > 0) d
         ON d.stem = regexp_replace(c.file_name, '[.][^.]*$', '')""",
    (V.CHECKPOINTS_SQL,),
)
def checkpoint_thresholds(spark, sf_dir):
    """Files and metadata documents joined by stem; names without a threshold of their own."""
    plain = F.replace("file_name", F.lit("thresh="), F.lit("cut="))
    files = V.checkpoints(spark, sf_dir).withColumn("file_name", plain)
    documents = files.where("metadata_threshold IS NOT NULL").select(
        F.concat(F.regexp_replace("file_name", r"[.][^.]*$", ""), F.lit(".json")).alias("metadata_file"),
        F.col("metadata_threshold").alias("prediction_threshold"),
    )
    return checkpoints.resolve_threshold(checkpoints.with_metadata(files.select("file_name"), documents))


@query(
    "file_name:s prediction_threshold:d threshold_source:s",
    "SELECT file_name, 0.65e0 AS prediction_threshold, 'requested' AS threshold_source FROM checkpoints",
    (V.CHECKPOINTS_SQL,),
)
def resolve_threshold_requested(spark, sf_dir):
    return checkpoints.resolve_threshold(V.checkpoints(spark, sf_dir), requested=0.65)


@query(
    "stem:s n_chars:i quality:i",
    "SELECT * FROM images JOIN masks USING (stem)",
    (V.STEMS_SQL,),
)
def pair_images_masks(spark, sf_dir):
    images, masks = V.image_stems(spark, sf_dir), V.mask_stems(spark, sf_dir)
    return catalog.pair_images_masks(images, masks, strict=False)


@query("stem:s", "SELECT stem FROM images ANTI JOIN masks USING (stem)", (V.STEMS_SQL,))
def missing_masks(spark, sf_dir):
    return catalog.missing_masks(V.image_stems(spark, sf_dir), V.mask_stems(spark, sf_dir))


@query("stem:s", "SELECT stem FROM masks ANTI JOIN images USING (stem)", (V.STEMS_SQL,))
def orphan_masks(spark, sf_dir):
    return catalog.orphan_masks(V.image_stems(spark, sf_dir), V.mask_stems(spark, sf_dir))


@query(
    "stem:s n_chars:i",
    "SELECT * FROM images WHERE stem NOT IN (SELECT stem FROM masks)",
    (V.STEMS_SQL,),
)
def pending_annotations(spark, sf_dir):
    return catalog.pending_annotations(V.image_stems(spark, sf_dir), V.mask_stems(spark, sf_dir))


_MANIFEST = """
manifest AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'cropped' WHEN 1 THEN 'raw' WHEN 2 THEN 'velocity' ELSE lang END AS category,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'm' END AS mask_path, source AS source_recording,
  printf('%05d', doc_id // 4) AS source_frame_suffix,
  CASE WHEN n_chars % 9 = 0 THEN '98' WHEN doc_id % 4 = 2 THEN '97' END AS acquisition_fps_hz FROM documents)"""


def _manifest(spark, sf_dir):
    doc = F.col("doc_id")
    kind = F.when(doc % 4 == 0, "cropped").when(doc % 4 == 1, "raw").when(doc % 4 == 2, "velocity")
    return V.table(spark, sf_dir, "documents").select(
        kind.otherwise(F.col("lang")).alias("category"),
        F.when(doc % 5 == 0, "").otherwise("m").alias("mask_path"),
        F.col("source").alias("source_recording"),
        F.format_string("%05d", F.expr("doc_id div 4")).alias("source_frame_suffix"),
        F.when(F.col("n_chars") % 9 == 0, "98").when(doc % 4 == 2, "97").alias("acquisition_fps_hz"),
    )


@query(
    "category:s rows:i masks:i recordings:i first_suffix:i last_suffix:i distinct_suffixes:i",
    """SELECT category, count(*) AS rows, count(nullif(mask_path, '')) AS masks,
         count(DISTINCT source_recording) AS recordings, min(source_frame_suffix::BIGINT) AS first_suffix,
         max(source_frame_suffix::BIGINT) AS last_suffix, count(DISTINCT source_frame_suffix) AS distinct_suffixes
       FROM manifest GROUP BY category""",
    (_MANIFEST,),
)
def manifest_contract(spark, sf_dir):
    return tables.manifest_summary(_manifest(spark, sf_dir))


@query(
    "rule:s category:s found:i",
    """SELECT 'unknown_category' AS rule, category, count(*) AS found FROM manifest
         WHERE category NOT IN ('cropped', 'raw', 'velocity') GROUP BY category
       UNION ALL SELECT 'wrong_rate', category, count(*) FROM manifest
         WHERE category = 'velocity' AND acquisition_fps_hz IS DISTINCT FROM '97' GROUP BY category
       UNION ALL SELECT 'missing_mask', category, count(*) FROM manifest
         WHERE category = 'cropped' AND mask_path = '' GROUP BY category
       UNION ALL SELECT 'suffixes_missing', category, max(n) - min(n) + 1 - count(DISTINCT n) FROM suffixes GROUP BY category
         HAVING max(n) - min(n) + 1 > count(DISTINCT n)
       UNION ALL SELECT 'suffixes_repeated', category, count(*) - count(DISTINCT n) FROM suffixes GROUP BY category
         HAVING count(*) > count(DISTINCT n)
       UNION ALL SELECT 'wrong_row_count', w.category, count(m.category) FROM (VALUES ('cropped', 5), ('absent', 3)) AS w(category, n)
         LEFT JOIN manifest m USING (category) GROUP BY w.category, w.n HAVING count(m.category) <> w.n""",
    (_MANIFEST, """
suffixes AS (SELECT category, source_frame_suffix::BIGINT * (CASE WHEN category = 'raw' THEN 2 ELSE 1 END) // (CASE WHEN category = 'raw' THEN 1 ELSE 2 END) AS n
  FROM manifest WHERE category IN ('velocity', 'raw'))"""),
)
def manifest_violations(spark, sf_dir):
    # Raw frames skip every other suffix, velocity frames have each twice.
    number, kind = F.col("source_frame_suffix").cast("bigint"), F.col("category")
    spaced = F.when(kind == "raw", number * 2).when(kind == "velocity", F.expr("source_frame_suffix div 2")).otherwise(number)
    return tables.manifest_violations(
        _manifest(spark, sf_dir).withColumn("source_frame_suffix", spaced.cast("string")),
        ["cropped", "raw", "velocity"],
        {"velocity": "97"},
        consecutive=("velocity", "raw"),
        masked=("cropped",),
        rows_by_category={"cropped": 5, "absent": 3},
    )


# Pages stand for images and masks: most are paired, every seventh file is absent, every fifth mask is named differently.
_FILES = """
listed AS (SELECT concat('img/f', page_id, '.png') AS image_path, CASE WHEN page_id % 3 = 0 THEN ''
    WHEN page_id % 5 = 0 THEN concat('masks/g', page_id, '.png') ELSE concat('masks/f', page_id, '.png') END AS mask_path, page_id FROM pages),
present AS (SELECT path FROM (SELECT image_path AS path, page_id FROM listed UNION ALL SELECT mask_path, page_id + 3 FROM listed) f WHERE page_id % 7 <> 0)"""


@query(
    "rule:s path:s",
    """SELECT 'file_missing' AS rule, path FROM (SELECT image_path AS path FROM listed UNION SELECT mask_path FROM listed) l
         WHERE path <> '' AND path NOT IN (SELECT path FROM present)
       UNION ALL SELECT 'names_differ', mask_path FROM listed WHERE mask_path <> '' AND page_id % 5 = 0""",
    (_FILES,),
)
def manifest_file_violations(spark, sf_dir):
    page = F.col("page_id")
    mask = F.format_string("masks/%s%d.png", F.when(page % 5 == 0, "g").otherwise("f"), page)
    listed = V.table(spark, sf_dir, "pages").select(
        "page_id", F.format_string("img/f%d.png", page).alias("image_path"), F.when(page % 3 == 0, "").otherwise(mask).alias("mask_path")
    )
    files = listed.select(F.col("image_path").alias("path"), "page_id").union(listed.select("mask_path", page + 3))
    return tables.manifest_file_violations(listed, files.where("page_id % 7 <> 0").select("path"))


# --- temporal rules ---------------------------------------------------------------------


@query(
    "recording_id:i image_name:s timestamp_seconds:d",
    "SELECT * FROM tracked",
    TRACKING,
)
def frame_timestamps(spark, sf_dir):
    return motion.frame_timestamps(V.measurements(spark, sf_dir))


@query(
    "recording_id:i image_name:s local_area_median:d area_to_local_median_ratio:d",
    "SELECT * FROM tracked",
    TRACKING,
)
def local_area_median(spark, sf_dir):
    return motion.local_area_median(V.measurements(spark, sf_dir))


@query(
    "recording_id:i image_name:s segmentation_valid:b quality_reason:s",
    "SELECT * FROM tracked",
    TRACKING,
)
def abrupt_area_change(spark, sf_dir):
    return motion.abrupt_area_change(V.measurements(spark, sf_dir))


@query(
    "recording_id:i image_name:s center_x_pixels:d center_y_pixels:d", "SELECT * FROM tracked", TRACKING
)
def published_centers(spark, sf_dir):
    return motion.published_centers(V.measurements(spark, sf_dir))


_MOTION = (
    "recording_id:i image_name:s displacement_x_pixels:d displacement_y_pixels:d "
    "velocity_x_pixels_per_second:d velocity_y_pixels_per_second:d speed_pixels_per_second:d"
)


@query(_MOTION, "SELECT * FROM tracked", TRACKING)
def kinematics(spark, sf_dir):
    return motion.kinematics(V.measurements(spark, sf_dir))


@query(
    _MOTION + " source_frame_index:i timestamp_seconds:d local_area_median:d "
    "area_to_local_median_ratio:d quality_reason:s segmentation_valid:b center_x_pixels:d center_y_pixels:d",
    "SELECT * FROM tracked",
    TRACKING,
)
def track_frames(spark, sf_dir):
    return motion.track_frames(V.measurements(spark, sf_dir))


# --- quality text and tables ------------------------------------------------------------


@query(
    "event_id:i joined:s appended:s",
    """SELECT event_id, CASE WHEN a = b THEN a ELSE concat(a, ';', b) END AS joined,
         CASE WHEN a = 'signup' THEN 'view' ELSE concat(a, ';', b, ';view') END AS appended
       FROM (SELECT event_id, event_type AS a, CASE WHEN user_id % 2 = 0 THEN 'view' ELSE 'click' END AS b
             FROM events) e""",
)
def join_reasons(spark, sf_dir):
    a = F.col("event_type")
    b = F.when(F.col("user_id") % 2 == 0, "view").otherwise("click")
    before = F.when(a != "signup", F.concat_ws(";", a, b))
    return V.table(spark, sf_dir, "events").select(
        "event_id",
        Q.join_reasons(F.array(a, F.lit(""), b, a)).alias("joined"),
        Q.append_reason(before, "view").alias("appended"),
    )


@query("recording_id:i image_name:s tracking_status:s", "SELECT * FROM tracked", TRACKING)
def tracking_status(spark, sf_dir):
    return results.tracking_status(motion.track_frames(V.measurements(spark, sf_dir)))


_KEYS = ["recording_id", "image_name"]


def _results(spark, sf_dir):
    """Predictions and frames as separate tables."""
    rows = V.measurements(spark, sf_dir)
    return rows.select(*_KEYS, *S.DIAMETER_COLUMNS[1:3]), rows.select(*_KEYS, "source_frame_index")


@query(
    "recording_id:i image_name:s",
    """SELECT recording_id, concat('rec', recording_id, '_', printf('%05d', extraction_index + 1), '.png') AS image_name
       FROM measurements EXCEPT SELECT recording_id, image_name FROM measurements""",
    (V.MEASUREMENTS_SQL,),
)
def unmatched_predictions(spark, sf_dir):
    _, frames = _results(spark, sf_dir)
    shifted = V.measurements(spark, sf_dir).select(
        "recording_id",
        F.format_string("rec%d_%05d.png", "recording_id", F.col("extraction_index") + 1).alias("image_name"),
    )
    return results.unmatched_predictions(shifted, frames)


_DIAMETER = (
    "recording_id:i frame_number:i image_name:s estimated_pupil_diameter:d "
    "pupil_diameter_input_pixels:d pupil_visibility:s segmentation_status:s quality_reason:s"
)


@query(
    _DIAMETER,
    f"""SELECT *, source_frame_index + 1 AS frame_number, {_VISIBILITY} AS pupil_visibility,
          {_STATUS} AS segmentation_status FROM measurements""",
    (V.MEASUREMENTS_SQL,),
)
def diameter_table(spark, sf_dir):
    predictions, frames = _results(spark, sf_dir)
    evidence = V.measurements(spark, sf_dir).withColumn(
        "pupil_visibility", Q.visibility(F.col("quality_reason"), F.col("segmentation_valid"))
    )
    return results.diameter_table(predictions, frames, evidence)


@query(
    _DIAMETER,
    """SELECT * EXCLUDE (quality_reason), source_frame_index + 1 AS frame_number,
         'not_evaluated' AS pupil_visibility, 'valid' AS segmentation_status, '' AS quality_reason FROM measurements""",
    (V.MEASUREMENTS_SQL,),
)
def diameter_table_unevaluated(spark, sf_dir):
    return results.diameter_table(*_results(spark, sf_dir))


@query(
    "recording_id:i image_name:s rule:s",
    """SELECT recording_id, image_name, 'no_frame' AS rule FROM measurements WHERE source_frame_index % 11 = 4
       UNION ALL SELECT recording_id, image_name, 'no_evidence' FROM measurements WHERE source_frame_index % 13 = 5""",
    (V.MEASUREMENTS_SQL,),
)
def result_violations(spark, sf_dir):
    predictions, frames = _results(spark, sf_dir)
    rows = V.measurements(spark, sf_dir)
    return results.result_violations(
        predictions, frames.where("source_frame_index % 11 <> 4"), rows.where("source_frame_index % 13 <> 5")
    )


@query(
    _VELOCITY + " frame_number:i",
    "SELECT * FROM tracked WHERE source_frame_index % 11 <> 4 AND source_frame_index % 13 <> 5",
    TRACKING,
)
def velocity_table_lenient(spark, sf_dir):
    """Unmatched predictions left out on request; repeated frame names multiply nothing."""
    predictions, frames = _results(spark, sf_dir)
    tracked = motion.track_frames(V.measurements(spark, sf_dir)).where("source_frame_index % 13 <> 5")
    present = frames.where("source_frame_index % 11 <> 4")
    return results.velocity_table(predictions, present.union(present), tracked, strict=False)


@query(_VELOCITY + " frame_number:i", "SELECT * FROM tracked", TRACKING)
def velocity_table(spark, sf_dir):
    tracked = motion.track_frames(V.measurements(spark, sf_dir))
    return results.velocity_table(*_results(spark, sf_dir), tracked)


def _velocity(spark, sf_dir):
    return results.velocity_columns(motion.track_frames(V.measurements(spark, sf_dir)))


@query(
    "recording_id:i panel:s series:s frame_number:i value:d status:s status_code:i",
    """SELECT recording_id, frame_number, unnest(['diameter', 'center', 'center', 'speed', 'quality']) AS panel,
         unnest(['diameter', 'x', 'y', 'speed', 'status']) AS series,
         unnest([estimated_pupil_diameter::DOUBLE, center_x_pixels, center_y_pixels, speed_pixels_per_second, code::DOUBLE]) AS value,
         tracking_status AS status, code AS status_code
       FROM (SELECT *, CASE tracking_status WHEN 'invalid' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS code FROM tracked) t""",
    TRACKING,
)
def plot_series(spark, sf_dir):
    return results.plot_series(_velocity(spark, sf_dir))


@query(
    "recording_id:i frames:i valid_frames:i warning_frames:i invalid_frames:i usable_fraction:d "
    "published_speeds:i min_diameter:d max_diameter:d",
    """SELECT recording_id, count(*) AS frames, count(*) FILTER (tracking_status = 'valid') AS valid_frames,
         count(*) FILTER (tracking_status = 'warning') AS warning_frames,
         count(*) FILTER (tracking_status = 'invalid') AS invalid_frames,
         count(*) FILTER (tracking_status <> 'invalid') / count(*) AS usable_fraction,
         count(speed_pixels_per_second) AS published_speeds, min(estimated_pupil_diameter) AS min_diameter,
         max(estimated_pupil_diameter) AS max_diameter FROM tracked GROUP BY recording_id""",
    TRACKING,
)
def status_summary(spark, sf_dir):
    return results.status_summary(_velocity(spark, sf_dir))


@query(
    "recording_id:i reason:s frames:i",
    """SELECT recording_id, reason, count(*) AS frames
       FROM (SELECT recording_id, unnest(string_split(quality_reason, ';')) AS reason FROM tracked) t
       WHERE reason <> '' GROUP BY ALL""",
    TRACKING,
)
def reason_counts(spark, sf_dir):
    return results.reason_counts(_velocity(spark, sf_dir))


# --- review data ------------------------------------------------------------------------


@query(
    "recording_id:i frame_number:i image_name:s speed_pixels_per_second:d",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY frame_number) AS place
         FROM tracked WHERE frame_number BETWEEN 200 AND 2100) t WHERE (place - 1) % 20 = 0""",
    TRACKING,
)
def review_sample(spark, sf_dir):
    return review.review_sample(_velocity(spark, sf_dir), 200, 2100, 20)


@query(
    "recording_id:i image_name:s",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY frame_number) AS place
         FROM tracked WHERE frame_number BETWEEN 200 AND 2100) t
       WHERE (place - 1) % 20 = 0 AND tracking_status = 'invalid'""",
    TRACKING,
)
def missing_overlays(spark, sf_dir):
    table = _velocity(spark, sf_dir)
    drawn = table.where(F.col("tracking_status") != "invalid")
    return review.missing_overlays(review.review_sample(table, 200, 2100, 20), drawn)


@query(
    "recording_id:i lower_limit:d upper_limit:d",
    """SELECT recording_id, coalesce(low - greatest((high - low) * 0.08e0, 0.5e0), 0) AS lower_limit,
         coalesce(high + greatest((high - low) * 0.08e0, 0.5e0), 1) AS upper_limit
       FROM (SELECT recording_id, least(min(center_x_pixels), min(center_y_pixels)) AS low,
               greatest(max(center_x_pixels), max(center_y_pixels)) AS high FROM tracked GROUP BY recording_id) t""",
    TRACKING,
)
def padded_limits(spark, sf_dir):
    return review.padded_limits(
        _velocity(spark, sf_dir), ["center_x_pixels", "center_y_pixels"], ["recording_id"]
    )


@query(
    "recording_id:i image_name:s shown:d shown_interval:d",
    """SELECT recording_id, image_name,
         CASE WHEN rej OR coalesce(lag(rej) OVER w, FALSE) OR coalesce(lead(rej) OVER w, FALSE) THEN raw_center_x_pixels END AS shown,
         CASE WHEN ri OR coalesce(lag(ri) OVER w, FALSE) OR coalesce(lead(ri) OVER w, FALSE) THEN estimated_pupil_diameter END AS shown_interval
       FROM (SELECT *, rej OR coalesce(lag(rej) OVER (PARTITION BY recording_id ORDER BY source_frame_index), FALSE) AS ri
             FROM (SELECT *, NOT segmentation_valid AS rej FROM measurements) a) b
       WINDOW w AS (PARTITION BY recording_id ORDER BY source_frame_index)""",
    (V.MEASUREMENTS_SQL,),
)
def diagnostic_segment(spark, sf_dir):
    rows = V.measurements(spark, sf_dir)
    rejected = ~F.col("segmentation_valid")
    return review.diagnostic_segments(
        rows, rejected, {"shown": ("raw_center_x_pixels", False), "shown_interval": ("estimated_pupil_diameter", True)}
    )
