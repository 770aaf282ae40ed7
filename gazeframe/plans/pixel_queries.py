"""Geometry, masks, components and overlays, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gazeframe.functions import geometry as G
from gazeframe.functions.columns import once
from gazeframe.operators import review, scoring
from gazeframe.operators import segmentation as seg
from gazeframe.operators import validation as val
from gazeframe.operators.augment import resize_with_pad as resize_op
from gazeframe.plans import analysis
from gazeframe.plans import stand_ins as V
from gazeframe.plans.frame_queries import _INDEXED as INDEXED
from gazeframe.plans.frame_queries import _STATUS, _VISIBILITY
from gazeframe.plans.registry import query
from gazeframe.session import scratch_path
from gazeframe.sources.images import image_scan as images_of
from gazeframe.sources.images import image_sizes as sizes_of

# --- geometry ---------------------------------------------------------------------------

_SCALED = """
sized AS (SELECT *, CASE WHEN w >= h THEN 148 ELSE round_even(w * 148 / h, 0)::BIGINT END AS resized_width,
    CASE WHEN w >= h THEN round_even(h * 148 / w, 0)::BIGINT ELSE 148 END AS resized_height FROM image_sizes),
scaled AS (SELECT *, resized_width / w AS scale_x, resized_height / h AS scale_y,
    floor((148 - resized_width) / 2)::BIGINT AS pad_left, floor((148 - resized_height) / 2)::BIGINT AS pad_top FROM sized)"""
SCALING = (V.IMAGE_SIZES_SQL, _SCALED)


@query(
    "image_id:i scale_x:d scale_y:d pad_left:i pad_top:i resized_width:i resized_height:i",
    "SELECT * FROM scaled",
    SCALING,
)
def resize_scale(spark, sf_dir):
    sizes = V.image_sizes(spark, sf_dir)
    return sizes.withColumn("g", G.resize_scale(F.col("w"), F.col("h"))).select("image_id", "g.*")


@query(
    "image_id:i x:d y:d",
    """SELECT image_id, CASE WHEN scale_x > 0 AND scale_y > 0 THEN (cx - pad_left) / scale_x END AS x,
         CASE WHEN scale_x > 0 AND scale_y > 0 THEN (cy - pad_top) / scale_y END AS y FROM scaled""",
    SCALING,
)
def model_to_original(spark, sf_dir):
    point = G.model_to_original(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    return V.image_sizes(spark, sf_dir).withColumn("p", point).select("image_id", "p.*")


@query(
    "image_id:i input_length:d",
    "SELECT image_id, CASE WHEN scale_x * scale_y > 0 THEN cx / sqrt(scale_x * scale_y) END AS input_length FROM scaled",
    SCALING,
)
def model_to_input_length(spark, sf_dir):
    length = G.model_to_input_length(F.col("cx"), F.col("w"), F.col("h"))
    return V.image_sizes(spark, sf_dir).select("image_id", length.alias("input_length"))


_RESHAPED = f"""
shaped AS (SELECT *, CASE frame_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 16 END AS w,
    CASE frame_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 4 END AS h FROM grey),
source AS (SELECT frame_id, w, h, i % w AS sx, i // w AS sy, g FROM shaped),
shapes AS (SELECT DISTINCT frame_id, w, h, CASE WHEN w >= h THEN 12 ELSE round_even(w * 12 / h, 0)::BIGINT END AS rw,
    CASE WHEN w >= h THEN round_even(h * 12 / w, 0)::BIGINT ELSE 12 END AS rh FROM shaped),
xs AS (SELECT frame_id, o AS xo, s AS sx, greatest(0, 1 - abs((s + 0.5e0 - (o + 0.5e0) * (w / rw)) / greatest(w / rw, 1))) AS wx
  FROM (SELECT frame_id, w, rw, unnest(range(rw)) AS o FROM shapes) a, (SELECT unnest(range(16)) AS s) b WHERE s < w),
ys AS (SELECT frame_id, o AS yo, s AS sy, greatest(0, 1 - abs((s + 0.5e0 - (o + 0.5e0) * (h / rh)) / greatest(h / rh, 1))) AS wy
  FROM (SELECT frame_id, h, rh, unnest(range(rh)) AS o FROM shapes) a, (SELECT unnest(range(16)) AS s) b WHERE s < h),
wide AS (SELECT frame_id, xo, sy, floor(round(sum(g * wx) / sum(wx), 6) + 0.5e0) AS v
  FROM source JOIN xs USING (frame_id, sx) GROUP BY ALL),
small AS (SELECT frame_id, xo, yo, floor(round(sum(v * wy) / sum(wy), 6) + 0.5e0)::BIGINT AS v
  FROM wide JOIN ys USING (frame_id, sy) GROUP BY ALL),
near AS (SELECT s.frame_id, xo, yo, g AS v FROM shapes s, (SELECT unnest(range(12)) AS xo) a, (SELECT unnest(range(12)) AS yo) b, source q
  WHERE xo < rw AND yo < rh AND q.frame_id = s.frame_id AND q.sx = floor((xo + 0.5e0) * s.w / rw) AND q.sy = floor((yo + 0.5e0) * s.h / rh)),
board AS (SELECT s.*, unnest(range(144)) AS i, (12 - rw) // 2 AS pl, (12 - rh) // 2 AS pt FROM shapes s)"""


@query(
    "frame_id:i i:i smooth:i nearest:i",
    """SELECT b.frame_id, b.i, coalesce(s.v, 0) AS smooth, coalesce(n.v, 0) AS nearest FROM board b
       LEFT JOIN small s ON s.frame_id = b.frame_id AND s.xo = b.i % 12 - pl AND s.yo = b.i // 12 - pt
       LEFT JOIN near n ON n.frame_id = b.frame_id AND n.xo = b.i % 12 - pl AND n.yo = b.i // 12 - pt""",
    (V.GREY_SQL, _RESHAPED),
)
def resize_with_pad(spark, sf_dir):
    case = F.col("frame_id") % 3
    shaped = (
        V.grey(spark, sf_dir)
        .withColumn("w", F.when(case == 0, 8).when(case == 1, 4).otherwise(16))
        .withColumn("h", F.when(case == 0, 8).when(case == 1, 16).otherwise(4))
    )
    both = resize_op(shaped, "image", "w", "h", 12, True, "smooth")
    both = resize_op(both, "image", "w", "h", 12, False, "nearest")
    return both.select("frame_id", F.posexplode(F.arrays_zip("smooth", "nearest")).alias("i", "v")).select(
        "frame_id", "i", "v.*"
    )


@query(
    "frame_id:i i:i level:d mask:i",
    "SELECT frame_id, i, g / 255 AS level, t AS mask FROM grey JOIN targets USING (frame_id, i)",
    (V.GREY_SQL, V.TARGETS_SQL),
)
def normalise_pixels(spark, sf_dir):
    images = V.grey(spark, sf_dir).select(
        "frame_id",
        G.normalise_bytes(F.col("image")).alias("level"),
        G.binary_mask(F.col("mask")).alias("mask"),
    )
    return images.select("frame_id", F.posexplode(F.arrays_zip("level", "mask")).alias("i", "v")).select(
        "frame_id", "i", "v.*"
    )


@query(
    "recording_id:s image_name:s original_width:i original_height:i i:i level:i",
    """SELECT concat('set ', frame_id // 100) AS recording_id, concat('eye_', printf('%05d', frame_id % 100 + 1), '.png') AS image_name,
         8 AS original_width, 8 AS original_height, i, g AS level FROM grey""",
    (V.GREY_SQL,),
)
def image_scan(spark, sf_dir):
    """Image files written and scanned back, with a space in each folder's name."""
    folder = scratch_path(spark, "grey-files")
    V.write_grey_files(spark, sf_dir, folder)
    seen = images_of(spark, f"{folder}/*", folder)
    return seen.select("*", F.posexplode("pixels").alias("i", "level"))


@query(
    "recording_id:s image_name:s original_width:i original_height:i scale_x:d resized_width:i resized_height:i pad_top:i",
    """SELECT DISTINCT concat('set ', frame_id // 100) AS recording_id, concat('eye_', printf('%05d', frame_id % 100 + 1), '.png') AS image_name,
         8 AS original_width, 8 AS original_height, 148 / 8 AS scale_x, 148 AS resized_width, 148 AS resized_height, 0 AS pad_top FROM grey""",
    (V.GREY_SQL,),
)
def image_sizes(spark, sf_dir):
    """Sizes of written image files from their headers, and the scale of each."""
    folder = scratch_path(spark, "grey-files")
    V.write_grey_files(spark, sf_dir, folder)
    sizes = sizes_of(spark, f"{folder}/*", folder)
    scale = G.resize_scale(F.col("original_width"), F.col("original_height"))
    return sizes.withColumn("g", scale).select("*", "g.*")


# --- scoring ----------------------------------------------------------------------------


def _contrast_scorer():
    """A stand-in for a model, for checking only: dark pixels score high."""
    return lambda batch: (np.float32(0.5) - batch) * np.float32(16)


@query(
    "frame_id:i i:i p:d",
    "SELECT frame_id, i, 1 / (1 + exp(-((0.5e0 - (g / 256)) * 16))) AS p FROM grey",
    (V.GREY_SQL,),
)
def score_frames(spark, sf_dir):
    frames = V.grey(spark, sf_dir).select(
        "frame_id", F.transform("image", lambda v: (v / 256.0).cast("float")).alias("model_image")
    )
    maps = scoring.score_frames(frames, _contrast_scorer, 8)
    return maps.select("frame_id", F.posexplode("prob").alias("i", "p"))


_AREA = "SELECT frame_id, count(*) FILTER (p > 0.7e0) AS a FROM pixels GROUP BY frame_id"


@query(
    "frame_id:i foreground_area:i estimated_pupil_diameter:d",
    f"SELECT frame_id, a AS foreground_area, sqrt(4 / pi() * a) AS estimated_pupil_diameter FROM ({_AREA}) s",
    (V.PIXELS_SQL,),
)
def binarize_area_diameter(spark, sf_dir):
    return seg.binarize_area_diameter(V.maps(spark, sf_dir), 0.7)


@query(
    "frame_id:i estimated_pupil_diameter:d",
    f"SELECT frame_id, sqrt(4 / pi() * a) AS estimated_pupil_diameter FROM ({_AREA}) s",
    (V.PIXELS_SQL,),
)
def diameter_results(spark, sf_dir):
    return scoring.diameter_results(V.maps(spark, sf_dir), 0.7, ["frame_id"])


# --- components -------------------------------------------------------------------------


def component_ctes(foreground: str, model: int = 148) -> str:
    """Component measurements of the pixels chosen by ``foreground``, pixel by pixel."""
    return f"""
fg AS (SELECT frame_id, y, x, p FROM ({foreground}) f),
walk AS (SELECT frame_id, 8 * y + x AS src, y, x FROM fg
  UNION SELECT w.frame_id, w.src, f.y, f.x FROM walk w JOIN fg f
    ON f.frame_id = w.frame_id AND abs(f.y - w.y) <= 1 AND abs(f.x - w.x) <= 1),
comp AS (SELECT frame_id, y, x, min(src) AS comp FROM walk GROUP BY ALL),
areas AS (SELECT frame_id, comp, count(*) AS area FROM comp GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, comp) = 1 AS selected FROM areas),
chosen AS (SELECT c.frame_id, c.y, c.x, f.p FROM comp c JOIN ranked r USING (frame_id, comp)
  JOIN fg f USING (frame_id, y, x) WHERE r.selected),
{border_ctes('chosen')},
shape AS (SELECT frame_id, count(*) AS area, avg(p) AS conf, sum(p) AS sp, sum(x * p) AS sxp, sum(y * p) AS syp, avg(x) AS ax, avg(y) AS ay,
    bool_or(y IN (0, 7) OR x IN (0, 7)) AS touches FROM chosen GROUP BY frame_id),
totals AS (SELECT frame_id, sum(area)::BIGINT AS fg_area, count(*) AS parts FROM areas GROUP BY frame_id),
sizes AS (SELECT DISTINCT frame_id, original_width AS w, original_height AS h FROM pixels),
evidence AS (SELECT z.frame_id, w, h, coalesce(area, 0) AS selected_component_area, coalesce(fg_area, 0) AS foreground_area,
    coalesce(parts, 0) AS component_count, area / fg_area AS component_dominance, conf AS mean_component_confidence,
    CASE WHEN area IS NULL THEN NULL WHEN coalesce(border, 0) > 0 THEN 4 * pi() * area / (border * border) ELSE 0 END
      AS component_circularity,
    coalesce(touches, FALSE) AS component_touches_border,
    CASE WHEN sp > 0 THEN sxp / sp ELSE ax END AS raw_center_x_model_pixels,
    CASE WHEN sp > 0 THEN syp / sp ELSE ay END AS raw_center_y_model_pixels
  FROM sizes z LEFT JOIN shape USING (frame_id) LEFT JOIN totals USING (frame_id) LEFT JOIN borders USING (frame_id)),
judged AS (SELECT *, CASE WHEN component_count = 0 THEN 'empty_mask' ELSE concat_ws(';',
      CASE WHEN component_dominance < 0.8e0 THEN 'low_component_dominance' END,
      CASE WHEN mean_component_confidence < 0.9e0 THEN 'low_component_confidence' END,
      CASE WHEN component_circularity < 0.45e0 THEN 'low_component_circularity' END,
      CASE WHEN component_touches_border THEN 'component_touches_border' END) END AS quality_reason,
    component_count > 0 AND NOT (mean_component_confidence < 0.9e0 OR component_circularity < 0.45e0
      OR component_touches_border) AS segmentation_valid FROM evidence),
fitted AS (SELECT *, CASE WHEN w >= h THEN 8 ELSE round_even(w * 8 / h, 0)::BIGINT END AS rw,
    CASE WHEN w >= h THEN round_even(h * 8 / w, 0)::BIGINT ELSE 8 END AS rh,
    CASE WHEN w >= h THEN {model} ELSE round_even(w * {model} / h, 0)::BIGINT END AS mw,
    CASE WHEN w >= h THEN round_even(h * {model} / w, 0)::BIGINT ELSE {model} END AS mh FROM judged),
measured AS (SELECT *, (raw_center_x_model_pixels - (8 - rw) // 2) / (rw / w) AS raw_center_x_pixels,
    (raw_center_y_model_pixels - (8 - rh) // 2) / (rh / h) AS raw_center_y_pixels,
    sqrt(4 / pi() * foreground_area) AS estimated_pupil_diameter,
    sqrt(4 / pi() * foreground_area) / sqrt(mw / w * (mh / h)) AS pupil_diameter_input_pixels,
    {_VISIBILITY} AS pupil_visibility FROM fitted)"""


def border_ctes(mask: str) -> str:
    """Outer border length: holes are what the outside cannot reach by pixel edges, and the
    length is read off all 2x2 windows of the filled mask."""
    return f"""grid AS (SELECT frame_id, y, x FROM (SELECT DISTINCT frame_id FROM {mask}) k,
  (SELECT unnest(range(-1, 9)) AS y) ys, (SELECT unnest(range(-1, 9)) AS x) xs),
background AS (SELECT * FROM grid ANTI JOIN {mask} USING (frame_id, y, x)),
outside AS (SELECT frame_id, y, x FROM background WHERE y = -1 AND x = -1
  UNION SELECT b.frame_id, b.y, b.x FROM outside o JOIN background b
    ON b.frame_id = o.frame_id AND abs(b.y - o.y) + abs(b.x - o.x) = 1),
solid AS (SELECT * FROM grid ANTI JOIN outside USING (frame_id, y, x)),
windows AS (SELECT frame_id, y - dy AS wy, x - dx AS wx, sum(1 << (2 * dy + dx))::BIGINT AS code
  FROM solid, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dy, dx) GROUP BY ALL),
borders AS (SELECT frame_id, sum(CASE WHEN code IN (3, 5, 10, 12) THEN 1 WHEN code IN (7, 11, 13, 14) THEN sqrt(2)
    WHEN code IN (6, 9) THEN 2 * sqrt(2) ELSE 0 END) AS border FROM windows GROUP BY frame_id)"""


COMPONENTS = (V.PIXELS_SQL, component_ctes("SELECT * FROM pixels WHERE p > 0.7e0"))
SUPPLIED = (
    V.PIXELS_SQL,
    V.TARGETS_SQL,
    component_ctes("SELECT p.* FROM pixels p JOIN targets t USING (frame_id, y, x) WHERE t.t > 0"),
)


@query("frame_id:i first_pixel:i area:i selected:b", "SELECT *, comp AS first_pixel FROM ranked", COMPONENTS)
def connected_components(spark, sf_dir):
    return seg.connected_components(V.maps(spark, sf_dir), 0.7, ["frame_id"])


@query(
    "frame_id:i first_pixel:i area:i",
    "SELECT frame_id, comp AS first_pixel, area FROM ranked WHERE selected",
    COMPONENTS,
)
def largest_component(spark, sf_dir):
    return seg.connected_components(V.maps(spark, sf_dir), 0.7, ["frame_id"]).where("selected")


def _evidence(spark, sf_dir):
    return seg.component_evidence(V.maps(spark, sf_dir), 0.7)


@query(
    "frame_id:i raw_center_x_model_pixels:d raw_center_y_model_pixels:d", "SELECT * FROM evidence", COMPONENTS
)
def weighted_centroid(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query("frame_id:i component_touches_border:b", "SELECT * FROM evidence", COMPONENTS)
def border_contact(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query("frame_id:i component_circularity:d", "SELECT * FROM evidence", COMPONENTS)
def circularity(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query(
    "frame_id:i component_dominance:d mean_component_confidence:d", "SELECT * FROM evidence", COMPONENTS
)
def dominance_confidence(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query("frame_id:i quality_reason:s segmentation_valid:b", "SELECT * FROM judged", COMPONENTS)
def quality_flags(spark, sf_dir):
    return seg.judge_components(_evidence(spark, sf_dir))


@query("frame_id:i pupil_visibility:s", "SELECT * FROM measured", COMPONENTS)
def pupil_visibility(spark, sf_dir):
    return seg.judge_components(_evidence(spark, sf_dir))


MEASURED = (
    "frame_id:i selected_component_area:i foreground_area:i component_count:i component_dominance:d "
    "mean_component_confidence:d component_circularity:d component_touches_border:b "
    "raw_center_x_model_pixels:d raw_center_y_model_pixels:d raw_center_x_pixels:d "
    "raw_center_y_pixels:d estimated_pupil_diameter:d pupil_diameter_input_pixels:d "
    "segmentation_valid:b quality_reason:s pupil_visibility:s"
)


@query(MEASURED, "SELECT * FROM measured", COMPONENTS)
def measure_frames(spark, sf_dir):
    return seg.measure_frames(V.maps(spark, sf_dir), 0.7)


@query(MEASURED, "SELECT * FROM measured", SUPPLIED)
def measure_supplied_mask(spark, sf_dir):
    source = V.table(spark, sf_dir, "embeddings")
    maps = V.maps_of(source, F.expr(V._TARGET).alias("mask"))
    return seg.measure_frames(maps, 0.99, mask="mask")


# --- the whole flow ---------------------------------------------------------------------


def _recorded(maps):
    """Frames as recordings of a hundred frames."""
    return (
        maps.withColumn("recording_id", F.expr("frame_id div 100"))
        .withColumn("source_frame_index", F.col("frame_id") % 100)
        .withColumn("image_name", F.format_string("eye_%05d.png", F.col("source_frame_index") + 1))
    )


@query(
    "recording_id:i frame_number:i image_name:s estimated_pupil_diameter:d "
    "pupil_diameter_input_pixels:d pupil_visibility:s segmentation_status:s quality_reason:s",
    f"""SELECT *, frame_id // 100 AS recording_id, frame_id % 100 + 1 AS frame_number,
          concat('eye_', printf('%05d', frame_id % 100 + 1), '.png') AS image_name, {_STATUS} AS segmentation_status
        FROM measured""",
    COMPONENTS,
)
def run_analysis_diameter(spark, sf_dir):
    return analysis.analyze_maps(_recorded(V.maps(spark, sf_dir)), 0.7).table


@query(
    "recording_id:i frame_number:i image_name:s estimated_pupil_diameter:d pupil_diameter_input_pixels:d "
    "pupil_visibility:s timestamp_seconds:d center_x_pixels:d center_y_pixels:d "
    "speed_pixels_per_second:d tracking_status:s quality_reason:s",
    f"""SELECT *, n + 1 AS frame_number, n / 10 AS timestamp_seconds, concat('eye_', printf('%05d', n + 1), '.png') AS image_name,
          CASE WHEN lag(segmentation_valid) OVER w AND segmentation_valid THEN
            sqrt(pow((center_x_pixels - lag(center_x_pixels) OVER w) / (n / 10 - lag(n / 10) OVER w), 2)
               + pow((center_y_pixels - lag(center_y_pixels) OVER w) / (n / 10 - lag(n / 10) OVER w), 2)) END AS speed_pixels_per_second,
          {_STATUS} AS tracking_status
        FROM frames WINDOW w AS (PARTITION BY recording_id ORDER BY n)""",
    (
        *COMPONENTS,
        """
numbered AS (SELECT *, frame_id // 100 AS recording_id, frame_id % 100 AS n FROM measured),
nearby AS (SELECT a.frame_id, median(b.selected_component_area) AS med FROM numbered a JOIN numbered b
  ON a.recording_id = b.recording_id AND abs(a.n - b.n) <= 5 AND a.n <> b.n
  WHERE a.segmentation_valid AND b.segmentation_valid GROUP BY a.frame_id HAVING count(*) >= 4),
frames AS (SELECT m.* EXCLUDE (quality_reason),
    CASE WHEN selected_component_area / med < 0.65e0 OR selected_component_area / med > 2
      THEN concat_ws(';', nullif(quality_reason, ''), 'abrupt_area_change') ELSE quality_reason END AS quality_reason,
    CASE WHEN segmentation_valid THEN raw_center_x_pixels END AS center_x_pixels,
    CASE WHEN segmentation_valid THEN raw_center_y_pixels END AS center_y_pixels
  FROM numbered m LEFT JOIN nearby USING (frame_id))""",
    ),
)
def run_analysis_velocity(spark, sf_dir):
    maps = _recorded(V.maps(spark, sf_dir))
    return analysis.analyze_maps(maps, 0.7, True, 10.0).table


# The stand-in scorer over grey images of the scorer's own size, in its single precision.
SCORED = (
    V.GREY_SQL,
    """
pixels AS (SELECT frame_id, y, x, i, 8 AS original_width, 8 AS original_height,
    1 / (1 + exp(-(((0.5::FLOAT - (g / 255)::FLOAT) * 16::FLOAT)::DOUBLE))) AS p FROM grey)""",
    component_ctes("SELECT * FROM pixels WHERE p > 0.7e0", model=8),
)
_SHOWN = """
shown AS (SELECT recording_id, image_name, doc_id % (SELECT count(*) FROM embeddings) AS frame_id FROM image_files)"""


def _grey_images(spark, sf_dir, files):
    """Files with a ``frame_id``, each showing that grey image."""
    return files.join(V.grey(spark, sf_dir), "frame_id").select(
        *[c for c in files.columns if c != "frame_id"],
        F.col("image").alias("pixels"),
        F.lit(8).alias("original_width"),
        F.lit(8).alias("original_height"),
    )


@query(
    "recording_id:i frame_number:i image_name:s estimated_pupil_diameter:d "
    "pupil_diameter_input_pixels:d pupil_visibility:s segmentation_status:s quality_reason:s",
    f"""SELECT *, source_frame_index + 1 AS frame_number, {_STATUS} AS segmentation_status
        FROM shown JOIN indexed USING (recording_id, image_name) JOIN measured USING (frame_id)""",
    (V.IMAGE_FILES_SQL, INDEXED, _SHOWN, *SCORED),
)
def run_analysis_images(spark, sf_dir):
    """Files of every folder through the whole flow; every grey image is shown as often as files come round."""
    count = V.table(spark, sf_dir, "embeddings").count()
    files = V.image_files(spark, sf_dir)
    shown = files.select("recording_id", "image_name", (F.col("doc_id") % count).alias("frame_id"))
    images = _grey_images(spark, sf_dir, shown)
    return analysis.analyze_frames(images, _contrast_scorer, size=8, listing=files).table


@query(
    "recording_id:s frame_number:i image_name:s timestamp_seconds:d center_x_pixels:d center_y_pixels:d "
    "speed_pixels_per_second:d tracking_status:s",
    f"""SELECT *, n + 1 AS frame_number, n / fps AS timestamp_seconds, CASE WHEN lag(segmentation_valid) OVER w AND segmentation_valid THEN
            sqrt(pow((center_x_pixels - lag(center_x_pixels) OVER w) / (n / fps - lag(n / fps) OVER w), 2)
               + pow((center_y_pixels - lag(center_y_pixels) OVER w) / (n / fps - lag(n / fps) OVER w), 2)) END AS speed_pixels_per_second,
          {_STATUS} AS tracking_status FROM frames WINDOW w AS (PARTITION BY recording_id ORDER BY n)""",
    (
        *SCORED,
        """
filmed AS (SELECT concat('cam', s_suppkey) AS recording_id, n, (s_suppkey * 7 + n) % (SELECT count(*) FROM embeddings) AS frame_id,
    concat('cam', s_suppkey, '_', printf('%05d', n + 1), '.png') AS image_name,
    CASE WHEN s_suppkey % 3 = 0 THEN 10 ELSE 5 + s_suppkey % 20 END::DOUBLE AS fps
  FROM (SELECT *, unnest(range(1 + s_suppkey % 30)) AS n FROM supplier) s),
numbered AS (SELECT * FROM filmed JOIN measured USING (frame_id)),
nearby AS (SELECT a.recording_id, a.n, median(b.selected_component_area) AS med FROM numbered a JOIN numbered b
  ON a.recording_id = b.recording_id AND abs(a.n - b.n) <= greatest(1, round_even(a.fps * 0.5e0, 0)) AND a.n <> b.n
  WHERE a.segmentation_valid AND b.segmentation_valid GROUP BY ALL HAVING count(*) >= 4),
frames AS (SELECT m.* EXCLUDE (quality_reason),
    CASE WHEN selected_component_area / med < 0.65e0 OR selected_component_area / med > 2
      THEN concat_ws(';', nullif(quality_reason, ''), 'abrupt_area_change') ELSE quality_reason END AS quality_reason,
    CASE WHEN segmentation_valid THEN raw_center_x_pixels END AS center_x_pixels,
    CASE WHEN segmentation_valid THEN raw_center_y_pixels END AS center_y_pixels
  FROM numbered m LEFT JOIN nearby USING (recording_id, n))""",
    ),
)
def run_analysis_videos(spark, sf_dir):
    """Videos with an acquisition rate of their own, or none; a cap does not cut a velocity run."""
    count = V.table(spark, sf_dir, "embeddings").count()
    key = F.col("s_suppkey")
    cameras = V.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("cam"), key).alias("video_name"))
    videos = cameras.select(
        "video_name",
        (1 + key % 30).alias("frame_count"),
        (5 + key % 20).cast("double").alias("encoded_fps"),
        F.when(key % 3 == 0, 10.0).alias("acquisition_fps"),
        F.lit(5.0).alias("extraction_fps"),
        F.when(key % 4 == 0, 3).alias("max_frames"),
        F.lit(False).alias("extract_all"),
    )
    n = F.col("n")
    # One image more than the video has frames.
    files = cameras.withColumn("n", F.explode(F.sequence(F.lit(0), (1 + key % 30).cast("int")))).select(
        F.col("video_name").alias("recording_id"),
        F.format_string("%s_%05d.png", "video_name", n + 1).alias("image_name"),
        ((key * 7 + n) % count).alias("frame_id"),
    )
    # Spark sizes the files by their cameras: it would broadcast every one of them, or score them in a few large tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    images = _grey_images(spark, sf_dir, files.repartition(tasks, "frame_id").hint("merge"))
    return analysis.analyze_videos(videos, images, _contrast_scorer, 0.7, True, size=8).table


_SINGLE = """
singles AS (SELECT frame_id, i, t, threshold, CASE WHEN i % 5 = 0 THEN 0.6e0 WHEN i % 7 = 0 THEN 0.7e0 ELSE p END::FLOAT AS p
  FROM pixels JOIN targets USING (frame_id, i), (VALUES (0.6e0), (0.7e0)) AS c(threshold)),
counted AS (SELECT frame_id, threshold, count(*) FILTER (p > threshold::FLOAT) AS a, sum(t)::BIGINT AS t,
    count(*) FILTER (p > threshold::FLOAT AND t > 0) AS met,
    sum(CASE WHEN p > threshold::FLOAT THEN least(255, greatest(1, round_even((p::DOUBLE - threshold) / (1e0 - threshold) * 254, 0) + 1)) ELSE 0 END)::BIGINT AS codes
  FROM singles GROUP BY ALL),
rated AS (SELECT *, CASE WHEN a + t - met > 0 THEN met / (a + t - met + 1e-6) ELSE 1 END AS iou FROM counted)"""
SINGLE = (V.PIXELS_SQL, V.TARGETS_SQL, _SINGLE)


def _coder(threshold):
    return lambda p: review.encode_confidence(p, threshold, single=True)


def _single_maps(spark, sf_dir):
    """Single-precision maps with values on the thresholds."""
    on = F.transform("prob", lambda p, i: F.when(i % 5 == 0, 0.6).when(i % 7 == 0, 0.7).otherwise(p).cast("float"))
    return once(V.labelled_maps(spark, sf_dir), prob=on)


@query(
    "frame_id:i threshold:d foreground_area:i estimated_pupil_diameter:d iou:d codes:i",
    "SELECT *, a AS foreground_area, sqrt(4 / pi() * a) AS estimated_pupil_diameter FROM rated",
    SINGLE,
)
def single_precision_maps(spark, sf_dir):
    maps = _single_maps(spark, sf_dir)
    parts = []
    for t in (0.6, 0.7):
        code = F.transform("prob", _coder(t))
        scored = val.overlap_scores(maps, t).withColumn("codes", F.aggregate(code, F.lit(0), lambda s, c: s + c))
        sized = seg.binarize_area_diameter(scored, t).select("frame_id", "foreground_area", "iou", "codes")
        plain = scoring.diameter_results(maps, t, ["frame_id"])
        parts.append(sized.join(plain, "frame_id").withColumn("threshold", F.lit(t)))
    return parts[0].unionByName(parts[1])


@query(
    "threshold:d macro_iou:d",
    "SELECT threshold, avg(iou) AS macro_iou FROM rated GROUP BY threshold",
    SINGLE,
)
def single_precision_sweep(spark, sf_dir):
    return val.threshold_sweep(_single_maps(spark, sf_dir), "frame_id", (0.6, 0.7), 2.0, 3.0)


# --- overlays ---------------------------------------------------------------------------

_CODES = """
codes AS (SELECT *, CASE WHEN p > 0.7e0 THEN least(255, greatest(1,
    round_even((p - 0.7e0) / (1e0 - 0.7e0) * 254, 0) + 1))::BIGINT ELSE 0 END AS confidence FROM pixels),
colours AS (SELECT *, 255 AS r, 0 AS b, least(255, greatest(0, round_even(
    CASE WHEN (confidence - 1) / 254 <= 0.5e0 THEN 255 - 180 * ((confidence - 1) / 254)
         ELSE 330 * (1 - (confidence - 1) / 254) END, 0)))::BIGINT AS g FROM codes),
tinted AS (SELECT c.frame_id, c.i, c.x, c.y,
    CASE WHEN confidence > 0 THEN floor((1 - 0.1e0) * q.g + 0.1e0 * c.r) ELSE q.g END::BIGINT AS r,
    CASE WHEN confidence > 0 THEN floor((1 - 0.1e0) * q.g + 0.1e0 * c.g) ELSE q.g END::BIGINT AS g,
    CASE WHEN confidence > 0 THEN floor((1 - 0.1e0) * q.g + 0.1e0 * c.b) ELSE q.g END::BIGINT AS b
  FROM colours c JOIN grey q USING (frame_id, i))"""


def _coded(spark, sf_dir):
    return V.grey_maps(spark, sf_dir).withColumn(
        "confidence", F.transform("prob", lambda p: review.encode_confidence(p, 0.7))
    )


@query("frame_id:i i:i confidence:i", "SELECT * FROM codes", (V.PIXELS_SQL, V.GREY_SQL, _CODES))
def encode_confidence(spark, sf_dir):
    return _coded(spark, sf_dir).select("frame_id", F.posexplode("confidence").alias("i", "confidence"))


@query(
    "frame_id:i i:i r:i g:i b:i",
    "SELECT frame_id, i, r, g, b FROM colours WHERE confidence > 0",
    (V.PIXELS_SQL, V.GREY_SQL, _CODES),
)
def confidence_color(spark, sf_dir):
    pixels = encode_confidence(spark, sf_dir).where("confidence > 0")
    return pixels.select("frame_id", "i", review.confidence_color(F.col("confidence")).alias("c")).select(
        "frame_id", "i", "c.*"
    )


def _pixels_of(df):
    return df.select("frame_id", F.posexplode("overlay").alias("i", "c")).select("frame_id", "i", "c.*")


@query("frame_id:i i:i r:i g:i b:i", "SELECT * FROM tinted", (V.PIXELS_SQL, V.GREY_SQL, _CODES))
def blend_overlay(spark, sf_dir):
    return _pixels_of(review.blend_overlay(_coded(spark, sf_dir), "grey", "confidence"))


@query(
    "frame_id:i i:i r:i g:i b:i",
    """SELECT frame_id, i, CASE WHEN lit THEN floor(r + 0.35e0 * (mr - r)) ELSE r END AS r,
         CASE WHEN lit THEN floor(g + 0.35e0 * (255 - g)) ELSE g END AS g,
         CASE WHEN lit THEN floor(b + 0.35e0 * (mb - b)) ELSE b END AS b
       FROM (SELECT t.*, CASE WHEN segmentation_valid THEN 0 ELSE 255 END AS mr,
               CASE WHEN segmentation_valid THEN 255 ELSE 0 END AS mb,
               coalesce((y = trunc(cy) AND x BETWEEN trunc(cx - 3) AND trunc(cx + 3))
                 OR (x = trunc(cx) AND y BETWEEN trunc(cy - 3) AND trunc(cy + 3)), FALSE) AS lit
             FROM tinted t JOIN (SELECT frame_id, segmentation_valid, round(raw_center_x_model_pixels, 6) AS cx,
                                        round(raw_center_y_model_pixels, 6) AS cy FROM judged) j USING (frame_id)) u""",
    (*COMPONENTS, V.GREY_SQL, _CODES),
)
def center_marker(spark, sf_dir):
    measured = seg.measure_frames(V.grey_maps(spark, sf_dir), 0.7, keep_map=True)
    return _pixels_of(analysis.overlay_frames(measured, 0.7))
