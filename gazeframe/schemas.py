"""Table layouts and the fixed numbers of the measurement rules.

Missing values are NULL throughout. Three grains are used: one row per frame, one row per
frame with its probability map as a flat row-major array, one row per measured frame.
"""

from pyspark.sql import types as T

# Fixed values of the measurement and quality rules.
MODEL_SIZE = 148
DEFAULT_THRESHOLD = 0.7
MIN_DOMINANCE = 0.80
MIN_CONFIDENCE = 0.90
MIN_CIRCULARITY = 0.45
MIN_AREA_RATIO = 0.65
MAX_AREA_RATIO = 2.00
AREA_WINDOW_SECONDS = 0.50
MIN_NEIGHBOURS = 4
THRESHOLD_CANDIDATES = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)
TINY_MAX_DIAMETER = 15.0
LARGE_MIN_DIAMETER = 80.0
SIZE_BINS = ("tiny", "medium", "large")
STATUS_CODES = {"invalid": 0, "warning": 1, "valid": 2}

# Fixed layouts of the output tables and of files read from outside.
DIAMETER_COLUMNS = [
    "image_name",
    "estimated_pupil_diameter",
    "pupil_diameter_input_pixels",
    "pupil_visibility",
    "segmentation_status",
    "quality_reason",
]

VELOCITY_COLUMNS = [
    "image_name",
    "estimated_pupil_diameter",
    "pupil_diameter_input_pixels",
    "pupil_visibility",
    "timestamp_seconds",
    "center_x_pixels",
    "center_y_pixels",
    "speed_pixels_per_second",
    "tracking_status",
    "quality_reason",
]

MANIFEST = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "category",
            "split",
            "image_path",
            "mask_path",
            "source_recording",
            "source_frame_suffix",
            "acquisition_fps_hz",
            "transformation",
        )
    ]
)

CHECKPOINT_METADATA = T.StructType(
    [
        T.StructField("run_name", T.StringType()),
        T.StructField("prediction_threshold", T.DoubleType()),
        T.StructField("best_epoch", T.LongType()),
        T.StructField("balanced_iou", T.DoubleType()),
        T.StructField("macro_iou", T.DoubleType()),
        T.StructField("macro_dice", T.DoubleType()),
        T.StructField("size_iou", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("low_circularity_iou", T.DoubleType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("meets_promotion_target", T.BooleanType()),
        T.StructField("config", T.StringType()),
    ]
)

TRACKING_INPUT = (
    "source_frame_index",
    "raw_center_x_pixels",
    "raw_center_y_pixels",
    "selected_component_area",
    "segmentation_valid",
    "quality_reason",
)
