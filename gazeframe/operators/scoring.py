"""Running a caller's model over frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeframe.functions.columns import once, require_columns
from gazeframe.operators.segmentation import binarize_area_diameter
from gazeframe.session import small_batches

Scorer = Callable[[np.ndarray], np.ndarray]
_BATCH_BYTES = 64 << 20


def score_frames(
    frames: DataFrame,
    load_scorer: Callable[[], Scorer],
    size: int,
    batch_size: int = 32,
    strict: bool = False,
) -> DataFrame:
    """Adds ``prob``, ``map_height`` and ``map_width`` to frames holding ``model_image``.

    ``load_scorer`` runs once per task, so a model is loaded once; the scorer it returns maps
    a (n, size, size) batch to logits of the same shape. Only the image crosses to Python, as single-precision numbers
    in one buffer, some 60 MB at once: the sigmoid is a column expression. An image that is missing or of another size fails the job.
    """
    require_columns(frames, ["model_image"], "Frames")
    if batch_size <= 0:
        raise ValueError("batch_size must be positive.")
    if strict and frames.isEmpty():
        raise FileNotFoundError("No frames to score.")
    carried = [f for f in frames.schema.fields if f.name != "model_image"]
    schema = T.StructType([*carried, T.StructField("logit", T.ArrayType(T.FloatType()))])
    names = [f.name for f in carried]
    small_batches(frames.sparkSession, max(1, _BATCH_BYTES // (4 * size * size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load_scorer()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                images = part.column("model_image")
                wrong = pc.any(pc.not_equal(images.value_lengths(), size * size)).as_py()
                if wrong or images.null_count:
                    raise ValueError(f"A model image must have {size} x {size} levels.")
                # A copy of its own, as scorers may write into their input.
                stack = np.array(images.flatten(), dtype=np.float32).reshape(-1, size, size)
                logits = np.asarray(scorer(stack), dtype=np.float32).reshape(part.num_rows, -1)
                ends = pa.array(np.arange(part.num_rows + 1) * logits.shape[1], pa.int32())
                maps = pa.ListArray.from_arrays(ends, pa.array(logits.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), maps], names=[*names, "logit"])

    scored = frames.mapInArrow(run, schema)
    sigmoid = F.transform("logit", lambda z: 1.0 / (1.0 + F.exp(-z.cast("double"))))
    return (
        once(scored, prob=sigmoid)
        .drop("logit")
        .withColumn("map_height", F.lit(size))
        .withColumn("map_width", F.lit(size))
    )


def diameter_results(maps: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Diameters alone, without any judgement of the masks."""
    return binarize_area_diameter(maps, threshold).select(*keys, "estimated_pupil_diameter")
