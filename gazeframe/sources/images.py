"""PNG folders as frame rows."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe.functions.raster import grey_levels
from gazeframe.sources.files import opened


def _placed(uri: Column, root: str | None) -> tuple[Column, Column]:
    """Recording and file name from a file's address, without percent codes.

    The recording is the path below ``root``; without a root it is the last folder alone.
    """
    plain = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    folder, name = F.regexp_replace(path, r"/[^/]*$", ""), F.regexp_extract(path, r"([^/]*)$", 1)
    if root is None:
        return F.regexp_extract(folder, r"([^/]*)$", 1), name
    top = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", root).rstrip("/") + "/"
    return F.when(folder.startswith(top), F.substring(folder, len(top) + 1, 1 << 20)).otherwise(folder), name


def image_scan(spark: SparkSession, folder: str, root: str | None = None) -> DataFrame:
    """``*.png`` files of one folder (a glob may name many), decoded by Spark's image source.

    Columns: recording_id (the folder, or its path below ``root``), image_name, original_width,
    original_height and ``pixels``, the grey levels in row-major order. Names are as in the file system.
    """
    images = spark.read.format("image").option("pathGlobFilter", "*.png").load(folder)
    recording, name = _placed(F.col("image.origin"), root)
    return images.select(
        recording.alias("recording_id"),
        name.alias("image_name"),
        F.col("image.width").alias("original_width"),
        F.col("image.height").alias("original_height"),
        grey_levels(
            F.col("image.data"), F.col("image.width"), F.col("image.height"), F.col("image.nChannels")
        ).alias("pixels"),
    )


def list_images(spark: SparkSession, folder: str, root: str | None = None) -> DataFrame:
    """The PNG listing alone, with the names of :func:`image_scan`: no file content is read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path")
    )
    # Paths of this source carry no percent codes; escape the sign, so that decoding leaves them alone.
    recording, name = _placed(F.replace("path", F.lit("%"), F.lit("%25")), root)
    return files.select(
        recording.alias("recording_id"),
        name.alias("image_name"),
        "path",
    )


#: Fixed by the file format: signature, then a 13-byte header chunk that begins with width and height.
_PNG_HEAD = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR"
_HEAD_BYTES = len(_PNG_HEAD) + 8


def _png_size(head: bytes) -> tuple[int | None, int | None]:
    if len(head) < _HEAD_BYTES or not head.startswith(_PNG_HEAD):
        return None, None
    width, height = struct.unpack_from(">II", head, len(_PNG_HEAD))
    return (width, height) if 0 < width < 1 << 31 and 0 < height < 1 << 31 else (None, None)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stores: dict = {}
    for batch in batches:
        sizes = []
        for uri in batch.column("path").to_pylist():
            store, path = opened(uri, stores)
            with store.open_input_file(path) as file:
                sizes.append(_png_size(file.read_at(_HEAD_BYTES, 0)))
        width, height = (pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, width, height], names=[*batch.schema.names, "original_width", "original_height"])


def image_sizes(spark: SparkSession, folder: str, root: str | None = None) -> DataFrame:
    """The listing of :func:`list_images` with ``original_width`` and ``original_height`` from the files' headers.

    Tasks read the first 24 bytes of each of their files and decode nothing. Files that are no PNG have NULL sizes;
    Spark lists no file without bytes.
    """
    listed = list_images(spark, folder, root)
    schema = "recording_id string, image_name string, path string, original_width int, original_height int"
    return listed.mapInArrow(_heads, schema)
