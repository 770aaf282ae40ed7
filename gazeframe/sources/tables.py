"""Result sinks and the manifest contract."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeframe import schemas as S
from gazeframe.session import durable, scratch_path
from gazeframe.sources.files import opened


SINK_BLOCK = 1 << 16


def write_analysis(table: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """One folder per recording, rows in frame order across its files, NULL as empty field.

    A long recording is dealt out by blocks of frame numbers, so it is several tasks and files. The
    blocks need no sampling of the table: what it is computed from runs once.
    """
    block = F.floor(F.col("frame_number") / SINK_BLOCK)
    ordered = table.repartition("recording_id", block).sortWithinPartitions("recording_id", "frame_number")
    writer = ordered.drop("frame_number").write.mode(mode).partitionBy("recording_id")
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "").option("emptyValue", "")
    writer.format(fmt).save(path)


def _joined(batches: Iterator[pa.RecordBatch], folder: str, header: bytes) -> Iterator[pa.RecordBatch]:
    stores: dict = {}
    for batch in batches:
        done: dict[str, list] = {"recording_id": [], "path": [], "bytes": []}
        for name, parts in zip(batch.column("recording_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            store, final = opened(f"{folder.rstrip('/')}/{name}.csv", stores)
            store.create_dir(final.rsplit("/", 1)[0], recursive=True)
            attempt = f"{final}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(attempt) as out:
                out.write(header)
                for part in parts:
                    source, path = opened(part, stores)
                    with source.open_input_stream(path) as rows:
                        while piece := rows.read(_COPY_BYTES):
                            out.write(piece)
                size = out.tell()
            store.move(attempt, final)
            for key, value in zip(done, (name, final, size), strict=True):
                done[key].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(done["recording_id"], pa.string()), pa.array(done["path"], pa.string()), pa.array(done["bytes"], pa.int64())],
            names=list(done),
        )


_COPY_BYTES = 1 << 20


def write_recordings(table: DataFrame, folder: str, mode: str = "errorifexists") -> DataFrame:
    """One ``<recording>.csv`` below ``folder`` for every recording, rows in frame order; returns its name, path and bytes.

    Blocks of frames are sorted and written as headless parts by many tasks, through Spark's committer, into the shared folder. Then one
    task for each recording copies its parts, in order, in pieces of a megabyte, and gives the file its name when it is
    whole: a repeated or doubled task writes its own copy and replaces the same file by the same bytes. A recording named
    ``a/b`` is a file in a folder; a missing or climbing name fails. ``overwrite`` replaces files, but removes none of other recordings.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"Not a mode of this sink: {mode}")
    spark = table.sparkSession
    store, place = opened(folder, {})
    if mode == "errorifexists" and store.get_file_info(place).type != fs.FileType.NotFound:
        raise FileExistsError(f"The folder is there already: {folder}")
    name = F.col("recording_id").cast("string")
    sound = name.isNotNull() & (name != "") & ~name.startswith("/") & ~F.array_contains(F.split(name, "/"), "..")
    # The letter keeps Spark from reading numbers or dates into folder names.
    keyed = table.withColumns(
        {
            "_recording": F.when(sound, F.concat(F.lit("r"), name)).otherwise(F.raise_error(F.lit("A recording needs a name for its file."))),
            "_block": F.coalesce(F.floor(F.col("frame_number") / SINK_BLOCK), F.lit(-1)),
        }
    )
    columns = [c for c in table.columns if c not in ("recording_id", "frame_number")]
    stage = scratch_path(spark, "recording-parts")
    dealt = keyed.repartition("_recording", "_block").sortWithinPartitions("_recording", "_block", "frame_number")
    plain_options = {"header": False, "nullValue": "", "emptyValue": "", "compression": "none"}
    dealt.select(*columns, "_recording", "_block").write.partitionBy("_recording", "_block").options(**plain_options).csv(stage)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(stage)
    schema = "recording_id string, path string, bytes bigint"
    if "_recording" not in listed.columns:  # an empty table has no parts
        return spark.createDataFrame([], schema)
    # A list holds one path for each block and file of a recording, 65 536 frames apiece.
    files = F.transform(F.sort_array(F.collect_list(F.struct("_block", "path"))), lambda f: f.path)
    parts = listed.select("_recording", "_block", "path").groupBy("_recording").agg(files.alias("parts"))
    named = parts.select(F.substring("_recording", 2, 1 << 20).alias("recording_id"), "parts")
    line = io.StringIO()
    csv.writer(line, lineterminator="\n").writerow(columns)
    return durable(named.mapInArrow(partial(_joined, folder=folder, header=line.getvalue().encode()), schema))


def read_analysis(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    table = reader.format(fmt).load(path)
    return table.withColumn("quality_reason", F.coalesce("quality_reason", F.lit("")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.MANIFEST).option("header", True).csv(path)


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Per category: rows, masks, recordings and the span of frame suffixes."""
    suffix = F.col("source_frame_suffix").try_cast("bigint")
    return manifest.groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.nullif("mask_path", F.lit(""))).alias("masks"),
        F.count_distinct("source_recording").alias("recordings"),
        F.min(suffix).alias("first_suffix"),
        F.max(suffix).alias("last_suffix"),
        F.count_distinct(suffix).alias("distinct_suffixes"),
    )


def manifest_violations(
    manifest: DataFrame,
    categories: list[str],
    rate_by_category: dict[str, str] | None = None,
    consecutive: tuple[str, ...] = (),
    masked: tuple[str, ...] = (),
    rows_by_category: dict[str, int] | None = None,
) -> DataFrame:
    """Broken rules as rows ``(rule, category, found)``; empty when the manifest is sound."""
    category = F.col("category")
    rules: list[tuple[str, Column]] = [
        ("unknown_category", category.isNull() | ~category.isin(categories))
    ]
    for name, rate in (rate_by_category or {}).items():
        wrong = ~F.col("acquisition_fps_hz").eqNullSafe(F.lit(rate))
        rules.append(("wrong_rate", (category == name) & wrong))
    if masked:
        empty = F.coalesce("mask_path", F.lit("")) == ""
        rules.append(("missing_mask", category.isin(*masked) & empty))
    marks = F.filter(
        F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules]), lambda m: m.isNotNull()
    )
    broken = (
        manifest.select("category", F.explode(marks).alias("rule"))
        .groupBy("rule", "category")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    spans = manifest_summary(manifest).where(category.isin(*consecutive))
    holes = F.col("last_suffix") - F.col("first_suffix") + 1 - F.col("distinct_suffixes")
    again = F.col("rows") - F.col("distinct_suffixes")
    found = F.array(
        F.struct(F.lit("suffixes_missing").alias("rule"), holes.alias("found")),
        F.struct(F.lit("suffixes_repeated").alias("rule"), again.alias("found")),
    )
    gaps = spans.select("category", F.inline(found)).where("found > 0")
    broken = broken.unionByName(gaps.select("rule", "category", "found"))
    # Rules about whole categories compare the counts with what is expected; an absent category counts 0.
    if rows_by_category:
        wanted = manifest.sparkSession.createDataFrame(sorted(rows_by_category.items()), "category string, wanted bigint")
        counts = manifest.groupBy("category").agg(F.count(F.lit(1)).alias("found"))
        off = wanted.join(counts, "category", "left").withColumn("found", F.coalesce("found", F.lit(0)))
        off = off.where("found <> wanted").select(F.lit("wrong_row_count").alias("rule"), "category", "found")
        broken = broken.unionByName(off)
    return broken


def manifest_file_violations(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files that do not exist, and masks named other than their image: ``rule, path``.

    ``files`` holds one ``path`` per existing file, relative as in the manifest.
    """
    listed = manifest.select(F.explode(F.array("image_path", "mask_path")).alias("path")).where("path <> ''")
    absent = listed.distinct().join(files.select("path"), "path", "left_anti")
    name = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    other = manifest.where("mask_path <> ''").where(name("image_path") != name("mask_path"))
    return absent.select(F.lit("file_missing").alias("rule"), "path").unionByName(
        other.select(F.lit("names_differ").alias("rule"), F.col("mask_path").alias("path"))
    )


def mask_violations(pairs: DataFrame) -> DataFrame:
    """Image/mask pairs of unequal size, or masks that are not binary with some foreground.

    Columns: stem, width, height, mask_width, mask_height, mask_pixels.
    """
    levels = F.array_distinct("mask_pixels")
    rule = (
        F.when(
            (F.col("width") != F.col("mask_width")) | (F.col("height") != F.col("mask_height")),
            "size_mismatch",
        )
        .when((F.size(levels) > 2) | ~F.array_contains(levels, 0), "mask_not_binary")
        .when(F.array_max(levels) == 0, "mask_empty")
    )
    return pairs.select("stem", rule.alias("rule")).where(F.col("rule").isNotNull())
