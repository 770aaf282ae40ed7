import math
import re
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gazeframe.functions import geometry as G
from gazeframe.functions import raster
from gazeframe.plans import analysis
from gazeframe.sources import catalog, checkpoints, images, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_png(path, pixels):
    """8-bit PNG, grey or RGB."""
    h, w = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else 2
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw))
        + chunk(b"IEND", b"")
    )


def test_geometry(spark):
    def point(w, h):
        c = G.model_to_original(F.lit(74.0), F.lit(74.0), F.lit(w), F.lit(h))
        return tuple(spark.range(1).select(c.alias("p")).select("p.*").first())

    assert point(296, 148) == (148.0, 74.0) and point(100, 200) == (50.0, 100.0)
    length = G.model_to_input_length(F.lit(10.0), F.lit(296), F.lit(148))
    assert spark.range(1).select(length).first()[0] == pytest.approx(20)
    with pytest.raises(Exception, match="must be positive"):
        spark.range(1).select(G.resize_scale(F.lit(0), F.lit(5))).collect()


def sampled(spark, count, fps, rate=5.0, cap=10000, every=False):
    schema = "frame_count int, encoded_fps double, extraction_fps double, max_frames int, extract_all boolean"
    df = spark.createDataFrame([(count, fps, rate, cap, every)], schema)
    rows = catalog.sample_frame_indices(df).orderBy("extraction_index").collect()
    return [r.source_frame_index for r in rows]


def test_sampling(spark):
    half = sampled(spark, 100, 10.0)
    assert len(half) == 50 and (half[0], half[-1]) == (0, 99)
    assert half == np.linspace(0, 99, 50, dtype=int).tolist()
    assert sampled(spark, 10, 10.0, every=True) == list(range(10))
    assert sampled(spark, 100, 10.0, cap=10, every=True) == list(range(10))
    assert sampled(spark, 37, 29.97, 4.0) == np.linspace(0, 36, 5, dtype=int).tolist()
    assert sampled(spark, 1, 30.0) == [0]
    assert sampled(spark, 100, 10.0, cap=None, every=True) == list(range(100))
    schema = "video_name string, frame_count int, encoded_fps double, extraction_fps double, extract_all boolean"
    uncapped = spark.createDataFrame([("v", 3, 10.0, 5.0, True)], schema)
    assert [r.truncated for r in catalog.frame_catalogue(uncapped).collect()] == [False] * 3
    capped = uncapped.withColumn("max_frames", F.lit(2)).withColumn("acquisition_fps", F.lit(7.0))
    assert [(r.truncated, r.acquisition_fps) for r in catalog.frame_catalogue(capped).collect()] == [(True, 7.0)] * 2
    with pytest.raises(Exception, match="without frames"):
        sampled(spark, 0, 10.0)


def test_a_video_of_any_length_is_many_tasks(spark):
    n = 30_000_000
    df = spark.createDataFrame([(n, 30.0, 5.0, True, {"a": 1}), (7, 30.0, 5.0, False, None)], "frame_count long, encoded_fps double, extraction_fps double, extract_all boolean, tags map<string,int>")
    frames = catalog.sample_frame_indices(df)
    per = frames.where("extract_all").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("source_frame_index").alias("s")).collect()
    assert sum(r.n for r in per) == n and sum(r.s for r in per) == n * (n - 1) // 2
    assert max(r.n for r in per) < n / 4
    assert [r.source_frame_index for r in frames.where("NOT extract_all").collect()] == [0]
    plan = frames._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") < plan.rindex("Generate")


def test_names_and_indexing(spark):
    name = catalog.source_frame_name(F.lit("eye"), F.lit(19))
    assert spark.range(1).select(name).first()[0] == "eye_00020.png"
    big = catalog.source_frame_name(F.lit("eye"), F.lit(123456))
    assert spark.range(1).select(big).first()[0] == "eye_123457.png"
    files = [("a", "e_00020.png"), ("a", "e_00001.png"), ("b", "e_0.png"), ("b", "e_3.png")]
    files += [("c", "cover.png"), ("c", "e_7.png"), ("c", "e_12.png")]
    df = spark.createDataFrame(files, "recording_id string, image_name string")
    got = {(r[0], r[1]): (r.source_frame_index, r.extraction_index) for r in catalog.index_frames(df).collect()}
    assert got["a", "e_00001.png"] == (0, 0) and got["a", "e_00020.png"] == (19, 1)
    assert got["b", "e_0.png"] == (0, 0) and got["b", "e_3.png"] == (3, 1)
    assert [got["c", n] for n in ("cover.png", "e_7.png", "e_12.png")] == [(0, 0), (1, 1), (2, 2)]


def test_unreadable_frames_leave_gaps(spark):
    schema = "video_name string, frame_count int, encoded_fps double, extraction_fps double, max_frames int, extract_all boolean"
    videos = spark.createDataFrame([("v", 4, 10.0, 5.0, 100, True)], schema)
    bad = spark.createDataFrame([("v", 1)], "video_name string, source_frame_index bigint")
    rows = catalog.frame_catalogue(videos, bad).orderBy("extraction_index").collect()
    assert [(r.image_name, r.extraction_index) for r in rows] == [
        ("v_00001.png", 0), ("v_00003.png", 2), ("v_00004.png", 3),
    ]


def test_pairing(spark):
    stems = lambda *s: spark.createDataFrame([(x,) for x in s], "stem string")
    assert catalog.pair_images_masks(stems("a", "b"), stems("b", "a")).count() == 2
    with pytest.raises(FileNotFoundError, match="no mask"):
        catalog.pair_images_masks(stems("a", "b"), stems("a"))
    with pytest.raises(FileNotFoundError, match="no image"):
        catalog.pair_images_masks(stems("a"), stems("a", "b"))
    assert catalog.pair_images_masks(stems("a"), stems("a", "b"), allow_orphans=True).count() == 1
    with pytest.raises(FileNotFoundError):
        catalog.pair_images_masks(stems("a").limit(0), stems("a"))


def test_thresholds_and_best_checkpoint(spark):
    files = [("m_thresh=0.7_iou=0.9.pth", "0.55"), ("m_pred_thresh=0.6.pth", None), ("m.pth", None)]
    files += [("m_thresh=0.6_iou=0.85.pth", "oops"), ("x_iou=1.0.pth", "1.0"), ("x_iou=0.99.json", None)]
    df = spark.createDataFrame(files, "file_name string, metadata_threshold string")
    pick = lambda **k: [
        r.prediction_threshold
        for r in sorted(checkpoints.resolve_threshold(df, **k).collect(), key=lambda r: [f[0] for f in files].index(r.file_name))
    ]
    assert pick() == [0.55, 0.6, 0.7, 0.6, 0.7, 0.7]
    assert pick(requested=0.65) == [0.65] * 6
    with pytest.raises(ValueError):
        checkpoints.resolve_threshold(df, requested=1.0)
    assert checkpoints.best_checkpoint(df).first().file_name == "m_thresh=0.7_iou=0.9.pth"


def test_training_log(spark, tmp_path):
    (tmp_path / "run.log").write_text(
        '{"seed": 3, "n_epochs": 250}\n'
        "Epoch 001 | Train Loss: 0.0252 | Val Loss: 0.0248 | Macro Dice: 0.9251 | Macro IoU: 0.8689 | "
        "Balanced IoU: 0.8583 | Threshold: 0.50 | Tiny: n/a | Medium: 0.8517 | Large: 0.9542 | "
        "Low-circularity: n/a | LR: 5e-05\n"
    )
    lines = checkpoints.read_training_log(spark, str(tmp_path))
    row = checkpoints.parse_training_log(lines, ["log_file"]).first()
    assert (row.epoch, row.balanced_iou, row.tiny_iou, row.low_circularity_iou) == (1, 0.8583, None, None)
    assert row.learning_rate == 5e-05 and row.log_file == "run.log"
    assert checkpoints.parse_training_config(lines, "seed int, n_epochs int").first() == (3, 250)
    (tmp_path / "best.json").write_text('{\n "prediction_threshold": 0.4, "size_iou": {"tiny": 0.8}, "low_circularity_iou": null}')
    meta = checkpoints.read_checkpoint_metadata(spark, str(tmp_path / "best.json")).first()
    assert meta.prediction_threshold == 0.4 and meta.size_iou == {"tiny": 0.8}


def test_manifest(spark, tmp_path):
    head = "category,split,image_path,mask_path,source_recording,source_frame_suffix,acquisition_fps_hz,transformation\n"
    rows = [f"velocity,,p{n},,r,{n:05d},97,x" for n in (7212, 7213, 7215)] + ["cropped,train,p,,r,0001,,x"]
    (tmp_path / "m.csv").write_text(head + "\n".join(rows) + "\n")
    df = tables.read_manifest(spark, str(tmp_path / "m.csv"))
    found = tables.manifest_violations(
        df, ["cropped", "velocity"], {"velocity": "97"}, ("velocity",), ("cropped",)
    ).collect()
    assert {(r.rule, r.category) for r in found} == {
        ("suffixes_missing", "velocity"), ("missing_mask", "cropped"),
    }
    assert all(r.found > 0 for r in found)
    files = spark.createDataFrame([("p7212",), ("p7213",), ("p",)], "path string")
    masks = df.withColumn("mask_path", F.when(F.col("category") == "cropped", "q").otherwise(F.col("mask_path")))
    lost = {tuple(r) for r in tables.manifest_file_violations(masks, files).collect()}
    assert lost == {("file_missing", "p7215"), ("file_missing", "q"), ("names_differ", "q")}
    pairs = [("ok", 2, 1, 2, 1, [0, 255]), ("big", 2, 1, 2, 2, [0, 1, 0, 0]), ("grey", 3, 1, 3, 1, [0, 9, 255])]
    pairs += [("none", 2, 1, 2, 1, [0, 0])]
    cols = "stem string, width int, height int, mask_width int, mask_height int, mask_pixels array<int>"
    bad = {r.stem: r.rule for r in tables.mask_violations(spark.createDataFrame(pairs, cols)).collect()}
    assert bad == {"big": "size_mismatch", "grey": "mask_not_binary", "none": "mask_empty"}


def test_resize_keeps_flat_images_and_means():
    flat = np.full((7, 30), 90.0)
    assert (raster.resize_levels(flat, 12, 3) == 90).all()
    assert np.allclose(raster.axis_weights(10, 4).sum(axis=1), 1)
    ramp = np.tile(np.arange(16.0) * 10, (4, 1))
    assert np.abs(raster.resize_levels(ramp, 8, 4)[0][1:-1] - (np.arange(16) * 10).reshape(8, 2).mean(1)[1:-1]).max() <= 1


def disc(cx, cy, w=200, h=160):
    y, x = np.mgrid[:h, :w]
    return np.where((x - cx) ** 2 + (y - cy) ** 2 <= 18**2, 230, 20).astype(np.uint8)


def bright_scorer():
    return lambda batch: (batch - 0.5) * 40


def test_image_folder_end_to_end(spark, tmp_path):
    folder = tmp_path / "rec_a"
    folder.mkdir()
    for k in range(6):
        write_png(folder / f"eye_{k + 1:05d}.png", disc(80 + 3 * k, 70))
    colour = np.stack([disc(80, 70)] * 3, axis=-1)
    colour[..., 0] = 255
    other = tmp_path / "rec_b"
    other.mkdir()
    write_png(other / "eye_00001.png", colour)
    scan = images.image_scan(spark, str(tmp_path / "*"))
    rows = {(r.recording_id, r.image_name): r for r in scan.collect()}
    assert len(rows) == 7 == images.list_images(spark, str(tmp_path / "*")).count()
    r = rows["rec_a", "eye_00001.png"]
    assert (r.original_width, r.original_height) == (200, 160)
    assert (np.array(r.pixels).reshape(160, 200) == disc(80, 70)).all()
    grey = (255 * 19595 + 20 * 38470 + 20 * 7471 + 0x8000) >> 16
    assert min(rows["rec_b", "eye_00001.png"].pixels) == grey

    out = analysis.analyze_frames(scan, bright_scorer, 0.5, True, 10.0, batch_size=4)
    got = out.table.where("recording_id = 'rec_a'").orderBy("frame_number").collect()
    assert [g.frame_number for g in got] == [1, 2, 3, 4, 5, 6]
    assert {g.tracking_status for g in got} == {"valid"}
    for k, g in enumerate(got):
        assert g.center_x_pixels == pytest.approx(80 + 3 * k, abs=1)
        assert g.pupil_diameter_input_pixels == pytest.approx(36, abs=2)
    assert all(g.speed_pixels_per_second == pytest.approx(30, abs=8) for g in got[1:])

    only = analysis.analyze_frames(scan, bright_scorer, 0.5).table
    assert only.columns[2:] == [
        "image_name", "estimated_pupil_diameter", "pupil_diameter_input_pixels", "pupil_visibility",
        "segmentation_status", "quality_reason",
    ]
    with pytest.raises(ValueError, match="acquisition rate"):
        analysis.analyze_frames(scan, bright_scorer, 0.5, True)

    target = str(tmp_path / "out")
    tables.write_analysis(out.table, target)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "recording_id=rec_a").glob("*.csv")))
    first = text.splitlines()[1].split(",")
    assert text.splitlines()[0].startswith("image_name,estimated_pupil_diameter")
    assert first[0] == "eye_00001.png" and first[7] == "" and '""' not in text


def test_one_file_per_recording(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SINK_BLOCK", 16)
    rows = [(r, n, f"{r}_{n}.png", None if n % 7 == 0 else n / 2, "a, \"b\"" if n == 3 else "") for r in ("001", "b/2020-01-01", "x y%") for n in range(1, 101)]
    schema = "recording_id string, frame_number int, image_name string, speed double, quality_reason string"
    df = spark.createDataFrame(rows, schema).repartition(5)
    target = tmp_path / "out"
    made = {r.recording_id: r.bytes for r in tables.write_recordings(df, str(target)).collect()}
    found = {str(p.relative_to(target)): p for p in target.rglob("*") if p.is_file()}
    assert set(found) == {f"{r}.csv" for r in made} == {"001.csv", "b/2020-01-01.csv", "x y%.csv"}
    for name, path in found.items():
        assert path.stat().st_size == made[name[:-4]]
        lines = path.read_text().splitlines()
        assert lines[0] == "image_name,speed,quality_reason"
        assert [line.split(",")[0] for line in lines[1:]] == [f"{name[:-4]}_{n}.png" for n in range(1, 101)]
        assert lines[7].endswith(",,") and lines[1].endswith(",0.5,")
    with pytest.raises(FileExistsError):
        tables.write_recordings(df, str(target))
    before = {n: p.read_bytes() for n, p in found.items()}
    tables.write_recordings(df, str(target), "overwrite")
    assert {n: p.read_bytes() for n, p in found.items()} == before
    assert sum(p.is_file() for p in target.rglob("*")) == 3
    assert tables.write_recordings(df.limit(0), str(tmp_path / "none")).count() == 0
    for bad in (None, "", "/etc/x", "a/../../b"):
        with pytest.raises(Exception, match="needs a name"):
            tables.write_recordings(df.limit(1).withColumn("recording_id", F.lit(bad).cast("string")), str(tmp_path / "bad"))


def test_a_repeated_task_leaves_one_file(spark, tmp_path):
    part = tmp_path / "part.csv"
    part.write_bytes(b"1,2\n")
    batch = pa.RecordBatch.from_pylist([{"recording_id": "a", "parts": [part.as_uri()]}])
    for _ in range(2):
        list(tables._joined(iter([batch]), str(tmp_path / "out"), b"x,y\n"))
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "out").iterdir()] == [("a.csv", b"x,y\n1,2\n")]


def test_names_with_spaces_and_nested_folders(spark, tmp_path):
    for folder in ("b/rec1", "c/rec1"):
        (tmp_path / folder).mkdir(parents=True)
        write_png(tmp_path / folder / "eye 1+2%_00001.png", disc(80, 70))
    where = str(tmp_path / "*" / "*")
    scan, listing = (f(spark, where, str(tmp_path)) for f in (images.image_scan, images.list_images))
    names = [("b/rec1", "eye 1+2%_00001.png"), ("c/rec1", "eye 1+2%_00001.png")]
    for df in (scan, listing):
        assert sorted(tuple(r) for r in df.select("recording_id", "image_name").collect()) == names
    assert {r.recording_id for r in images.list_images(spark, where).collect()} == {"rec1"}


def test_image_flow_shuffles_nothing_wide(spark, tmp_path):
    folder = tmp_path / "rec"
    folder.mkdir()
    write_png(folder / "eye_00001.png", disc(80, 70))
    scan, listing = images.image_scan(spark, str(folder)), images.list_images(spark, str(folder))
    table = analysis.analyze_frames(scan, bright_scorer, 0.5, listing=listing).table
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [image") == 1
    # Above the join only narrow columns are left.
    top = plan.split("Join")[0]
    assert not {"prob", "pixels", "logit", "model_image"} & set(re.findall(r"\b(\w+)#", top))


def test_sizes_from_headers(spark, tmp_path):
    for name in ("b 1", "c+2"):
        (tmp_path / name).mkdir()
        for k in range(3):
            write_png(tmp_path / name / f"eye 1+2%_{k:05d}.png", disc(80, 70))
    where = str(tmp_path / "*")
    columns = ("recording_id", "image_name", "original_width", "original_height")
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    sizes = images.image_sizes(spark, where)
    assert rows(sizes) == rows(images.image_scan(spark, where)) and len(rows(sizes)) == 6
    plan = sizes._jdf.queryExecution().optimizedPlan().toString()
    assert "image#" not in plan and "content" not in plan.split("Relation")[0]
    # Only the header counts: the rest may be cut off; what is no PNG has no size.
    whole = (tmp_path / "b 1" / "eye 1+2%_00000.png").read_bytes()
    (tmp_path / "d").mkdir()
    for name, data in {"cut": whole[:24], "short": whole[:23], "empty": b"", "other": b"GIF89a" + bytes(40)}.items():
        (tmp_path / "d" / f"{name}.png").write_bytes(data)
    got = {r.image_name: (r.original_width, r.original_height) for r in images.image_sizes(spark, str(tmp_path / "d")).collect()}
    assert got == {"cut.png": (200, 160), "short.png": (None, None), "other.png": (None, None)}


def test_scores_by_batches(spark):
    from gazeframe.operators.scoring import score_frames

    def load():
        seen = []

        def scorer(batch):
            seen.append(len(batch))
            assert batch.dtype == np.float32 and len(batch) <= 3 and batch.shape[1:] == (2, 2)
            batch *= 2  # scorers may write into their input
            return batch[:, None]

        return scorer

    rows = [(k, {"a": k}, [k / 8, 0.0, -k / 8, None if k == 99 else 1.0]) for k in range(10)]
    schema = "id int, extra map<string,int>, model_image array<float>"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    got = {r.id: (r.extra, r.prob, r.map_width) for r in score_frames(df, load, 2, batch_size=3).collect()}
    assert len(got) == 10
    for k, (extra, prob, side) in got.items():
        assert extra == {"a": k} and side == 2
        assert prob == pytest.approx([1 / (1 + math.exp(-2 * z)) for z in (k / 8, 0.0, -k / 8, 1.0)], abs=1e-6)
    plan = score_frames(df, load, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    for bad in ([0.5] * 3, None):
        with pytest.raises(Exception, match="2 x 2 levels"):
            score_frames(spark.createDataFrame([(1, {}, bad), (2, {}, [0.5] * 5)], schema), load, 2).collect()


def test_folders_are_decoded_once(spark, tmp_path):
    folder = tmp_path / "rec"
    folder.mkdir()
    for k in range(3):
        write_png(folder / f"eye_{k + 1:05d}.png", disc(80, 70))
    a = analysis.analyze_folders(spark, str(folder), bright_scorer, 0.5).table
    b = analysis.analyze_frames(images.image_scan(spark, str(folder)), bright_scorer, 0.5).table
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a._jdf.queryExecution().optimizedPlan().toString().count("Relation [image") == 1


def test_video_catalogue_equals_folder(spark, tmp_path):
    folder = tmp_path / "vid"
    folder.mkdir()
    for k in range(6):
        write_png(folder / f"vid_{k + 1:05d}.png", disc(80 + 3 * k, 70))
    scan = images.image_scan(spark, str(folder))
    schema = "video_name string, frame_count int, encoded_fps double, extraction_fps double, max_frames int, extract_all boolean"
    videos = spark.createDataFrame([("vid", 6, 10.0, 5.0, 100, False)], schema)
    a = analysis.analyze_videos(videos, scan, bright_scorer, 0.5, True, size=64).table
    b = analysis.analyze_frames(scan, bright_scorer, 0.5, True, 10.0, size=64).table
    key = lambda t: sorted(map(tuple, t.collect()))
    assert key(a) == key(b)
    assert analysis.analyze_videos(videos, scan, bright_scorer, 0.5, size=64).table.count() == 3
    own = videos.withColumn("acquisition_fps", F.lit(20.0)).withColumn("max_frames", F.lit(2))
    times = analysis.analyze_videos(own, scan, bright_scorer, 0.5, True, size=64).table.orderBy("frame_number").collect()
    assert [t.timestamp_seconds for t in times] == [k / 20 for k in range(6)]


def test_video_catalogue_is_not_broadcast(spark):
    """Two rows give any number of frames, and no size that Spark knows of tells so."""
    videos = spark.range(2, numPartitions=1).select(
        F.concat(F.lit("vid"), "id").alias("video_name"),
        F.lit(300).alias("frame_count"),
        F.lit(10.0).alias("encoded_fps"),
        F.lit(5.0).alias("extraction_fps"),
        F.lit(False).alias("extract_all"),
    )
    name = F.concat(F.lit("vid"), F.col("id") % 2)
    scan = spark.range(600).select(
        name.alias("recording_id"),
        catalog.source_frame_name(name, F.expr("id div 2")).alias("image_name"),
        F.array_repeat(F.lit(0), 64).alias("pixels"),
        F.lit(8).alias("original_width"),
        F.lit(8).alias("original_height"),
    )
    for velocity, many in ((True, 600), (False, 300)):
        table = analysis.analyze_videos(videos, scan, bright_scorer, 0.5, velocity, size=8).table
        assert len(table.collect()) == many
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
