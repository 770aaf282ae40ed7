import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from gazeframe.operators import motion, results, segmentation
from gazeframe.plans import stand_ins as V
from gazeframe.streaming import live

SF = "/root/testdata/sf0.001"
KEYS = ["recording_id", "source_frame_index"]


@pytest.fixture
def arriving(spark, tmp_path, monkeypatch):
    """The events in four files, dealt to them in no order, and a row without recording that closes the stream."""
    monkeypatch.setattr(live, "BUCKET", 100)
    events = V.table(spark, SF, "events")
    for part in range(4):
        piece = events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part).coalesce(1)
        piece.write.mode("append").parquet(str(tmp_path / "events"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"]
    close = events.agg((F.max("ts") + F.expr("INTERVAL 4000 DAYS")).alias("ts")).select(*nothing, "ts").select(events.columns)
    close.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "events"))
    )


FRAMES = (
    "recording_id long, source_frame_index long, extraction_index long, image_name string, segmentation_valid boolean, "
    "raw_center_x_pixels double, raw_center_y_pixels double, t string"
)
CLOSE = (None, None, None, None, None, None, None, "2030-01-01 00:00:00")


def frames_of(spark, rows):
    return spark.createDataFrame(rows, FRAMES).withColumn("ts", F.to_timestamp("t")).coalesce(1)


def streamed(spark, path, name, parts, **options):
    """The frames of ``parts``, one file and micro-batch each, and a closing row."""
    for part in [*parts, [CLOSE]]:
        frames_of(spark, part).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return live.run_available(live.stream_kinematics(stream, 10.0, **options), name)


def frame(i, second=0, extraction=None, recording=1, valid=True):
    return (recording, i, i if extraction is None else extraction, f"{i}.png", valid, i * 1.5, float(i % 7), f"2024-01-01 00:00:{second:02}")


def test_any_arrival_order_equals_batch(spark, tmp_path):
    """Gaps, invalid frames, repeated frame numbers and two recordings, arriving in no order."""
    import random

    r = random.Random(6)
    rows = [frame(i, i, recording=rec, valid=i % 9 != 4) for rec in (1, 2) for i in range(50) if i % 11 != 7]
    rows += [frame(20, 20, extraction=k) for k in (90, 91)] + [frame(21, 21, extraction=5)]
    r.shuffle(rows)
    parts = [rows[k::3] for k in range(3)]
    # The last bit of a square root may differ between the two forms.
    names = ["recording_id", "source_frame_index", "image_name", "displacement_x_pixels", F.round("speed_pixels_per_second", 9).alias("speed")]
    want = motion.kinematics(frames_of(spark, rows), 10.0).select(names)
    got = streamed(spark, str(tmp_path / "in"), "any-order", parts).select(names)
    assert got.count() == len(rows) and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_eager_frames_do_not_wait(spark, tmp_path):
    path = str(tmp_path / "in")
    for part in ([frame(0)], [frame(2, 2), frame(5, 3)], [frame(1, 1)]):
        frames_of(spark, part).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = live.run_available(live.stream_kinematics(stream, 10.0, eager=True), "eager").collect()
    # Nothing has passed the watermark: only frames with their predecessor are out, however they came.
    assert {r.source_frame_index: r.speed_pixels_per_second is not None for r in got} == {0: False, 1: True, 2: True}


def held(*indexes, ms=0, **more):
    return [live.Held(**({"done": False, "home": True, "ms": ms, "index": i, "extraction": i, "name": "", "valid": True, "t": i / 10, "x": 1.0 * i, "y": 0.0} | more)) for i in indexes]


def test_state_keeps_the_front_and_what_is_awaited():
    out, kept = live.settle([*held(1, 2, 3, 9), *held(12, 13, ms=50)], 10, False)
    assert [(r.index, m is not None) for r, m in out] == [(1, False), (2, True), (3, True), (9, False)]
    assert [(r.index, r.done) for r in kept] == [(9, True), (12, False), (13, False)]
    out, kept = live.settle([*kept, *held(11, ms=40)], 60, False)
    assert [(r.index, m is not None) for r, m in out] == [(11, False), (12, True), (13, True)]
    assert [r.index for r in kept] == [13]
    assert live.settle([], 0, False) == ([], [])


def test_stream_equals_batch(spark, arriving):
    got = live.run_available(live.stream_kinematics(V.measurements_of(arriving), delay="1000 days"), "motion")
    names = [*KEYS, "displacement_x_pixels", "speed_pixels_per_second", "center_y_pixels"]
    rounded = lambda df: df.select(*KEYS, *[F.round(c, 9).alias(c) for c in names[2:]])
    want = rounded(motion.kinematics(V.measurements(spark, SF)))
    assert got.count() == 1000
    assert rounded(got).exceptAll(want).isEmpty()


def test_late_frames_are_dropped(spark, tmp_path):
    at = lambda i, t: (*frame(i)[:-1], f"2024-01-01 {t}")
    parts = [
        [at(0, "00:00:00"), at(1, "00:00:01")],
        [at(2, "01:00:00")],
        [at(3, "01:00:01")],
        # Spark compares arriving rows with the watermark of the batch before.
        [at(9, "00:00:05"), at(4, "01:00:02")],
    ]
    with pytest.warns(UserWarning, match="behind the watermark"):
        got = streamed(spark, str(tmp_path / "in"), "late", parts).collect()
    assert {r.source_frame_index: r.speed_pixels_per_second is not None for r in got} == {
        0: False, 1: True, 2: True, 3: True, 4: True,
    }


def test_late_and_new_frames_of_one_batch(spark, tmp_path):
    """A frame that comes after its successor still gives the successor its motion."""
    got = streamed(spark, str(tmp_path / "in"), "mixed", [[frame(10)], [frame(5), frame(11)], [frame(12), frame(6), frame(4)]]).collect()
    speed = {r.source_frame_index: r.speed_pixels_per_second for r in got}
    assert {k: v is not None for k, v in speed.items()} == {10: False, 4: False, 5: True, 11: True, 12: True, 6: True}
    assert speed[11] == pytest.approx((15**2 + 10**2) ** 0.5)


def test_dropped_rows_are_reported(spark, tmp_path):
    def rows(*r):
        return spark.createDataFrame(
            [(1, i, f"{i}.png", True, float(i), 0.0, t) for i, t in r],
            "recording_id long, source_frame_index long, image_name string, segmentation_valid boolean, "
            "raw_center_x_pixels double, raw_center_y_pixels double, t string",
        ).withColumn("ts", F.to_timestamp("t")).coalesce(1)

    path = str(tmp_path / "in")
    for hour, n in ((1, 1), (5, 2), (6, 3)):
        rows((n, f"2024-01-01 0{hour}:00:00")).write.mode("append").parquet(path)
    rows((9, "2024-01-01 00:00:00")).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    with pytest.warns(UserWarning, match="behind the watermark"):
        live.run_available(live.stream_kinematics(stream, 10.0), "dropped")


@pytest.mark.parametrize("files", [0, 5])
def test_streamed_tables_are_files_or_folders(spark, tmp_path, files):
    table = V.table(spark, SF, "embeddings")
    path = tmp_path / "embeddings.parquet"
    if files:
        table.repartition(files).write.parquet(str(path))
        table.limit(3).write.parquet(str(tmp_path / "old_embeddings.parquet"))
    else:
        path.symlink_to(f"{SF}/embeddings.parquet")
    got = queries()["stream_frame_qc"](spark, str(tmp_path))
    want = results.tracking_status(segmentation.measure_frames(V.maps(spark, SF), 0.7), "segmentation_status")
    names = ["frame_id", "selected_component_area", "quality_reason", "segmentation_status"]
    assert got.count() == table.count() > 0
    assert sorted(got.select(names).collect()) == sorted(want.select(names).collect())


def test_events_of_many_years_arrive_whole(spark, tmp_path, monkeypatch):
    """No frame is late, however long the events last; a bucket sets one timer in a micro-batch."""
    events = V.table(spark, SF, "events")
    events.withColumn("ts", F.col("ts") + F.make_dt_interval(F.col("event_id") * 4)).write.parquet(str(tmp_path / "events.parquet"))
    runs, late = [], live.late_rows
    monkeypatch.setattr(live, "late_rows", lambda query: runs.append(query.recentProgress) or late(query))
    got = queries()["stream_kinematics"](spark, str(tmp_path))
    assert got.count() == events.count()
    assert sum(p["numInputRows"] > 1 for p in runs[0]) == 5
    assert all(o["customMetrics"].get("numRegisteredTimers", 0) <= 1 for p in runs[0] for o in p["stateOperators"])
