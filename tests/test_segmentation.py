import numpy as np
import pytest
from plain import measure
from pyspark.sql import functions as F

from gazeframe.operators import segmentation as seg


def frames(spark, maps, mask=None, kind="double", size=(296, 148)):
    rows = []
    for k, p in enumerate(maps):
        row = [k, [float(v) for v in p.ravel()], p.shape[0], p.shape[1], *size]
        if mask is not None:
            row.append([int(v) for v in mask[k].ravel()])
        rows.append(tuple(row))
    schema = f"id int, prob array<{kind}>, map_height int, map_width int, original_width int, original_height int"
    return spark.createDataFrame(rows, schema + (", mask array<int>" if mask is not None else ""))


def one(spark, p, threshold=0.7, **kw):
    return seg.measure_frames(frames(spark, [p], **kw), threshold).first()


def test_random_maps_match_flood_fill(spark):
    rng = np.random.default_rng(3)
    maps = []
    for _ in range(250):
        h, w = rng.integers(1, 13, 2)
        maps.append(rng.random((h, w)) ** rng.choice([0.3, 1.0, 3.0]))
    got = {r.id: r for r in seg.measure_frames(frames(spark, maps), 0.6).collect()}
    assert len(got) == len(maps)
    for k, p in enumerate(maps):
        want, r = measure(p, 0.6), got[k]
        if want is None:
            assert r.quality_reason == "empty_mask" and r.component_count == 0
            continue
        assert (r.selected_component_area, r.component_count) == (want["area"], want["count"])
        assert r.component_touches_border == want["border"]
        for name, key in (
            ("component_dominance", "dominance"),
            ("mean_component_confidence", "confidence"),
            ("component_circularity", "circularity"),
            ("raw_center_x_model_pixels", "x"),
            ("raw_center_y_model_pixels", "y"),
        ):
            assert r[name] == pytest.approx(want[key], abs=1e-9)


def test_full_size_disc_and_spiral(spark):
    y, x = np.mgrid[:148, :148]
    disc = np.clip(1.3 - ((x - 70) ** 2 + (y - 60) ** 2) / 1200, 0, 1)
    spiral = np.zeros((40, 40))
    top, left, bottom, right = 1, 1, 38, 38
    while top < bottom and left < right:
        spiral[top, left : right + 1] = 1
        spiral[top : bottom + 1, right] = 1
        spiral[bottom, left + 2 : right + 1] = 1
        spiral[top + 2 : bottom + 1, left + 2] = 1
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    got = {r.id: r for r in seg.measure_frames(frames(spark, [disc, spiral]), 0.5).collect()}
    for k, p in enumerate((disc, spiral)):
        want = measure(p, 0.5)
        assert got[k].selected_component_area == want["area"]
        assert got[k].component_circularity == pytest.approx(want["circularity"])


def test_weighted_centre(spark):
    p = np.zeros((10, 10))
    p[4:6, 2], p[4:6, 3] = 0.9, 1.0
    r = one(spark, p)
    assert (r.component_count, r.selected_component_area) == (1, 4)
    assert r.raw_center_x_model_pixels > 2.5 and r.raw_center_y_model_pixels == pytest.approx(4.5)
    assert r.segmentation_valid


def test_dominance_only_warns(spark):
    p = np.zeros((20, 20))
    p[2:5, 2:5], p[10:13, 10:12] = 0.99, 0.99
    r = one(spark, p)
    assert r.component_count == 2 and r.component_dominance == pytest.approx(0.6)
    assert r.segmentation_valid and r.quality_reason == "low_component_dominance"
    assert r.pupil_visibility == "visible"


def test_thin_bar_and_empty(spark):
    bar = np.zeros((40, 40))
    bar[10:12, 5:29] = 0.99
    r = one(spark, bar)
    assert "low_component_circularity" in r.quality_reason
    assert r.pupil_visibility == "partially_visible_or_uncertain"
    e = one(spark, np.zeros((8, 8)))
    assert (e.pupil_visibility, e.quality_reason, e.segmentation_valid) == (
        "not_detected", "empty_mask", False,
    )
    assert e.raw_center_x_pixels is None and e.selected_component_area == 0


def test_supplied_mask_wins(spark):
    p, m = np.full((20, 20), 0.95), np.zeros((20, 20))
    m[5:14, 5:14] = 1
    df = frames(spark, [p], mask=[m])
    r = seg.measure_frames(df, 0.99, mask="mask").first()
    assert r.selected_component_area == 81 and r.segmentation_valid


def test_float_maps_compare_in_their_own_precision(spark):
    p = np.array([[np.float32(0.7), np.nextafter(np.float32(0.7), np.float32(1))]])
    area = seg.binarize_area_diameter(frames(spark, [p], kind="float"), 0.7).first()
    assert area.foreground_area == 1


def test_bad_input(spark):
    df = frames(spark, [np.ones((4, 4))])
    with pytest.raises(ValueError):
        seg.measure_frames(df, 1.0)
    with pytest.raises(ValueError):
        seg.measure_frames(df.drop("map_width"), 0.5)
    with pytest.raises(Exception, match="must match"):
        seg.measure_frames(df.withColumn("map_width", F.lit(5)), 0.5).collect()


def test_filters_do_not_repeat_the_measurement(spark):
    df = frames(spark, [np.ones((4, 4))]).withColumn("recording_id", F.lit(1))
    optimized = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    whole = seg.measure_frames(df, 0.5)
    some = optimized(whole.where("segmentation_valid AND id = 0"))
    steps = optimized(whole).count("Generate inline")
    assert some.count("Generate inline") == steps > 5
    # The filter on the key reaches the scan, the one on the result stays above all steps.
    assert some.rindex("Filter (isnotnull(id") > some.rindex("Generate inline")
    assert some.index("Filter") < some.index("Generate inline")


def test_no_shuffle(spark):
    plan = seg.measure_frames(frames(spark, [np.ones((4, 4))]), 0.5)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
