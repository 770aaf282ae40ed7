import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeframe.functions import quality as Q
from gazeframe.operators import results, review
from gazeframe.operators import validation as val
from gazeframe.plans import analysis

SEGMENTATION = (
    "recording_id int, image_name string, source_frame_index long, estimated_pupil_diameter double, "
    "pupil_diameter_input_pixels double, segmentation_valid boolean, quality_reason string, pupil_visibility string"
)


def parts(spark):
    rows = [
        (1, "a_2.png", 1, 5.0, 10.0, True, "", "visible"),
        (1, "a_1.png", 0, 4.0, 8.0, True, "abrupt_area_change", "visible"),
        (1, "a_3.png", 2, 0.0, 0.0, False, "empty_mask", "not_detected"),
    ]
    seg = spark.createDataFrame(rows, SEGMENTATION)
    keys = ["recording_id", "image_name"]
    return seg.select(*keys, "estimated_pupil_diameter", "pupil_diameter_input_pixels"), seg.select(
        *keys, "source_frame_index"
    ), seg


def test_diameter_table(spark):
    predictions, frames, seg = parts(spark)
    got = results.diameter_table(predictions, frames, seg, strict=True).orderBy("frame_number").collect()
    assert [g.segmentation_status for g in got] == ["warning", "valid", "invalid"]
    assert [g.frame_number for g in got] == [1, 2, 3]
    plain = results.diameter_table(predictions, frames).collect()
    assert {(p.pupil_visibility, p.segmentation_status) for p in plain} == {("not_evaluated", "valid")}
    with pytest.raises(Exception, match="without frame: a_1.png"):
        results.diameter_table(predictions, frames.where("source_frame_index > 0"), seg).collect()
    with pytest.raises(Exception, match="without segmentation row: a_1.png"):
        results.diameter_table(predictions, frames, seg.where("source_frame_index > 0")).collect()
    loose = results.diameter_table(predictions, frames.union(frames), seg.where("source_frame_index > 0"), strict=False)
    assert loose.count() == 2
    broken = results.result_violations(predictions, frames.where("source_frame_index > 0"), seg).collect()
    assert [tuple(r) for r in broken] == [(1, "a_1.png", "no_frame")]


def test_reasons(spark):
    row = spark.range(1).select(
        Q.join_reasons(F.array(F.lit("a"), F.lit(""), F.lit("b"), F.lit("a"), F.lit(None))).alias("joined"),
        Q.append_reason(F.lit("a;b"), "b").alias("whole"),
        Q.append_reason(F.lit(None).cast("string"), "b").alias("empty"),
        Q.append_reason(F.lit("b"), "b").alias("same"),
        Q.visibility(F.lit("low_component_confidence"), F.lit(False)).alias("v"),
    ).first()
    assert tuple(row) == ("a;b", "a;b;b", "b", "b", "uncertain")


def test_overlay_levels(spark):
    df = spark.createDataFrame(
        [(1, [100] * 4, [0.7, 0.7001, 0.85, 1.0], 4, None, None, True)],
        "id int, grey array<int>, prob array<double>, map_width int, raw_center_x_model_pixels double, "
        "raw_center_y_model_pixels double, segmentation_valid boolean",
    )
    got = [tuple(c) for c in analysis.overlay_frames(df, 0.7).first().overlay]
    assert got == [(100, 100, 100), (115, 115, 90), (115, 106, 90), (115, 90, 90)]
    marked = df.withColumn("raw_center_x_model_pixels", F.lit(1.6)).withColumn("raw_center_y_model_pixels", F.lit(0.2))
    one = analysis.overlay_frames(marked.withColumn("prob", F.array(*[F.lit(0.0)] * 4)), 0.7).first().overlay
    assert [tuple(c) for c in one] == [(65, 154, 154)] * 4
    yellow = marked.withColumn("segmentation_valid", F.lit(False))
    assert tuple(analysis.overlay_frames(yellow, 0.9999).first().overlay[0]) == (154, 154, 65)
    with pytest.raises(Exception, match="differ in number"):
        analysis.overlay_frames(df.withColumn("grey", F.array(F.lit(1))), 0.7).collect()


def test_diagnostic_segment(spark):
    df = spark.createDataFrame(
        [(1, i * 3, float(i), i in (2, 3)) for i in range(7)],
        "recording_id int, source_frame_index int, v double, bad boolean",
    )
    for width in (1, 4, 65536):
        kept = review.diagnostic_segment(df, "v", F.col("bad"), "k", segment_width=width)
        assert [r.k for r in kept.orderBy("source_frame_index").collect()] == [None, 1, 2, 3, 4, None, None]
        wide = review.diagnostic_segment(df, "v", F.col("bad"), "k", True, width)
        assert [r.k for r in wide.orderBy("source_frame_index").collect()] == [None, 1, 2, 3, 4, 5, None]


def test_limits_and_sample(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (1, None, float("nan")), (2, None, None)], "k int, a double, b double")
    got = {r.k: (r.lower_limit, r.upper_limit) for r in review.padded_limits(df, ["a", "b"], ["k"]).collect()}
    assert got == {1: (pytest.approx(-0.8), pytest.approx(10.8)), 2: (0.0, 1.0)}
    table = spark.createDataFrame(
        [(1, f"x_{n:05d}.png", 1.0, 1.0, 1.0, 1.0) for n in range(1, 101)],
        "recording_id int, image_name string, estimated_pupil_diameter double, center_x_pixels double, "
        "center_y_pixels double, speed_pixels_per_second double",
    )
    numbers = [r.frame_number for r in review.review_sample(table, 10, 50, 20).orderBy("frame_number").collect()]
    assert numbers == [10, 30, 50]
    with pytest.raises(ValueError, match="fewer than two"):
        review.review_sample(table, 10, 12, 20, strict=True)
    with pytest.raises(ValueError):
        review.review_sample(table, 10, 5, 1)


LABELLED = "id int, prob array<double>, target array<int>, map_width int"


def test_overlap(spark):
    tiny, large = [0] * 99 + [1], [1] * 100
    df = spark.createDataFrame([(0, [0.0] * 100, tiny, 10), (1, [1.0] * 100, large, 10), (2, [0.0] * 4, [0] * 4, 2)], LABELLED)
    got = {r.id: r.iou for r in val.overlap_scores(df, 0.5).collect()}
    assert got == {0: 0.0, 1: pytest.approx(1, abs=1e-6), 2: 1.0}
    sweep = {(r.id, r.threshold): r.iou for r in val.image_sweep(df, (0.5,), ["id"]).collect()}
    assert sweep == {(k, 0.5): v for k, v in got.items()}


@pytest.mark.parametrize("element", ["double", "float"])
def test_sweep_against_single_cuts(spark, element):
    rnd = np.random.default_rng(4)
    levels = [round(float(v), 2) for v in rnd.random(400)]
    rows = [(k, levels[k * 40 : k * 40 + 40], [int(v) for v in rnd.random(40) > 0.6], 8) for k in range(10)]
    rows += [(0, *rows[3][1:]), (20, [None, 0.9, float("nan")], [1, None, 1], 3), (21, [0.9], [1, 1], 1), (22, [0.9, 0.9], [1], 1)]
    df = spark.createDataFrame([*rows, (23, [], [], 1), (24, None, None, 1)], LABELLED.replace("double", element)).repartition(3)
    cuts = (0.7, 0.3, 0.5, 0.3, 0.91)
    swept = val.image_sweep(df, cuts, ["id"]).collect()
    assert len(swept) == 14 * len(cuts)
    for k, cut in enumerate(cuts):
        want = sorted((r.id, r.iou, r.dice, r.target_area) for r in val.overlap_scores(df.where("id < 20"), cut).collect())
        assert sorted((r.id, r.iou, r.dice, r.target_area) for r in swept if r.candidate == k and r.id < 20) == want
    odd = {(r.id, r.candidate): (r.target_area, round(r.iou, 3)) for r in swept if r.id >= 20}
    # A missing probability lies above no cut, NaN above all; a list is as long as it is.
    assert odd[20, 0] == (2, 0.333) and odd[20, 4] == (2, 0.5)
    assert odd[21, 0] == (2, 0.5) and odd[22, 0] == (1, 0.5) and odd[22, 4] == (1, 0.0)


def test_sweep_shuffles_and_explodes_no_pixel(spark):
    df = spark.createDataFrame([(0, [0.5] * 9, [1] * 9, 3)], LABELLED)
    plan = val.image_sweep(df, tuple(k / 1001 for k in range(1, 1001)), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1 and plan.count("Generate ") == 1


def test_means_do_not_depend_on_partitions(spark):
    rnd = np.random.default_rng(9)
    rows = [(k, [float(v) for v in rnd.random(30)], [int(v) for v in rnd.random(30) > 0.5], 6) for k in range(500)]
    df = spark.createDataFrame(rows, LABELLED)
    sweeps, losses = set(), set()
    for parts in (1, 7, 200):
        dealt = df.repartition(parts, F.xxhash64(F.col("id") + parts))
        sweeps.add(tuple(sorted(map(tuple, val.threshold_sweep(dealt, "id", (0.3, 0.5)).collect()))))
        losses.add(val.validation_loss(dealt.withColumnRenamed("prob", "logit"), []).first()[0])
    assert len(sweeps) == 1 and len(losses) == 1
    z, t = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert losses.pop() == pytest.approx(np.mean(np.maximum(z, 0) - z * t + np.log1p(np.exp(-np.abs(z)))), abs=1e-12)
    empty = val.validation_loss(df.limit(0).withColumnRenamed("prob", "logit"), []).first()
    assert empty[0] is None


def test_exact_sum_of_wide_and_broken_values(spark):
    from gazeframe.functions.columns import exact_avg, exact_sum

    of = lambda values: spark.createDataFrame([(v,) for v in values], "v double").agg(exact_sum(F.col("v")), exact_avg(F.col("v"))).first()
    assert tuple(of([1e11, 2.0**-30, -1e11, None])) == (2.0**-30, 2.0**-30 / 3)
    assert of([1e300, 1.0])[0] == 1e300 and math.isnan(of([float("nan"), 1.0])[0]) and tuple(of([])) == (None, None)


def test_threshold_choice(spark):
    def square(side, value):
        inside = [1 if y < side and x < side else 0 for y in range(100) for x in range(100)]
        return [value * v for v in inside], inside

    rows = [(k, *square(side, 0.6), 100) for k, side in enumerate((8, 40, 90))]
    reports = val.threshold_sweep(spark.createDataFrame(rows, LABELLED), "id", (0.5, 0.7))
    best = val.select_threshold(reports).first()
    assert best.threshold == 0.5 and best.balanced_iou == pytest.approx(1)
    assert [best.tiny_iou, best.medium_iou, best.large_iou] == [pytest.approx(1)] * 3
    assert best.low_circularity_iou is None
    with pytest.raises(ValueError):
        val.threshold_sweep(spark.createDataFrame(rows, LABELLED), "id", ())


def test_nested_part_adds_area_not_border(spark):
    ring = [1 if max(abs(x - 4), abs(y - 4)) in (0, 4) else 0 for y in range(9) for x in range(9)]
    r = val.low_circularity_targets(spark.createDataFrame([(0, [0.0] * 81, ring, 9)], LABELLED)).first()
    assert r.target_circularity == pytest.approx(4 * math.pi * 33 / 32**2)
    empty = spark.createDataFrame([(0, [0.0], [0], 1)], LABELLED)
    assert val.low_circularity_targets(empty).first().low_circularity


def test_weights_and_resample(spark):
    labels = ["tiny"] * 2 + ["medium"] * 3 + ["large"] * 995
    df = spark.createDataFrame([(k, b) for k, b in enumerate(labels)], "image_id int, size_bin string")
    weights = val.balanced_weights(df).groupBy("size_bin").agg(F.sum("weight").alias("w")).collect()
    assert {round(r.w, 6) for r in weights} == {round(1000 / 3, 6)}
    drawn = val.weighted_resample(df, seed=1).cache()
    assert drawn.count() == 1000 and drawn.agg(F.sum("draws")).first()[0] == 1000
    per = {r.size_bin: r.n for r in drawn.groupBy("size_bin").agg(F.sum("draws").alias("n")).collect()}
    assert all(270 < n < 400 for n in per.values())
    assert drawn.exceptAll(val.weighted_resample(df, seed=1)).isEmpty()


def test_draws_by_given_weights(spark):
    n = 20_000
    weight = F.when(F.col("image_id") == 77, 30_000.0).when(F.col("image_id") % 2 == 0, 0.0).otherwise((F.col("image_id") % 5 + 1) / 3.0)
    df = spark.range(n).select(F.col("id").alias("image_id"), weight.alias("weight"), F.lit("x").alias("_other"))
    drawn = val.weighted_draws(df, seed=4)
    rows = drawn.collect()
    assert drawn.columns == ["image_id", "weight", "_other", "draws"] and len(rows) == n
    assert sum(r.draws for r in rows) == n and all(not r.draws for r in rows if r.weight == 0)
    total = sum(r.weight for r in rows)
    for light in range(5):  # each class near its share, the one heavy row too
        share = lambda r: r.image_id % 5 == light and r.image_id != 77
        want = n * sum(r.weight for r in rows if share(r)) / total
        assert abs(sum(r.draws for r in rows if share(r)) - want) < 6 * want**0.5
    heavy = next(r.draws for r in rows if r.image_id == 77)
    assert abs(heavy - n * 30_000 / total) < 6 * (n * 30_000 / total) ** 0.5
    again = val.weighted_draws(df.repartition(3), seed=4).select("image_id", "draws")
    assert again.exceptAll(drawn.select("image_id", "draws")).isEmpty()
    # One pass over the whole line for a few draws agrees with a search in the prefix sums.
    few = spark.createDataFrame([(k, w) for k, w in enumerate([0.5, 0.0, 2.0, 1e-30, 7.25])], "image_id long, weight double")
    assert {r.image_id: r.draws for r in val.weighted_draws(few, seed=9).collect()} == searched([0.5, 0.0, 2.0, 1e-30, 7.25], 9)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def searched(weights, seed):
    import bisect

    def unit(salt, key):
        m = 2147483647
        state = ((1 + salt * 1299709 + seed * 15485863) * 48271 + key) % m
        for _ in range(2):
            state = (state * 48271 + 11) % m
        return state / m

    shares = [max(1, round(w / max(weights) * val.SHARES)) if w else 0 for w in weights]
    starts = [(sum(shares[:k]), k) for k in range(len(shares)) if shares[k]]
    out = dict.fromkeys(range(len(weights)), 0)
    for k in range(len(weights)):
        at = int((unit(3, k) + unit(4, k) / 2147483647) * sum(shares))
        out[starts[bisect.bisect_right(starts, (at, len(weights))) - 1][1]] += 1
    return out


@pytest.mark.parametrize("weights", [[1.0, None], [1.0, -1.0], [float("nan")], [0.0, 0.0]])
def test_weights_that_cannot_be_drawn(spark, weights):
    df = spark.createDataFrame(list(enumerate(weights)), "image_id long, weight double")
    with pytest.raises(Exception, match="ampling weight"):
        val.weighted_draws(df, seed=1).collect()


def test_no_rows_to_draw(spark):
    assert val.weighted_draws(spark.createDataFrame([], "image_id long, weight double"), seed=1).collect() == []


def replay(scores, patience, delta=1e-4):
    best, best_epoch, wait = -math.inf, 0, 0
    for epoch, s in enumerate(scores, 1):
        if s > best + delta:
            best, best_epoch, wait = s, epoch, 0
        else:
            wait += 1
            if wait >= patience:
                return best_epoch, epoch, True
    return best_epoch, len(scores), False


def test_early_stop(spark):
    import random

    rnd = random.Random(5)
    runs = {0: [0.86 + (0.0086 if e == 25 else 0.0) - e * 1e-5 for e in range(1, 101)]}
    runs[1] = [k * 5e-5 for k in range(300)]
    for k in range(2, 9):
        runs[k] = [round(rnd.random() ** k, 5) for _ in range(rnd.randint(1, 300))]
    rows = [(k, e, s) for k, scores in runs.items() for e, s in enumerate(scores, 1)]
    df = spark.createDataFrame(rows, "run_id int, epoch int, balanced_iou double")
    got = {r.run_id: (r.best_epoch, r.stop_epoch, r.stopped_early) for r in val.early_stop_replay(df).collect()}
    assert got == {k: replay(v, 40) for k, v in runs.items()}
    assert got[0] == (25, 65, True)


def test_early_stop_with_tasks_without_runs(spark):
    df = spark.createDataFrame([(k, e, e / 8) for k in range(3) for e in (1, 2)], "run_id int, epoch int, balanced_iou double")
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in val.early_stop_replay(df).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(k, 2, 0.25, 2, False) for k in range(3)]


def test_early_stop_of_long_runs(spark):
    """Runs over several segments: one that always improves, one that stops at once, one without a name."""
    n = 150_000
    runs = spark.range(1, n + 1).selectExpr(
        "explode(array('up', 'down', NULL)) AS run_id", "id AS epoch", "id AS _id"
    ).selectExpr(
        "run_id", "epoch",
        f"CASE run_id WHEN 'up' THEN _id / 100D WHEN 'down' THEN 1 - _id / {n}D ELSE if(_id <= 30, NULL, if(_id = 31, double('NaN'), double(_id % 7))) END AS balanced_iou",
    )
    got = {r.run_id: tuple(r)[1:] for r in val.early_stop_replay(runs).collect()}
    assert got["up"] == (n, n / 100, n, False)
    assert got["down"] == (1, 1 - 1 / n, 41, True)
    assert got[None] == (34, 6.0, 74, True)
    assert val.early_stop_replay(runs.limit(0)).count() == 0


def test_loss_matches_definition(spark):
    df = spark.createDataFrame([(0, [2.0, -1.0], [1, 0])], "id int, logit array<double>, target array<int>")
    want = (math.log(1 + math.exp(-2)) + math.log(1 + math.exp(-1))) / 2
    assert val.validation_loss(df, []).first()[0] == pytest.approx(want)


def test_run_names(spark):
    name = val.default_run_name(F.lit(True), F.lit(False), F.lit(1e-4), F.lit(0))
    other = val.default_run_name(F.lit(False), F.lit(True), F.lit(1e-3), F.lit(7))
    assert tuple(spark.range(1).select(name, other).first()) == ("ft_natural_lr1e-4_s0", "scratch_bal_lr1e-3_s7")
