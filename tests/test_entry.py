"""The registry: queries agree with their SQL on the small tables.

One query per family runs here; ``tools/check.py`` compares all of them.
"""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "speed_pixels_per_second" in df.columns


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    unexpressed = {q for q in set(queries()) - set(oracle_sql()) if not q.startswith("op") and q != "pipeline"}
    assert not unexpressed


FAMILIES = (
    "index_frames frame_catalogue analysis_csv_sink training_log_scan resolve_threshold "
    "manifest_violations velocity_table plot_series status_summary review_sample missing_overlays "
    "resize_with_pad connected_components measure_supplied_mask run_analysis_velocity "
    "run_analysis_images center_marker stream_frame_qc weighted_resample select_threshold "
    "run_analysis_videos single_precision_maps single_precision_sweep result_violations velocity_table_lenient "
    "checkpoint_thresholds config_violations run_registry sample_frame_indices stream_kinematics balanced_weights "
    "early_stop_replay augment_zoom augment_affine augment_photometric training_pairs "
    "weighted_draws manifest_file_violations mask_violations"
).split()


@pytest.mark.parametrize("name", FAMILIES)
def test_query(spark, con, name):
    mine = queries()[name](spark, SF).toPandas()
    assert len(mine)
    if name in oracle_sql():
        theirs = con.sql(oracle_sql()[name]).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert normal(mine.astype(object)) == normal(theirs.astype(object))


@pytest.mark.parametrize(("name", "most"), [("diagnostic_segment", 4), ("weighted_resample", 6), ("index_frames", 4)])
def test_shuffles(spark, name, most):
    """Shuffles in the plan before adaptive execution changes it."""
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    kinds = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition")
    assert sum(plan.count(k) for k in kinds) <= most


def test_files_of_videos_are_not_broadcast(spark):
    """Neither in the plan nor after adaptive execution has changed it."""
    table = queries()["run_analysis_videos"](spark, SF)
    plan = lambda: table._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan()
    assert len(table.collect())
    assert "Broadcast" not in plan()
