"""Session helpers: a local session for tests and durable cuts in a plan's lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_scratch: list[str] = []


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gazeframe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a session without the setting (a test on one machine) gets a temporary one.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"Set {CHECKPOINT_KEY} to a folder shared by all executors.")
    folder = tempfile.mkdtemp(prefix="spark-gazeframe-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Let at most ``rows`` rows of whole texts cross to Python at once, unless the session has a smaller limit.

    A batch stands several times in an executor, outside its heap: as it is written, and as it is read, for each task.
    """
    if int(spark.conf.get(BATCH_KEY)) > rows:
        spark.conf.set(BATCH_KEY, str(rows))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables that several steps read; see :func:`clear_scratch`."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    _scratch.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this process has written to scratch paths; call it when no result is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so a lost executor repeats nothing random."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
