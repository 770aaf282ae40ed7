"""A training corpus from raw documents: quality, near duplicates, personal data, mixing, packing.

Each stage takes the rows that its predecessor kept and returns the columns of ``documents``; the last
returns the packing of each remaining row. ``run`` writes every stage to the shared folder and reads
it again, so a lost executor never repeats more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gazeframe.llm.mixing import mixed
from gazeframe.llm.near_dedup import keep_one
from gazeframe.llm.packing import pack
from gazeframe.llm.pii import redacted
from gazeframe.llm.quality import accepted
from gazeframe.session import scratch_path, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose counts and histograms pass."""
    small_batches(spark)
    return accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced."""
    small_batches(spark)
    return redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their shares."""
    small_batches(spark)
    return mixed(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every remaining row."""
    small_batches(spark)
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("length_packing", length_packing),
]

#: Minhash, EM and pivotal rounding have no SQL form; tests compare each stage with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
