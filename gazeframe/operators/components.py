"""Run-based mask steps, one column at a time.

Runs are found by column expressions; what needs the runs of several rows together, labels and borders,
goes through Arrow batches of runs, a small part of the map. Each step is a column of its own,
evaluated once per row, and pipelines in one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeframe.functions import labelling as L
from gazeframe.functions import runs as R
from gazeframe.functions.columns import once


def step(df: DataFrame, **texts: str) -> DataFrame:
    """Columns given as SQL text, evaluated once per row."""
    return once(df, **{name: F.expr(text) for name, text in texts.items()})


def with_components(df: DataFrame, foreground: str, width: str) -> DataFrame:
    """Adds ``_links`` (the runs), ``_labels`` and ``_parts`` of the mask with the given pixels."""
    df = step(df, _links=R.runs_of(foreground, width))
    found = df.withColumn("_found", L.components(F.col("_links")))
    return step(found, _labels="_found.labels", _parts="_found.parts").drop("_found")


def with_border(df: DataFrame, runs: str) -> DataFrame:
    """Adds ``_border``, the length of the outer borders through pixel centres, diagonal steps as sqrt(2)."""
    return df.withColumn("_border", L.outer_border(F.col(runs)))
