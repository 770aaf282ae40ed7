"""A query, its columns, and the SQL that must agree with it.

Columns are declared once, as ``name:kind`` with kind i (integer), d (double, compared to six
places), s (text) or b (boolean), and applied to both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _spark(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        c = c.cast("bigint")
    elif kind == "d":
        # The same arithmetic on both sides; adding zero turns -0.0 into 0.0.
        c = F.rint(c.cast("double") * 1e6) / 1e6 + F.lit(0.0)
    return c.alias(name)


def _sql(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "d":
        return f"round_even(CAST({name} AS DOUBLE) * 1e6, 0) / 1e6 + 0.0::DOUBLE AS {name}"
    return name


def query(columns: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a function as the query of its name. ``ctes`` come first in the SQL."""
    spec = [c.split(":") for c in columns.split()]

    def add(fn: Query) -> Query:
        name = fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark(n, k) for n, k in spec])

        QUERIES[name] = run
        if sql is not None:
            chosen = ", ".join(_sql(n, k) for n, k in spec)
            steps = ",".join([*ctes, f"\nanswer AS ({sql})"])
            ORACLES[name] = f"WITH RECURSIVE {steps}\nSELECT {chosen} FROM answer"
        return fn

    return add
