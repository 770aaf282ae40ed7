"""One registered query per operator, each with the SQL it must agree with."""

from __future__ import annotations

from gazeframe.plans import (  # noqa: F401
    frame_queries,
    pixel_queries,
    stream_queries,
    training_queries,
)
from gazeframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
