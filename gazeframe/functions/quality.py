"""Quality codes, visibility and status as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazeframe import schemas as S

# The quality codes written to the tables.
EMPTY = "empty_mask"
DOMINANCE = "low_component_dominance"
CONFIDENCE = "low_component_confidence"
CIRCULARITY = "low_component_circularity"
BORDER = "component_touches_border"
ABRUPT = "abrupt_area_change"


def join_reasons(codes: Column) -> Column:
    """Ordered, distinct, non-empty codes joined by semicolons."""
    return F.concat_ws(";", F.array_distinct(F.filter(codes, lambda c: c != "")))


def append_reason(existing: Column, code: str | Column) -> Column:
    """Add one code; the existing text counts as a single element."""
    code = code if isinstance(code, Column) else F.lit(code)
    return join_reasons(F.array(F.coalesce(existing, F.lit("")), code))


def component_reasons(
    dominance: Column, confidence: Column, circularity: Column, border: Column
) -> Column:
    """Codes for one measured component, in their fixed order."""
    return join_reasons(
        F.array(
            F.when(dominance < S.MIN_DOMINANCE, F.lit(DOMINANCE)),
            F.when(confidence < S.MIN_CONFIDENCE, F.lit(CONFIDENCE)),
            F.when(circularity < S.MIN_CIRCULARITY, F.lit(CIRCULARITY)),
            F.when(border, F.lit(BORDER)),
        )
    )


def component_valid(confidence: Column, circularity: Column, border: Column) -> Column:
    """Low dominance only warns; the other three reject the frame."""
    return ~(
        (confidence < S.MIN_CONFIDENCE) | (circularity < S.MIN_CIRCULARITY) | F.coalesce(border, F.lit(False))
    )


def visibility(reason: Column, valid: Column) -> Column:
    codes = F.split(F.coalesce(reason, F.lit("")), ";")
    partial = F.array(F.lit(CIRCULARITY), F.lit(BORDER))
    return (
        F.when(F.array_contains(codes, EMPTY), "not_detected")
        .when(F.arrays_overlap(codes, partial), "partially_visible_or_uncertain")
        .when(~F.coalesce(valid, F.lit(False)), "uncertain")
        .otherwise("visible")
    )


def tracking_status(valid: Column, reason: Column) -> Column:
    return (
        F.when(~valid, "invalid").when(F.coalesce(reason, F.lit("")) != "", "warning").otherwise("valid")
    )
