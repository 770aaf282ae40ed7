"""Geometry of the aspect-preserving resize into a square model image."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazeframe.functions.columns import check, let
from gazeframe.schemas import MODEL_SIZE


def resize_scale(width: Column, height: Column, target: Column | int = MODEL_SIZE) -> Column:
    """``struct(scale_x, scale_y, pad_left, pad_top, resized_width, resized_height)``.

    The longer side becomes ``target``, the other is rounded half to even, and the
    remaining margin is split with the smaller half first.
    """
    target = target if isinstance(target, Column) else F.lit(target)
    width = check(width, (width > 0) & (height > 0), "Original image dimensions must be positive.")
    target = check(target, target > 0, "Target size must be positive.")

    def sized(s: Column) -> Column:
        return F.struct(
            (s.rw / s.w).alias("scale_x"),
            (s.rh / s.h).alias("scale_y"),
            F.floor((s.t - s.rw) / 2).cast("int").alias("pad_left"),
            F.floor((s.t - s.rh) / 2).cast("int").alias("pad_top"),
            s.rw.alias("resized_width"),
            s.rh.alias("resized_height"),
        )

    landscape = width >= height
    shape = F.struct(
        F.when(landscape, target)
        .otherwise(F.rint(width * target / height))
        .cast("int")
        .alias("rw"),
        F.when(landscape, F.rint(height * target / width))
        .otherwise(target)
        .cast("int")
        .alias("rh"),
        width.alias("w"),
        height.alias("h"),
        target.alias("t"),
    )
    return let(shape, sized)


def model_to_original(
    x: Column, y: Column, width: Column, height: Column, target: Column | int = MODEL_SIZE
) -> Column:
    """``struct(x, y)`` of a model-space point in the supplied image.

    NULL where the image is so narrow that its resized side vanishes.
    """
    return let(
        resize_scale(width, height, target),
        lambda g: F.when(
            (g.scale_x > 0) & (g.scale_y > 0),
            F.struct(
                ((x - g.pad_left) / g.scale_x).alias("x"), ((y - g.pad_top) / g.scale_y).alias("y")
            ),
        ),
    )


def model_to_input_length(
    length: Column, width: Column, height: Column, target: Column | int = MODEL_SIZE
) -> Column:
    """A model-space length in input pixels, by the geometric mean of both scales."""
    return let(
        resize_scale(width, height, target), lambda g: F.try_divide(length, F.sqrt(g.scale_x * g.scale_y))
    )


def equivalent_diameter(area: Column) -> Column:
    """Diameter of the circle with the given area."""
    return F.sqrt(area * F.lit(4.0 / math.pi))


def normalise_bytes(pixels: Column) -> Column:
    """Grey levels 0..255 as 0..1."""
    return F.transform(pixels, lambda v: v / F.lit(255.0))


def binary_mask(pixels: Column) -> Column:
    """1 where the mask level is above zero."""
    return F.transform(pixels, lambda v: (v > 0).cast("int"))
