"""Arrow-batched resampling of whole images.

Filtered resizing needs a variable number of taps per output pixel; a pair of small matrix
products per image does it without exploding pixels. Everything else on images stays in
column expressions.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=256)
def axis_weights(size: int, new_size: int) -> np.ndarray:
    """Triangle-filter weights, shape (new_size, size); wider when shrinking. Shared: not to be written to."""
    scale = size / new_size
    reach = max(scale, 1.0)
    centre = (np.arange(new_size) + 0.5) * scale
    first = np.maximum(np.trunc(centre - reach + 0.5), 0)
    stop = np.minimum(np.trunc(centre + reach + 0.5), size)
    taps = np.arange(size)
    raw = np.maximum(0.0, 1.0 - np.abs((taps + 0.5 - centre[:, None]) / reach))
    raw = np.where((taps >= first[:, None]) & (taps < stop[:, None]), raw, 0.0)
    weights = raw / raw.sum(axis=1, keepdims=True)
    weights.flags.writeable = False
    return weights


def _levels(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.round(values, 6) + 0.5), 0, 255)


def resize_levels(image: np.ndarray, new_width: int, new_height: int) -> np.ndarray:
    """Bilinear resize, columns first; grey levels are rounded after each axis."""
    height, width = image.shape
    wide = image if width == new_width else _levels(image @ axis_weights(width, new_width).T)
    return wide if height == new_height else _levels(axis_weights(height, new_height) @ wide)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def resize_bilinear(
    pixels: pd.Series, width: pd.Series, height: pd.Series, new_w: pd.Series, new_h: pd.Series
) -> pd.Series:
    """Flat grey levels resized to (new_w, new_h)."""
    out = []
    for flat, w, h, nw, nh in zip(pixels, width, height, new_w, new_h):
        image = np.asarray(flat, dtype=float).reshape(h, w)
        out.append(resize_levels(image, int(nw), int(nh)).astype(np.int32).ravel())
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def grey_levels(
    data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series
) -> pd.Series:
    """Grey levels from decoded bytes in blue-green-red(-alpha) order."""
    out = []
    for raw, w, h, n in zip(data, width, height, channels):
        bytes_ = np.frombuffer(raw, dtype=np.uint8).reshape(h, w, n).astype(np.int64)
        if n == 1:
            grey = bytes_[:, :, 0]
        else:
            # Fixed luma weights in 16-bit fractions.
            blue, green, red = bytes_[:, :, 0], bytes_[:, :, 1], bytes_[:, :, 2]
            grey = (red * 19595 + green * 38470 + blue * 7471 + 0x8000) >> 16
        out.append(grey.astype(np.int32).ravel())
    return pd.Series(out)
