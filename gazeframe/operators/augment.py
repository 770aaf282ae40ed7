"""Paired image/mask augmentation inside each pair's row.

A pair holds ``image`` (grey levels) and ``mask`` as flat arrays of a ``size`` x ``size``
square. Every random choice is drawn from (seed, image id, epoch), so a retried task and
any rerun make the same pair, and image and mask always share their choices.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeframe import schemas as S
from gazeframe.functions.columns import int_div, let, once, require_columns, unit_draw
from gazeframe.functions.geometry import resize_scale
from gazeframe.functions.raster import resize_bilinear

# Fixed probabilities and ranges of the training transforms.
CHANCE = 0.2
ZOOM_RANGE = (0.85, 1.15)
MAX_PAD = 12
DEGREES = 15.0
AFFINE_SCALE = (0.95, 1.05)
JITTER = 0.2
BLUR_SIGMA = (0.1, 2.0)

# One number per random choice, so that choices stay independent.
SALTS = {
    name: k
    for k, name in enumerate(
        (
            "zoom", "zoom_scale", "zoom_left", "zoom_top",
            "pad", "pad_left", "pad_right", "pad_top", "pad_bottom", "crop_left", "crop_top",
            "flip_h", "flip_v",
            "affine", "angle", "affine_scale", "shift_x", "shift_y",
            "jitter", "brightness", "contrast", "jitter_order", "blur", "sigma",
            "shear",
        ),
        start=10,
    )
}


class Draws:
    """Random choices of one pair and epoch."""

    def __init__(self, seed: int, ident: str, epoch: Column | int = 0):
        self.seed, self.ident = seed, F.col(ident)
        self.epoch = epoch if isinstance(epoch, Column) else F.lit(epoch)

    def unit(self, name: str) -> Column:
        return unit_draw(SALTS[name], self.seed, self.ident, self.epoch)

    def happens(self, name: str, chance: float) -> Column:
        return self.unit(name) < chance

    def between(self, name: str, low: float, high: float) -> Column:
        return low + (high - low) * self.unit(name)

    def integer(self, name: str, top: Column | int) -> Column:
        """0..top, both included."""
        top = top if isinstance(top, Column) else F.lit(top)
        return F.floor(self.unit(name) * (top + 1)).cast("int")


def _square(size: int) -> Column:
    return F.sequence(F.lit(0), F.lit(size * size - 1))


def gather(
    pixels: Column, width: Column | int, height: Column | int, size: int,
    source: Callable[[Column, Column], tuple[Column, Column]],
) -> Column:
    """A ``size`` square whose pixel (x, y) is the source pixel ``source(x, y)``, 0 outside."""
    width = width if isinstance(width, Column) else F.lit(width)
    height = height if isinstance(height, Column) else F.lit(height)

    def filled(a: Column) -> Column:
        def pixel(i: Column) -> Column:
            sx, sy = source(i % size, int_div(i, size))
            inside = sx.between(0, width - 1) & sy.between(0, height - 1)
            return F.when(inside, F.get(a, (sy * width + sx).cast("int"))).otherwise(0)

        return F.transform(_square(size), pixel)

    return let(pixels, filled)


def _each(df: DataFrame, build: Callable[[str], Column], names=("image", "mask")) -> DataFrame:
    return once(df, **{n: build(n) for n in names})


def augment_flip(df: DataFrame, size: int, draws: Draws, chance: float = CHANCE) -> DataFrame:
    """Mirror the pair left to right and top to bottom, each with its own chance."""
    chosen = df.withColumn("_h", draws.happens("flip_h", chance)).withColumn(
        "_v", draws.happens("flip_v", chance)
    )

    def flipped(name: str) -> Column:
        turn = lambda x, y: (
            F.when(F.col("_h"), size - 1 - x).otherwise(x),
            F.when(F.col("_v"), size - 1 - y).otherwise(y),
        )
        return F.when(F.col("_h") | F.col("_v"), gather(F.col(name), size, size, size, turn)).otherwise(
            F.col(name)
        )

    return _each(chosen, flipped).drop("_h", "_v")


def augment_pad_crop(
    df: DataFrame, size: int, draws: Draws, max_pad: int = MAX_PAD, chance: float = CHANCE
) -> DataFrame:
    """Pad each side by up to ``max_pad`` zeros, then crop a random square of the old size."""
    pads = {n: draws.integer(n, max_pad) for n in ("pad_left", "pad_right", "pad_top", "pad_bottom")}
    chosen = (
        df.withColumn("_on", draws.happens("pad", chance))
        .withColumns({f"_{n}": c for n, c in pads.items()})
        .withColumn("_dx", draws.integer("crop_left", F.col("_pad_left") + F.col("_pad_right")) - F.col("_pad_left"))
        .withColumn("_dy", draws.integer("crop_top", F.col("_pad_top") + F.col("_pad_bottom")) - F.col("_pad_top"))
    )

    def shifted(name: str) -> Column:
        move = lambda x, y: (x + F.col("_dx"), y + F.col("_dy"))
        return F.when(F.col("_on"), gather(F.col(name), size, size, size, move)).otherwise(F.col(name))

    return _each(chosen, shifted).drop("_on", "_dx", "_dy", *[f"_{n}" for n in pads])


def resize_nearest(
    pixels: Column, width: Column, height: Column, new_w: Column, new_h: Column
) -> Column:
    """Flat pixels resized by taking the source pixel under each output centre."""

    def scaled(a: Column) -> Column:
        def pixel(i: Column) -> Column:
            x, y = i % new_w, int_div(i, new_w)
            sx = F.floor((x + 0.5) * width / new_w)
            sy = F.floor((y + 0.5) * height / new_h)
            return F.get(a, (sy * width + sx).cast("int"))

        return F.transform(F.sequence(F.lit(0), (new_w * new_h - 1).cast("int")), pixel)

    return let(pixels, scaled)


def augment_zoom(
    df: DataFrame, size: int, draws: Draws, scales=ZOOM_RANGE, chance: float = CHANCE
) -> DataFrame:
    """Zoom by a random factor; a larger pair is cropped, a smaller one placed on black."""
    chosen = (
        df.withColumn("_on", draws.happens("zoom", chance))
        .withColumn(
            "_n",
            F.when(
                F.col("_on"),
                F.greatest(F.lit(1), F.rint(size * draws.between("zoom_scale", *scales))),
            )
            .otherwise(size)
            .cast("int"),
        )
        .withColumn("_room", F.abs(F.col("_n") - size))
        .withColumn("_sign", F.when(F.col("_n") > size, 1).otherwise(-1))
        .withColumn("_dx", F.col("_sign") * draws.integer("zoom_left", F.col("_room")))
        .withColumn("_dy", F.col("_sign") * draws.integer("zoom_top", F.col("_room")))
        .withColumn("_s", F.lit(size))
    )
    n = F.col("_n")
    resized = chosen.withColumn(
        "_image", resize_bilinear(F.col("image"), F.col("_s"), F.col("_s"), n, n)
    ).withColumn("_mask", resize_nearest(F.col("mask"), F.col("_s"), F.col("_s"), n, n))

    def placed(name: str) -> Column:
        move = lambda x, y: (x + F.col("_dx"), y + F.col("_dy"))
        return F.when(F.col("_on"), gather(F.col(f"_{name}"), n, n, size, move)).otherwise(F.col(name))

    temporary = ("_on", "_n", "_room", "_sign", "_dx", "_dy", "_s", "_image", "_mask")
    return _each(resized, placed).drop(*temporary)


def augment_affine(
    df: DataFrame,
    size: int,
    draws: Draws,
    degrees: float = DEGREES,
    scales=AFFINE_SCALE,
    translate: float | tuple[float, float] = 0.0,
    shear: float | tuple[float, float] = 0.0,
    chance: float = CHANCE,
) -> DataFrame:
    """Rotate, scale, shift and shear the pair about its centre; output pixels look back to
    their source, the image with four taps and the mask with the nearest pixel.

    ``translate`` is the largest shift as a share of the side, one number or one for each axis. ``shear`` is an
    angle in degrees, or a range from which each pair draws one.
    """
    turn = math.pi / 180.0 * draws.between("angle", -degrees, degrees)
    if isinstance(shear, tuple):
        skew = F.tan(math.pi / 180.0 * draws.between("shear", *shear))
    else:
        skew = F.lit(math.tan(math.radians(shear)))
    scale = draws.between("affine_scale", *scales)
    along_x, along_y = (t * size for t in (translate if isinstance(translate, tuple) else (translate, translate)))
    middle = size * 0.5
    chosen = (
        df.withColumn("_on", draws.happens("affine", chance))
        .withColumn("_a", F.cos(turn))
        .withColumn("_b", F.sin(turn))
        .withColumn("_s", scale)
        .withColumn("_tx", F.rint(draws.between("shift_x", -along_x, along_x)) + middle)
        .withColumn("_ty", F.rint(draws.between("shift_y", -along_y, along_y)) + middle)
        .withColumn("_k", skew)
        # Rows of the inverse of rotation times shear, over the scale.
        .withColumn("_m00", (F.col("_a") - F.col("_k") * F.col("_b")) / F.col("_s"))
        .withColumn("_m01", (F.col("_b") + F.col("_k") * F.col("_a")) / F.col("_s"))
        .withColumn("_m10", -F.col("_b") / F.col("_s"))
        .withColumn("_m11", F.col("_a") / F.col("_s"))
    )

    def back(i: Column) -> Column:
        dx = i % size + 0.5 - F.col("_tx")
        dy = int_div(i, size) + 0.5 - F.col("_ty")
        return F.struct(
            (F.col("_m00") * dx + F.col("_m01") * dy + middle).alias("u"),
            (F.col("_m10") * dx + F.col("_m11") * dy + middle).alias("v"),
        )

    outside = lambda q: ~((q.u >= 0) & (q.u < size) & (q.v >= 0) & (q.v < size))
    at = lambda name, x, y: F.get(F.col(name), (y * size + x).cast("int"))
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(size - 1))

    def smooth(q: Column) -> Column:
        base = F.struct(F.floor(q.u - 0.5).alias("x"), F.floor(q.v - 0.5).alias("y"))

        def taps(b: Column) -> Column:
            fx, fy = q.u - 0.5 - b.x, q.v - 0.5 - b.y
            x0, x1, y0, y1 = clip(b.x), clip(b.x + 1), clip(b.y), clip(b.y + 1)
            upper = at("image", x0, y0) * (1 - fx) + at("image", x1, y0) * fx
            lower = at("image", x0, y1) * (1 - fx) + at("image", x1, y1) * fx
            return F.floor(F.round(upper * (1 - fy) + lower * fy, 6)).cast("int")

        return F.when(outside(q), 0).otherwise(let(base, taps))

    def nearest(q: Column) -> Column:
        return F.when(outside(q), 0).otherwise(at("mask", F.floor(q.u), F.floor(q.v)))

    sample = {"image": smooth, "mask": nearest}

    def moved(name: str) -> Column:
        turned = F.transform(_square(size), lambda i: let(back(i), sample[name]))
        return F.when(F.col("_on"), turned).otherwise(F.col(name))

    temporary = ("_on", "_a", "_b", "_s", "_k", "_tx", "_ty", "_m00", "_m01", "_m10", "_m11")
    return _each(chosen, moved).drop(*temporary)


def _level(value: Column) -> Column:
    return F.least(F.greatest(F.floor(F.round(value, 6)), F.lit(0)), F.lit(255)).cast("int")


def augment_photometric(
    df: DataFrame,
    size: int,
    draws: Draws,
    jitter: float = JITTER,
    sigmas=BLUR_SIGMA,
    chance: float = CHANCE,
) -> DataFrame:
    """Brightness and contrast in random order, then a 5x5 Gaussian blur; image only."""
    toned = (
        df.withColumn("_on", draws.happens("jitter", chance))
        .withColumn("_bf", draws.between("brightness", 1 - jitter, 1 + jitter))
        .withColumn("_cf", draws.between("contrast", 1 - jitter, 1 + jitter))
        .withColumn("_first", draws.happens("jitter_order", 0.5))
        .withColumn("_soft", draws.happens("blur", chance))
        .withColumn("_sig", draws.between("sigma", *sigmas))
    )
    brighten = lambda a: F.transform(a, lambda v: _level(v * F.col("_bf")))

    def contrast(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)
        mean = F.floor(total / F.size(a) + 0.5)
        return let(
            mean, lambda m: F.transform(a, lambda v: _level(m + (v - m) * F.col("_cf")))
        )

    changed = F.when(F.col("_first"), let(brighten(F.col("image")), contrast)).otherwise(
        let(contrast(F.col("image")), brighten)
    )
    toned = once(toned, image=F.when(F.col("_on"), changed).otherwise(F.col("image")))

    raw = [F.exp(-0.5 * F.pow(F.lit(float(d)) / F.col("_sig"), 2)) for d in range(3)]
    total = raw[0] + 2 * raw[1] + 2 * raw[2]
    toned = toned.withColumn("_k", F.array(*[raw[abs(d)] / total for d in range(-2, 3)]))
    # Mirrored at the border without repeating the edge pixel.
    mirror = lambda c: (size - 1) - F.abs((size - 1) - F.abs(c))

    def blur(along_x: bool) -> Callable[[Column], Column]:
        def one(a: Column) -> Column:
            def pixel(i: Column) -> Column:
                x, y = i % size, int_div(i, size)
                terms = []
                for d in range(-2, 3):
                    sx, sy = (mirror(x + d), y) if along_x else (x, mirror(y + d))
                    terms.append(F.get(a, (sy * size + sx).cast("int")) * F.get("_k", F.lit(d + 2)))
                return terms[0] + terms[1] + terms[2] + terms[3] + terms[4]

            return F.transform(_square(size), pixel)

        return one

    softened = let(
        let(F.col("image"), blur(True)),
        lambda a: F.transform(blur(False)(a), lambda v: F.rint(F.round(v, 6)).cast("int")),
    )
    done = once(toned, image=F.when(F.col("_soft"), softened).otherwise(F.col("image")))
    return done.drop("_on", "_bf", "_cf", "_first", "_soft", "_sig", "_k")


def resize_with_pad(
    df: DataFrame,
    pixels: str,
    width: str,
    height: str,
    size: int = S.MODEL_SIZE,
    smooth: bool = True,
    name: str | None = None,
) -> DataFrame:
    """Aspect-preserving resize (bilinear, or nearest for masks), centred on black."""
    placed = df.withColumn("_g", resize_scale(F.col(width), F.col(height), size))
    w, h = F.col("_g.resized_width"), F.col("_g.resized_height")
    if smooth:
        small = resize_bilinear(F.col(pixels), F.col(width), F.col(height), w, h)
    else:
        small = resize_nearest(F.col(pixels), F.col(width), F.col(height), w, h)
    move = lambda x, y: (x - F.col("_g.pad_left"), y - F.col("_g.pad_top"))
    fitted = {name or pixels: gather(F.col("_small"), w, h, size, move)}
    return once(placed.withColumn("_small", small), **fitted).drop("_g", "_small")


def training_pairs(
    pairs: DataFrame,
    ident: str,
    seed: int = 0,
    epoch: Column | int = 0,
    augment: bool = True,
    size: int = S.MODEL_SIZE,
    max_pad: int = MAX_PAD,
    scales=ZOOM_RANGE,
) -> DataFrame:
    """Model-ready pairs: resized, optionally augmented, grey levels in 0..1, mask in {0, 1}.

    Columns: the id, image_pixels, image_width, image_height, mask_pixels, mask_width,
    mask_height.
    """
    shape = ["image_pixels", "image_width", "image_height", "mask_pixels", "mask_width", "mask_height"]
    require_columns(pairs, [ident, *shape], "Image/mask pairs")
    sized = resize_with_pad(pairs, "image_pixels", "image_width", "image_height", size, True, "image")
    sized = resize_with_pad(sized, "mask_pixels", "mask_width", "mask_height", size, False, "mask")
    sized = sized.drop(*shape)
    if augment:
        draws = Draws(seed, ident, epoch)
        sized = augment_zoom(sized, size, draws, scales)
        sized = augment_pad_crop(sized, size, draws, max_pad)
        sized = augment_flip(sized, size, draws)
        sized = augment_affine(sized, size, draws)
        sized = augment_photometric(sized, size, draws)
    return once(
        sized,
        image=F.transform("image", lambda v: v / F.lit(255.0)),
        mask=F.transform("mask", lambda v: (v > 0).cast("int")),
    )
