"""Per-frame masks and component measurements.

Input is one row per frame with ``prob`` (flat row-major array), ``map_height`` and
``map_width``, and for input-pixel results ``original_width`` and ``original_height``. All
work stays inside the frame's row: these operators add no shuffle. Only runs of set pixels go through Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeframe import schemas as S
from gazeframe.functions import geometry as G
from gazeframe.functions import quality as Q
from gazeframe.functions import runs as R
from gazeframe.functions.columns import map_cut, once, require_columns
from gazeframe.operators.components import step, with_border, with_components

MAP_COLUMNS = ("prob", "map_height", "map_width")


def _foreground(df: DataFrame, threshold: float | str, mask: str | None) -> str:
    """Foreground pixel indices; a supplied mask overrides the threshold."""
    fits = "size(prob) = map_height * map_width"
    cut = map_cut(df, threshold)
    source, test = "prob", lambda p: f"{p} > {cut}"
    if mask is not None:
        source, test = f"`{mask}`", lambda m: f"{m} != 0"
        fits += f" AND size({source}) = size(prob)"
        if isinstance(df.schema[mask].dataType.elementType, T.BooleanType):
            test = lambda m: m
    checked = (
        f"CASE WHEN {fits} THEN {source} "
        "ELSE raise_error('Map and mask sizes must match map_height x map_width.') END"
    )
    return R.foreground(checked, test)


def binarize_area_diameter(df: DataFrame, threshold: float | str) -> DataFrame:
    """Foreground area over the whole map and its equivalent-circle diameter."""
    require_columns(df, MAP_COLUMNS, "Probability maps")
    cut = F.expr(map_cut(df, threshold))
    area = F.size(F.filter("prob", lambda p: p > cut))
    return once(df, foreground_area=area).withColumn(
        "estimated_pupil_diameter", G.equivalent_diameter(F.col("foreground_area"))
    )


def connected_components(
    df: DataFrame, threshold: float | str, keys: list[str], mask: str | None = None
) -> DataFrame:
    """One row per 8-connected component: its first flat pixel, area, and whether it is the
    selected one (greatest area, first pixel on ties)."""
    require_columns(df, [*MAP_COLUMNS, *keys], "Probability maps")

    found = with_components(df, _foreground(df, threshold, mask), "map_width")

    def part(c: str) -> str:
        first = f"get(_links, {c}.label)"
        return R.pack(
            first_pixel=f"{first}.y * map_width + {first}.x0",
            area=f"{c}.area",
            selected=f"{c}.label = _best",
        )

    listed = step(found, _best=_largest("_parts"))
    return listed.select(*keys, F.inline(F.expr(R.each("_parts", part))))


def _largest(parts: str) -> str:
    """Label of the component with the greatest area, the first one on ties."""
    ranked = R.each(parts, lambda c: R.pack(area=f"{c}.area", back=f"-{c}.label"))
    return f"(-array_max({ranked}).back)"


def _weights(chosen: str) -> str:
    """Sums of p, x*p, y*p, x and y over the selected pixels, run by run."""
    names = ("p", "xp", "yp", "x", "y")
    add = lambda s, t: R.pack(**{n: f"{s}.{n} + {t}.{n}" for n in names})

    def of_run(r: str) -> str:
        count = f"({r}.x1 - {r}.x0 + 1)"

        def moments(v: str) -> str:
            weighed = R.pairwise(v, f"sequence({r}.x0, {r}.x1)", lambda p, x: f"{p} * {x}")
            return R.pack(
                p=R.fold(v, "0D", lambda s, p: f"{s} + {p}"),
                xp=R.fold(weighed, "0D", lambda s, q: f"{s} + {q}"),
            )

        # Not slice(): it would unpack the whole map for every run.
        values = R.each(
            f"sequence({r}.x0, {r}.x1)", lambda x: f"double(get(prob, {r}.y * map_width + {x}))"
        )
        return R.bind(
            R.bind(values, moments),
            lambda m: R.pack(
                p=f"{m}.p",
                xp=f"{m}.xp",
                yp=f"{r}.y * {m}.p",
                x=f"({r}.x0 + {r}.x1) * {count} / 2",
                y=f"double({r}.y * {count})",
            ),
        )

    return R.fold(R.each(chosen, of_run), R.pack(**{n: "0D" for n in names}), add)


def component_evidence(
    df: DataFrame, threshold: float | str, mask: str | None = None
) -> DataFrame:
    """Model-space measurements of each frame's largest component, without judging them."""
    require_columns(df, MAP_COLUMNS, "Probability maps")
    found = with_components(df, _foreground(df, threshold, mask), "map_width")
    found = step(found, _best=_largest("_parts"))
    own = R.keep_at("_links", lambda r, k: f"get(_labels, {k}) = _best")
    found = step(found, _chosen=own)
    found = step(found, _w=_weights("_chosen"))
    found = step(with_border(found, "_chosen"), _area=R.area_of("_chosen"))
    border = (
        "exists(_chosen, r -> r.y = 0 OR r.y = map_height - 1 OR r.x0 = 0 OR r.x1 = map_width - 1)"
    )
    centre = lambda axis: f"CASE WHEN _w.p > 0 THEN _w.{axis}p / _w.p ELSE _w.{axis} / _area END"
    facts = {
        "selected_component_area": "_area",
        "foreground_area": R.area_of("_links"),
        "component_count": "size(_parts)",
        "component_dominance": f"_area / {R.area_of('_links')}",
        "mean_component_confidence": "_w.p / _area",
        "component_circularity": R.circularity("_area", "_border"),
        "component_touches_border": border,
        "raw_center_x_model_pixels": centre("x"),
        "raw_center_y_model_pixels": centre("y"),
    }
    counted = ("selected_component_area", "foreground_area", "component_count")
    empty = {n: "0" for n in counted} | {"component_touches_border": "false"}
    measured = {
        name: f"CASE WHEN size(_parts) = 0 THEN {empty.get(name, 'NULL')} ELSE {text} END"
        for name, text in facts.items()
    }
    return step(found, **measured).select(*df.columns, *facts)


def judge_components(df: DataFrame) -> DataFrame:
    """Quality codes, validity and visibility from the measured evidence."""
    empty = F.col("component_count") == 0
    confidence, shape = F.col("mean_component_confidence"), F.col("component_circularity")
    border = F.col("component_touches_border")
    reasons = Q.component_reasons(F.col("component_dominance"), confidence, shape, border)
    return df.withColumns(
        {
            "quality_reason": F.when(empty, Q.EMPTY).otherwise(reasons),
            "segmentation_valid": F.when(empty, False).otherwise(
                Q.component_valid(confidence, shape, border)
            ),
        }
    ).withColumn(
        "pupil_visibility", Q.visibility(F.col("quality_reason"), F.col("segmentation_valid"))
    )


def measure_frames(
    df: DataFrame,
    threshold: float | str,
    mask: str | None = None,
    keep_map: bool = False,
    model_size: int = S.MODEL_SIZE,
) -> DataFrame:
    """Everything known about one frame: components, quality codes, centre, diameters.

    A frame with an empty mask keeps its row. The centre is taken back to input pixels with
    the map's own width as the target size, the diameter with the scorer's fixed model size.
    """
    require_columns(df, [*MAP_COLUMNS, "original_width", "original_height"], "Probability maps")
    width, height = F.col("original_width"), F.col("original_height")
    found = judge_components(component_evidence(df, threshold, mask))
    centre = G.model_to_original(
        F.col("raw_center_x_model_pixels"),
        F.col("raw_center_y_model_pixels"),
        width,
        height,
        F.col("map_width"),
    )
    diameter = G.equivalent_diameter(F.col("foreground_area"))
    out = (
        found.withColumns({"_c": centre, "estimated_pupil_diameter": diameter})
        .withColumns(
            {
                "raw_center_x_pixels": F.col("_c.x"),
                "raw_center_y_pixels": F.col("_c.y"),
                "pupil_diameter_input_pixels": G.model_to_input_length(
                    F.col("estimated_pupil_diameter"), width, height, model_size
                ),
            }
        )
        .drop("_c")
    )
    return out if keep_map else out.drop("prob", *([mask] if mask else []))
