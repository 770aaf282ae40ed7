"""Binary masks as row runs, entirely inside one row's column expressions.

A frame's mask is bounded by its own height and width, so everything that concerns one
mask is evaluated where the frame's row already is. No pixel leaves the row, hence no shuffle, whatever
the number of frames. :mod:`gazeframe.functions.labelling` continues from the runs.

A run is ``struct(y, x0, x1)``, both ends inclusive, listed in row-major order. Expressions
are composed as SQL text: a deep tree of column objects would cost one gateway call per node.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

_names = itertools.count()
Body = Callable[[str], str]


def _new(prefix: str) -> str:
    return f"{prefix}_{next(_names)}"


def bind(value: str, body: Body) -> str:
    """``body`` over the value, which is evaluated once."""
    v = _new("v")
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def each(array: str, body: Body) -> str:
    v = _new("e")
    return f"transform({array}, {v} -> {body(v)})"


def keep(array: str, test: Body) -> str:
    v = _new("k")
    return f"filter({array}, {v} -> {test(v)})"


def keep_at(array: str, test: Callable[[str, str], str]) -> str:
    v, i = _new("k"), _new("i")
    return f"filter({array}, ({v}, {i}) -> {test(v, i)})"


def pairwise(a: str, b: str, body: Callable[[str, str], str]) -> str:
    x, y = _new("a"), _new("b")
    return f"zip_with({a}, {b}, ({x}, {y}) -> {body(x, y)})"


def fold(array: str, zero: str, step: Callable[[str, str], str], finish: Body | None = None) -> str:
    s, r = _new("s"), _new("r")
    if finish is None:
        return f"aggregate({array}, {zero}, ({s}, {r}) -> {step(s, r)})"
    f = _new("f")
    return f"aggregate({array}, {zero}, ({s}, {r}) -> {step(s, r)}, {f} -> {finish(f)})"


def pack(**fields: str) -> str:
    return "named_struct({})".format(", ".join(f"'{k}', {v}" for k, v in fields.items()))


def run(y: str, x0: str, x1: str) -> str:
    return pack(y=f"int({y})", x0=f"int({x0})", x1=f"int({x1})")


def foreground(pixels: str, is_set: Body) -> str:
    """Ascending flat indices of the set pixels of an array."""
    v, i = _new("p"), _new("i")
    marked = f"transform({pixels}, ({v}, {i}) -> CASE WHEN {is_set(v)} THEN {i} END)"
    return keep(marked, lambda k: f"{k} IS NOT NULL")


def runs_of(pixels: str, width: str) -> str:
    """Row runs of ascending flat pixel indices."""

    def split(a: str) -> str:
        starts = keep_at(a, lambda i, k: f"{k} = 0 OR get({a}, {k} - 1) < {i} - 1 OR {i} % {width} = 0")
        stops = keep_at(
            a,
            lambda i, k: f"{k} = size({a}) - 1 OR get({a}, {k} + 1) > {i} + 1 "
            f"OR {i} % {width} = {width} - 1",
        )
        return pairwise(
            starts, stops, lambda s, e: run(f"{s} div {width}", f"{s} % {width}", f"{e} % {width}")
        )

    return bind(pixels, split)


def area_of(runs: str) -> str:
    return fold(runs, "0", lambda s, r: f"{s} + {r}.x1 - {r}.x0 + 1")


def circularity(area: str, border: str) -> str:
    ratio = f"{4.0 * math.pi!r}D * {area} / ({border} * {border})"
    return f"CASE WHEN {border} > 0 THEN {ratio} ELSE 0D END"
