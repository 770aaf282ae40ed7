"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A one-element ``transform`` keeps the value inside one JVM expression, so that
    nothing has to be exploded or shuffled to give an intermediate array a name.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns that are costly to compute, evaluating each once per row.

    A plain projection would let Spark copy the expressions into every later filter or
    column that mentions them. Behind a one-row generator they stay where they are, while
    filters on other columns still pass through to the scan.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(packed)))


def int_div(a: Column, b: Column | int) -> Column:
    """Integer quotient of two non-negative integers."""
    b = b if isinstance(b, Column) else F.lit(b)
    return ((a - a % b) / b).cast("int")


def finite(column: Column) -> Column:
    """Missing values are NULL here, never NaN."""
    return F.when(~F.isnan(column), column)


_UNITS = float(1 << 52)


def exact_sum(value: Column) -> Column:
    """A sum of doubles that has the same bits in any order of rows and any partitioning.

    Values are rounded to multiples of 2^-52, which numbers of one or more already are, and added as whole numbers;
    they must stay below 10^12 in size. A NaN or infinity among them makes the sum as usual.
    """
    usual = F.sum(value)
    fine = value.between(-1e12, 1e12)
    whole = F.sum(F.when(fine, F.rint(value * _UNITS).cast("decimal(28,0)")))
    return F.when(F.count_if(value.isNotNull() & ~fine) > 0, usual).otherwise(whole.cast("double") / _UNITS)


def exact_avg(value: Column) -> Column:
    """The mean to :func:`exact_sum`; NULL without values."""
    return exact_sum(value) / F.nullif(F.count(value), F.lit(0))


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")


def check(value: Column, ok: Column, message: str) -> Column:
    """``value``, failing the job on the first row where ``ok`` is not true."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def map_cut(df: DataFrame, threshold: float | str, column: str = "prob") -> str:
    """A threshold (a number or a column name) in the precision its map is stored in, as SQL text.

    A single-precision map must be compared in single precision, else values that equal the threshold
    in the map lie above it after widening.
    """
    if not isinstance(threshold, str) and not 0 < threshold < 1:
        raise ValueError("A prediction threshold lies between 0 and 1.")
    value = f"`{threshold}`" if isinstance(threshold, str) else f"{float(threshold)!r}D"
    single = df.schema[column].dataType.elementType == T.FloatType()
    return f"float({value})" if single else value


def unit_draw(salt: int, seed: int, *keys: Column) -> Column:
    """Deterministic value in [0, 1) from integer keys.

    Two steps of the minimal standard generator, so the same draw can be written in
    any SQL dialect and a lost task repeats exactly the same choice.
    """
    modulus = 2147483647
    state = F.lit(1 + salt * 1299709 + seed * 15485863).cast("bigint")
    for key in keys:
        state = (state * 48271 + F.pmod(key.cast("bigint"), F.lit(modulus))) % modulus
    for _ in range(2):
        state = (state * 48271 + 11) % modulus
    return state / F.lit(float(modulus))
