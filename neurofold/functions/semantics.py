"""Numeric rules that differ between array languages and SQL, pinned down once.

Rounding is half away from zero; the deviation of one value is 0; comparisons with NaN
are false; a constant sample has no correlation (NaN) instead of an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def mround(x: float) -> int:
    """Half away from zero, for parameters on the driver."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def exceeds(value: Column, limit: Column | float) -> Column:
    """value > limit, false for NaN and null."""
    return F.coalesce(~F.isnan(value) & (value > limit), F.lit(False))


def std0(value: Column) -> Column:
    """Sample deviation; 0 for one value, NaN for none."""
    n = F.count(value)
    return F.when(n == 0, F.lit(NAN)).when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(value))


def mean0(value: Column) -> Column:
    """Mean; NaN of nothing."""
    return F.coalesce(F.avg(value), F.lit(NAN))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; NaN where either side is constant."""
    sxy, sxx, syy = F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)
    return F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy)).otherwise(F.lit(NAN))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope; 0 of a single point."""
    return F.coalesce(F.regr_slope(y, x), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b with NaN for 0/0 and signed infinities for x/0."""
    zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(NAN))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def to_index(y: Column, x: Column, height: int) -> Column:
    """1-based column-major linear index."""
    return (x - 1) * height + y


def to_yx(ind: Column, height: int) -> tuple[Column, Column]:
    x = F.ceil(ind / height)
    return (ind - (x - 1) * height).cast("long"), x.cast("long")


def saturate16(v: Column) -> Column:
    return F.least(F.lit(65535), F.greatest(F.lit(0), v))
