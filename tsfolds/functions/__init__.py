"""Scalar and aggregate expression helpers (all JVM-side Column expressions).

Rules from the data model: a division by data is ``try_divide`` (NULL instead
of an ANSI error or inf/NaN), ``ln`` is only taken of positive inputs, NaN is
turned into NULL on ingest, and NaN (not NULL) can be replaced by ``nanvl``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL."""
    return F.try_divide(col(a), col(b))


def safe_ln(x) -> Column:
    """ln(x) for x > 0, else NULL."""
    x = col(x)
    return F.when(x > 0, F.ln(x))


def fill_nan(x, value: float = 0.0) -> Column:
    """Replace NaN (not NULL) by ``value``."""
    return F.nanvl(col(x), F.lit(float(value)))


def logistic(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def yeo_johnson(x, lam: float) -> Column:
    """Yeo-Johnson power transform with a literal lambda (branches fold)."""
    x = col(x)
    if lam == 0:
        pos = F.log1p(x)
    else:
        pos = (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    if lam == 2:
        neg = -F.log1p(-x)
    else:
        neg = -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def corr_pop(x, y, w=None) -> Column:
    """Pearson correlation as an aggregate (or, with a window spec ``w``, a
    window) expression that is NULL (not an error) when either side is
    constant."""
    x, y = col(x), col(y)
    ov = (lambda e: e.over(w)) if w is not None else (lambda e: e)
    return F.try_divide(ov(F.covar_pop(x, y)), ov(F.stddev_pop(x)) * ov(F.stddev_pop(y)))


def ols_weights(xs: Sequence[float]) -> list[float]:
    """Weights c_i with slope = sum c_i * y_i for a least-squares line through
    fixed abscissae ``xs``."""
    m = sum(xs) / len(xs)
    sxx = sum((v - m) ** 2 for v in xs)
    return [(v - m) / sxx for v in xs]


def log_lags(lags: Sequence[int]) -> list[float]:
    return [math.log(v) for v in lags]


def round_all(df, digits: int = 6):
    """Round every floating column (and turn -0.0 into 0.0) for comparison."""
    from pyspark.sql.types import DoubleType, FloatType

    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append((F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
