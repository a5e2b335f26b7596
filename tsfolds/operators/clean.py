"""Cleaning and projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tsfolds.plans import blocked

DATE_FMT = "M/d/yyyy"


def parse_dates(df: DataFrame, col: str = "date", fmt: str = DATE_FMT, errors: str = "raise", name: str | None = None) -> DataFrame:
    """A2: text dates (``M/D/YYYY`` by default) to DATE with the native
    parser; ``errors="null"`` turns bad input into NULL instead of failing."""
    if errors not in ("raise", "null"):
        raise ValueError("errors must be 'raise' or 'null'")
    parse = F.to_date if errors == "raise" else F.try_to_date
    return df.withColumn(name or col, parse(F.col(col), fmt))


def select_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B1: keep only the used columns (pruned down to the scan)."""
    return df.select(*cols)


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a missing (NULL or NaN) value in ``cols``."""
    return df.na.drop(subset=list(cols))


def require_all(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value."""
    return df.na.drop("any")


def drop_cols(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns (missing names are ignored)."""
    return df.drop(*cols)


def drop_blank_index(df: DataFrame) -> DataFrame:
    """The unnamed index column of an uploaded CSV (``_c0``)."""
    return df.drop("_c0") if "_c0" in df.columns else df


def _floats(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]


def fill_nan(df: DataFrame, value: float = 0.0, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace NaN (not NULL) by ``value`` in floating columns."""
    cols = list(cols) if cols is not None else _floats(df)
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(float(value))) for c in cols})


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Ingest rule: NaN becomes NULL so that aggregates skip it."""
    cols = list(cols) if cols is not None else _floats(df)
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in cols})


def ffill(df: DataFrame, cols: Sequence[str], by: Sequence[str] | str | None = "ticker", order_by: str = "date") -> DataFrame:
    """Forward fill — each NULL takes the last non-NULL value of the same
    key before it.  ``by=None`` fills over the whole table in order (the
    reference's upload fill).  Runs per time block plus a carry-over, so a
    hot key is not one task."""
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    x = blocked.running(df, by, order_by, {f"_ff_{c}": ("last", c) for c in cols})
    return x.withColumns({c: F.col(f"_ff_{c}") for c in cols}).select(*df.columns)
