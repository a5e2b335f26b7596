"""Ingest of an uploaded panel as one step: required columns, derived columns, projection, start date,
walk-forward folds, standardisation on each fold's train part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfolds.operators import clean, features, folds

REQUIRED = ("close", "datekey")
OHLC = ("open", "high", "low", "close")


def process(df: DataFrame, used: Sequence[str], macro: Sequence[str] = (), start_date=None, by: str = "ticker", date_col: str = "date") -> DataFrame:
    """Rows with a close, a date key and a spot (the adjusted close); the ``used`` and ``macro`` columns, ``spot``,
    ``release_indicator`` (revenue differs from the row before) and ``intraday_vol``; rows from
    ``start_date`` on, where one is given (the indicator still sees the row before it)."""
    x = features.base_columns(clean.require(df, REQUIRED))
    x = clean.require(x, ["spot"])
    names = list(dict.fromkeys([date_col, by, *used, *macro, "spot", "revenue", *OHLC]))
    x = features.release_indicator(clean.select_features(x, names), "revenue", by, date_col)
    x = features.rogers_satchell(x)
    if start_date is not None:
        x = x.where(F.col(date_col) >= F.lit(start_date).cast(x.schema[date_col].dataType))
    return x.select(*dict.fromkeys([date_col, by, *used, *macro, "spot", "release_indicator", "intraday_vol"]))


def walk_forward(df: DataFrame, cols: Sequence[str], periods: int = 5, period_length: int = 0, date_col: str = "date") -> DataFrame:
    """Every fold's train and test rows (``fold``, ``role``) with ``cols`` standardised by the fold's train
    part; ``period_length`` dates per chunk, or else ``periods`` chunks."""
    k = folds.count_for_length(df, period_length, date_col) if period_length else periods
    chunked = folds.equal(df, k, date_col)
    return folds.standardize_train_test(chunked, cols, "chunk", k)
