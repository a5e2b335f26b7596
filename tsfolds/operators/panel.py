"""Panel lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from tsfolds.operators import clean
from tsfolds.operators.folds import date_index


def at_date(df: DataFrame, d, date_col: str = "date") -> DataFrame:
    """B2: rows of one date (pushed down to the scan)."""
    return df.where(F.col(date_col) == F.lit(d).cast(df.schema[date_col].dataType))


def at_dates(df: DataFrame, dates, date_col: str = "date") -> DataFrame:
    """Rows whose date is in a list (``isin``) or in a table of dates
    (semi-join; a DATE table has at most one row per calendar day, so it is
    broadcast)."""
    if isinstance(dates, (list, tuple, set)):
        return df.where(F.col(date_col).isin(list(dates)))
    keys = dates.select(F.col(dates.columns[0]).alias(date_col)).distinct()
    if isinstance(keys.schema[date_col].dataType, DateType):
        keys = F.broadcast(keys)
    return df.join(keys, date_col, "left_semi")


def dates(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Distinct dates."""
    return df.select(date_col).distinct()


def symbols(df: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Distinct symbols."""
    return df.select(ticker).distinct()


def with_step(df: DataFrame, date_col: str = "date", name: str = "step") -> DataFrame:
    """Position of each row's date among the sorted distinct dates."""
    idx = date_index(df, date_col).withColumnRenamed("date_idx", name)
    if isinstance(df.schema[date_col].dataType, DateType):
        idx = F.broadcast(idx)
    return df.join(idx, date_col, "left")  # a row without a date has no step


def date_bounds(df: DataFrame, date_col: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """First and last date (per key)."""
    return df.groupBy(*by).agg(F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"))


def symbol_count(df: DataFrame, ticker: str = "ticker", approx: bool = False) -> DataFrame:
    """Number of distinct symbols (HyperLogLog when ``approx``)."""
    agg = F.approx_count_distinct(ticker) if approx else F.count_distinct(ticker)
    return df.agg(agg.alias("n_symbols"))


def concat(*dfs: DataFrame, allow_missing: bool = False) -> DataFrame:
    """H3: union all by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=allow_missing)
    return out


def sample_windows(df: DataFrame, length: int, n: int, seed: int = 0, date_col: str = "date") -> DataFrame:
    """``n`` random episodes of ``length`` consecutive dates (seeded);
    returns the panel rows of each episode with an ``episode`` id.  Episode
    starts come from a hash of (seed, episode) over the feasible positions, so
    they do not depend on how the table is partitioned."""
    idx = date_index(df, date_col)
    nd = idx.count()  # one number: the feasible start range
    if nd < length:
        raise ValueError(f"{nd} dates, episode length {length}")
    eps = (
        df.sparkSession.range(n).withColumnRenamed("id", "episode")
        .withColumn("_start", _hash32(F.concat(F.lit(f"{seed}:"), F.col("episode").cast("string"))) % F.lit(nd - length + 1))
        .withColumn("date_idx", F.explode(F.sequence(F.col("_start"), F.col("_start") + length - 1)))
        .select("episode", "date_idx")
    )
    dated = eps.join(idx, "date_idx").select("episode", date_col)
    return df.join(dated, date_col)


def _hash32(text):
    """The first 32 bits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def densify(df: DataFrame, cols: Sequence[str], by: str = "ticker", date_col: str = "date", fill: bool = True) -> DataFrame:
    """Dense daily grid per key from its first to its last date (a generated
    spine per key, not a cross join), left-joined with the panel and forward
    filled (E1)."""
    b = df.groupBy(by).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    spine = b.select(by, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(date_col))
    out = spine.join(df, [by, date_col], "left")
    return clean.ffill(out, cols, by, date_col) if fill else out
