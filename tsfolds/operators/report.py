"""Walk-forward reporting: return index, drawdown, Sharpe ratio, run summary,
learning curve, wide render report (SURVEY D11-D13, E5, E6, E8, G12)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfolds.functions import safe_div
from tsfolds.operators import features
from tsfolds.plans import blocked

PERIODS = 252


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def validation_returns(ledger: DataFrame, value="market_value", run="run_id", chunk="chunk", order_by="date", name="ret",
                       chunks=None) -> DataFrame:
    """Log returns of the market value per (run, chunk); the first return
    of every chunk is NULL and no return spans two chunks.  ``chunks`` keeps
    some chunks only (the reference's summary takes 1 to one before the last)."""
    if chunks is not None:
        ledger = ledger.where(F.col(chunk).isin(list(chunks)))
    return features.log_return(ledger, value, [run, chunk], order_by, name)


def return_index(df: DataFrame, ret="ret", by="run_id", order_by="date", name="ret_index", base: float = 100.0) -> DataFrame:
    """E5: ``base * exp(cumsum(r))``; rows with a NULL return stay NULL and
    are skipped by the running sum."""
    x = blocked.running(df, _by(by), order_by, {"_cs": ("sum", ret)})
    return x.withColumn(name, F.when(F.col(ret).isNotNull(), F.lit(base) * F.exp(F.col("_cs")))).drop("_cs")


def drawdown(df: DataFrame, index="ret_index", by="run_id", order_by="date", name="drawdown") -> DataFrame:
    """``100 * (idx - cummax(idx)) / cummax(idx)``; NULL where idx is NULL."""
    x = blocked.running(df, _by(by), order_by, {"_cm": ("max", index)})
    return x.withColumn(name, F.when(F.col(index).isNotNull(), 100.0 * safe_div(F.col(index) - F.col("_cm"), F.col("_cm")))).drop("_cm")


def returns_drawdown(df: DataFrame, ret="ret", by="run_id", order_by="date", base: float = 100.0) -> DataFrame:
    """E5 and E6 together in one blocked scan: the running max of the index
    is base * exp(running max of the cumulative sum)."""
    x = blocked.running_sum_peak(df, _by(by), order_by, ret, "_cs", "_cm")
    idx = F.lit(base) * F.exp(F.col("_cs"))
    return x.withColumns(
        {
            "ret_index": F.when(F.col(ret).isNotNull(), idx),
            "drawdown": F.when(F.col(ret).isNotNull(), 100.0 * (F.exp(F.col("_cs") - F.col("_cm")) - 1.0)),
        }
    ).drop("_cs", "_cm")


def sharpe_expr(ret: str = "ret", periods: int = PERIODS):
    """Mean / sample std * sqrt(periods) as an aggregate expression."""
    return safe_div(F.avg(ret), F.stddev_samp(ret)) * F.lit(math.sqrt(periods))


def sharpe(returns: DataFrame, ret="ret", by: Sequence[str] | str = "run_id", periods: int = PERIODS) -> DataFrame:
    """D11 per group (partial aggregation: a hot run is pre-aggregated)."""
    return returns.groupBy(*_by(by)).agg(sharpe_expr(ret, periods).alias("sharpe"))


def summary(returns: DataFrame, ret="ret", by="run_id", order_by="date", periods: int = PERIODS) -> DataFrame:
    """Sharpe ratio, final return index, max drawdown and count of
    returns per group (index and drawdown run over the whole group)."""
    by = _by(by)
    x = returns_drawdown(returns, ret, by, order_by)
    return x.groupBy(*by).agg(
        sharpe_expr(ret, periods).alias("sharpe"),
        F.max_by("ret_index", F.when(F.col("ret_index").isNotNull(), F.col(order_by))).alias("final_index"),
        F.min("drawdown").alias("max_drawdown"),
        F.count(ret).alias("n"),
    )


def learning_curve(logs: DataFrame, by="run", order_by="t", reward="r", length="l", window: int = 10) -> DataFrame:
    """Cumulative episode length (timesteps) against the reward smoothed
    over ``window`` episodes (valid mode)."""
    x = blocked.running(logs, _by(by), order_by, {"timesteps": ("sum", length)})
    return features.moving_average(x, reward, window, by, order_by, name="reward_ma")


def render_wide(ledger: DataFrame, symbols: Sequence[str], values: Sequence[str] = ("leverage", "action"),
                by=("run_id", "date"), ticker="ticker") -> DataFrame:
    """One row per (run, date) with ``<value>_<symbol>`` columns; the
    symbol list is explicit so the pivot needs no extra job."""
    g = ledger.groupBy(*_by(by)).pivot(ticker, list(symbols)).agg(*[F.max(v).alias(v) for v in values])
    ren = {}
    for s in symbols:
        for v in values:
            src = f"{s}_{v}" if len(values) > 1 else s
            ren[src] = f"{v}_{s}"
    return g.withColumnsRenamed(ren)
