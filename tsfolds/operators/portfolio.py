"""Portfolio accounting from tables of signals, orders and prices
(SURVEY 2.G, E21, E22).

The reference steps a simulator one date at a time; here every date of every
run is computed at once: running sums per (run, ticker) for positions and
model portfolios, per-(run, date) sums for weights, orders and slippage, and
a closed form of the interest-bearing cash recursion

    cash_s = cash_{s-1} (1 + g) - flow_s,  cash_{-1} = B0
           = (1 + g)^s [ (1 + g) B0 - sum_{u<=s} flow_u (1 + g)^-u ]

which is one running sum per run.  Running sums go through
:mod:`tsfolds.plans.blocked` (time blocks plus carry-over).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsfolds.functions import logistic, safe_div, safe_ln, yeo_johnson
from tsfolds.plans import blocked
from tsfolds.session import cut

# Fixed values of the reference's trading environment.
RATE = 0.01  # yearly interest on cash
PERIODS = 252  # trading days per year
COST = 0.0025  # transaction cost per unit of traded value
REBALANCE_EVERY = 20  # steps between forced trade days
MAX_DEV_FLOOR = 0.1  # lower bound of the per-step deviation budget
DEFAULT_VOL = 0.05  # volatility used when the return history is empty or flat
STOP_FRACTION = 0.5  # a run ends once value < this x initial balance


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def model(signals: DataFrame, signal: str = "signal", by=("run_id", "ticker"), order_by: str = "date", name: str = "model") -> DataFrame:
    """G1: model portfolio = running sum of the signals per (run, ticker)."""
    return blocked.running(signals, _by(by), order_by, {name: ("sum", signal)})


def weights(df: DataFrame, model_col: str = "model", long_leverage=1.0, short_leverage=1.0,
            by=("run_id", "date"), name: str = "target_weight") -> DataFrame:
    """Longs scaled to sum to ``long_leverage``, shorts to
    ``short_leverage`` (sign kept), zero stays 0.  Leverages may be columns.
    The window is one (run, date): bounded by the symbol universe."""
    w = Window.partitionBy(*_by(by))
    m = F.col(model_col)
    lon = F.sum(F.when(m > 0, m)).over(w)
    sho = F.sum(F.when(m < 0, -m)).over(w)
    ll = F.col(long_leverage) if isinstance(long_leverage, str) else F.lit(float(long_leverage))
    sl = F.col(short_leverage) if isinstance(short_leverage, str) else F.lit(float(short_leverage))
    val = F.when(m > 0, safe_div(m, lon) * ll).when(m < 0, safe_div(m, sho) * sl).otherwise(F.lit(0.0))
    return df.withColumn(name, val)


def trade_days(df: DataFrame, signal: str = "trade_signal", step: str = "step", name: str = "trade_today") -> DataFrame:
    """A trade day when the trade signal is positive or every 20th step."""
    return df.withColumn(name, (F.col(signal) > 0) | (F.col(step) % REBALANCE_EVERY == 0))


def rebalance_orders(df: DataFrame, target: str = "target_weight", actual: str = "actual_weight", value: str = "value",
                     price: str = "price", step: str = "step", by=("run_id", "date")) -> DataFrame:
    """deviation = target - actual weight, scaled so that the sum of
    |deviation| is at most max(1 / (1 + step/2), 0.1); order quantity =
    deviation * portfolio value / price."""
    w = Window.partitionBy(*_by(by))
    dev = F.col(target) - F.col(actual)
    tot = F.sum(F.abs(dev)).over(w)
    budget = F.greatest(1.0 / (1.0 + F.col(step) / 2.0), F.lit(MAX_DEV_FLOOR))
    scaled = safe_div(dev, tot) * F.least(tot, budget)
    return df.withColumn("deviation", scaled).withColumn("qty", safe_div(F.col("deviation") * F.col(value), F.col(price)))


def slippage(orders: DataFrame, qty: str = "qty", price: str = "exec_price", cost: float = COST,
             by=("run_id", "date")) -> DataFrame:
    """Paid slippage per (run, date) = sum |q| * price * cost."""
    return orders.groupBy(*_by(by)).agg(F.sum(F.abs(F.col(qty)) * F.col(price) * F.lit(cost)).alias("paid_slippage"))


def grid(orders: DataFrame, prices: DataFrame, run: str = "run_id", ticker: str = "ticker", date_col: str = "date",
         qty: str = "qty", price: str = "price") -> DataFrame:
    """The dense (run, ticker, date) grid: every price date of every ticker a
    run trades (equi-join on ticker, not a cross join) and every date with an
    order, with the order quantity (0 when none), the mark (on a date without
    a price the last one before it) and the execution price (the previous mark;
    the first mark on a ticker's first date)."""
    pairs = orders.select(run, ticker).distinct()
    g = prices.join(pairs, ticker).join(orders.select(run, ticker, date_col, qty), [run, ticker, date_col], "full")
    g = g.withColumn(qty, F.coalesce(F.col(qty), F.lit(0.0)))
    g = blocked.running(g, [run, ticker], date_col, {"_mark": ("last", price)}).withColumn(price, F.col("_mark")).drop("_mark")
    return blocked.rolling(
        g, [run, ticker], date_col, 1,
        lambda w: {"exec_price": F.coalesce(F.lag(price).over(w), F.col(price))},
    )


def positions(g: DataFrame, qty: str = "qty", by=("run_id", "ticker"), order_by: str = "date", name: str = "position") -> DataFrame:
    """Running signed quantity per (run, ticker) on the dense grid."""
    return blocked.running(g, _by(by), order_by, {name: ("sum", qty)})


def cash(g: DataFrame, b0: float = 1000.0, rate: float = RATE, cost: float = COST, run: str = "run_id",
         date_col: str = "date", qty: str = "qty", exec_price: str = "exec_price", rates: DataFrame | None = None) -> DataFrame:
    """Cash per (run, date): daily interest on the previous balance, minus
    traded value and costs at the execution price.  Returns (run, date,
    step, flow, paid_slippage, balance).  ``rates`` (date, rate) gives each date a yearly rate of its own; dates
    without one take ``rate``.  The balance is an affine recursion, scanned in blocks."""
    flows = g.groupBy(run, date_col).agg(
        F.sum(F.col(qty) * F.col(exec_price) + F.abs(F.col(qty)) * F.col(exec_price) * F.lit(cost)).alias("flow"),
        F.sum(F.abs(F.col(qty)) * F.col(exec_price) * F.lit(cost)).alias("paid_slippage"),
    )
    x = blocked.rolling(flows, [run], date_col, 0, lambda w: {}, with_step="step")
    own = x.columns
    yearly = F.lit(float(rate))
    if rates is not None:
        x = x.join(F.broadcast(rates.select(date_col, F.col("rate").alias("_rate"))), date_col, "left")  # one row per calendar day
        yearly = F.coalesce("_rate", yearly)
    grow = 1.0 + yearly / PERIODS
    x = blocked.affine(x, [run], date_col, {"balance": (grow, -F.coalesce("flow", F.lit(0.0)), b0)})
    return x.select(*own, "balance")


def valuation(g: DataFrame, cash_df: DataFrame, run: str = "run_id", date_col: str = "date", price: str = "price",
              position: str = "position") -> DataFrame:
    """Net / gross position value, market value = cash + net value, and
    gross leverage per (run, date)."""
    pv = g.groupBy(run, date_col).agg(
        F.sum(F.col(position) * F.col(price)).alias("net_value"),
        F.sum(F.abs(F.col(position)) * F.col(price)).alias("gross_value"),
        F.sum(F.when(F.col(position) > 0, F.col(position) * F.col(price))).alias("long_value"),
        F.sum(F.when(F.col(position) < 0, -F.col(position) * F.col(price))).alias("short_value"),
    )
    x = cash_df.join(pv, [run, date_col])
    mv = F.col("balance") + F.col("net_value")
    return x.withColumns(
        {
            "market_value": mv,
            "gross_leverage": safe_div(F.col("gross_value"), mv),
            "long_weight": safe_div(F.coalesce(F.col("long_value"), F.lit(0.0)), mv),
            "short_weight": safe_div(F.coalesce(F.col("short_value"), F.lit(0.0)), mv),
        }
    )


def net_weights(g: DataFrame, val: DataFrame, run: str = "run_id", date_col: str = "date", price: str = "price",
                position: str = "position", name: str = "leverage") -> DataFrame:
    """Per ticker weight = position value / market value."""
    return g.join(val.select(run, date_col, "market_value"), [run, date_col]).withColumn(
        name, safe_div(F.col(position) * F.col(price), F.col("market_value"))
    )


def excess_return(df: DataFrame, value: str = "market_value", rate: float = RATE, by="run_id", order_by: str = "date",
                  name: str = "excess_ret") -> DataFrame:
    """``ln(v / v_prev) - rate/252``, with -1 in place of the log when
    v <= 0; the first row of a run has no previous value (NULL)."""
    rf = rate / PERIODS

    def build(w):
        prev = F.lag(value).over(w)
        lr = F.when(F.col(value) <= 0, F.lit(-1.0)).otherwise(safe_ln(safe_div(F.col(value), prev)))
        return {name: F.when(prev.isNotNull(), lr - F.lit(rf))}

    return blocked.rolling(df, _by(by), order_by, 1, build)


def expanding_vol(df: DataFrame, ret: str = "excess_ret", by="run_id", order_by: str = "date", name: str = "ret_vol") -> DataFrame:
    """Population std of all returns so far; 0.05 when there is none or
    it is 0 (count, mean and M2 per block, merged; a deviation within the
    rounding error of the values is 0)."""
    x = blocked.running_moments(df, _by(by), order_by, ret, "_n", "_m2")
    sd = F.sqrt(safe_div(F.col("_m2"), F.col("_n")))
    flat = sd <= F.coalesce(F.abs(F.col(ret)), F.lit(0.0)) * 1e-14
    return x.withColumn(name, F.when((F.col("_n") > 0) & (sd > 0) & ~flat, sd).otherwise(F.lit(DEFAULT_VOL))).drop("_n", "_m2")


def risk_adjusted_score(df: DataFrame, ret: str = "excess_ret", vol: str = "ret_vol", lam: float = 0.9, name: str = "score") -> DataFrame:
    """``logistic(yeo_johnson(excess return / volatility, lambda))``."""
    return df.withColumn(name, logistic(yeo_johnson(safe_div(F.col(ret), F.col(vol)), lam)))


def truncate_runs(df: DataFrame, value: str = "market_value", initial: float = 1000.0, ep_length: int | None = None,
                  by="run_id", order_by: str = "date", step: str = "step") -> DataFrame:
    """Keep each run up to and including the first date whose value is
    below half the initial balance, and (optionally) the first
    ``ep_length - 1`` steps."""
    stop = F.coalesce((F.col(value) < F.lit(STOP_FRACTION * initial)).cast("int"), F.lit(0))  # a missing value stops nothing
    x = blocked.running(df.withColumn("_stop", stop), _by(by), order_by, {"_seen": ("sum", "_stop")})
    keep = (F.col("_seen") == 0) | ((F.col("_seen") == 1) & (F.col("_stop") == 1))
    if ep_length is not None:
        keep = keep & (F.col(step) < ep_length - 1)
    return x.where(keep).drop("_stop", "_seen")


def ledger(orders: DataFrame, prices: DataFrame, b0: float = 1000.0, rate: float = RATE, cost: float = COST,
           lam: float = 0.9, run: str = "run_id") -> DataFrame:
    """The render ledger per (run, date): market value, balance, paid
    slippage, score, gross leverage, long and short weight.  The grid and the
    valuation are checkpointed: each later stage starts from a short lineage."""
    g = cut(positions(grid(orders, prices, run)))
    val = cut(valuation(g, cash(g, b0, rate, cost, run), run))
    x = excess_return(val, "market_value", rate, run)
    x = expanding_vol(x, "excess_ret", run)
    x = risk_adjusted_score(x, "excess_ret", "ret_vol", lam)
    return x.select(run, "date", "step", "market_value", "balance", "paid_slippage", "score", "gross_leverage",
                    "long_weight", "short_weight")
