"""Queries for portfolio accounting and run reports (G, D12, E21, E22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfolds.operators import folds, portfolio, report
from tsfolds.plans.fixtures import with_views
from tsfolds.plans.queries import query, v
from tsfolds.session import cut

B0 = 1.0e7  # initial cash of every run
G1 = 1.0 + portfolio.RATE / portfolio.PERIODS
LAM = 0.9
MONEY = 1  # decimals kept for money amounts (values reach 1e8)

GRID_SQL = f""", pairs as (select distinct run_id, ticker from orders_q),
g0 as (select r.run_id, p.ticker, p.date, p.price, coalesce(o.qty, 0.0) as qty
       from prices p join pairs r on p.ticker = r.ticker
       left join orders_q o on o.run_id = r.run_id and o.ticker = p.ticker and o.date = p.date),
g as (select *, coalesce(lag(price) over w, price) as exec_price,
             sum(qty) over (partition by run_id, ticker order by date rows between unbounded preceding and current row) as position
      from g0 window w as (partition by run_id, ticker order by date)),
f as (select run_id, date, sum(qty * exec_price + abs(qty) * exec_price * {portfolio.COST}) as flow,
             sum(abs(qty) * exec_price * {portfolio.COST}) as paid_slippage from g group by run_id, date),
c0 as (select *, row_number() over (partition by run_id order by date) - 1 as step from f),
c as (select *, pow({G1!r}, step) * ({G1 * B0!r} - sum(flow * pow({G1!r}, -step)) over
        (partition by run_id order by date rows between unbounded preceding and current row)) as balance from c0),
pv as (select run_id, date, sum(position * price) as net_value, sum(abs(position) * price) as gross_value,
              sum(case when position > 0 then position * price end) as long_value,
              sum(case when position < 0 then -position * price end) as short_value from g group by run_id, date),
val as (select c.*, pv.net_value, pv.gross_value, c.balance + pv.net_value as market_value,
               pv.gross_value / nullif(c.balance + pv.net_value, 0) as gross_leverage,
               coalesce(pv.long_value, 0) / nullif(c.balance + pv.net_value, 0) as long_weight,
               coalesce(pv.short_value, 0) / nullif(c.balance + pv.net_value, 0) as short_weight
        from c join pv on c.run_id = pv.run_id and c.date = pv.date),
ex as (select *, case when lag(market_value) over w is null then null
                      when market_value <= 0 then -1.0
                      when market_value / lag(market_value) over w > 0 then ln(market_value / lag(market_value) over w)
                 end - {portfolio.RATE / portfolio.PERIODS!r} as excess_ret
       from val window w as (partition by run_id order by date)),
vo as (select *, stddev_pop(excess_ret) over w as sd_
       from ex window w as (partition by run_id order by date rows between unbounded preceding and current row)),
vv as (select *, case when sd_ > 0 then sd_ else {portfolio.DEFAULT_VOL} end as ret_vol from vo),
yj as (select *, excess_ret / ret_vol as z_ from vv),
sc as (select *, 1 / (1 + exp(-(case when z_ >= 0 then (pow(z_ + 1, {LAM}) - 1) / {LAM}
                                     else -(pow(1 - z_, {2 - LAM!r}) - 1) / {2 - LAM!r} end))) as score from yj)"""


def _grid(spark, sf_dir):
    return portfolio.grid(v(spark, sf_dir, "orders_q"), v(spark, sf_dir, "prices"))


def _ledger_full(spark, sf_dir):
    g = cut(portfolio.positions(_grid(spark, sf_dir)))
    val = cut(portfolio.valuation(g, portfolio.cash(g, B0)))
    x = portfolio.excess_return(val)
    x = portfolio.expanding_vol(x)
    return portfolio.risk_adjusted_score(x, lam=LAM)


def _m(c: str) -> str:
    return f"round({c}, {MONEY}) + 0.0"


def _money(df, *cols):
    return df.withColumns({c: F.round(F.col(c), MONEY) for c in cols})


@query("g1_model", with_views("""select run_id, ticker, date,
  round(sum(cast(sign(qty) as double)) over (partition by run_id, ticker order by date rows between unbounded preceding and current row), 6) + 0.0 as model
from orders_q""", "orders_q"))
def g1_model(spark, sf_dir):
    """G1: model portfolio = running sum of signals (cast(sign(qty) as double))."""
    s = v(spark, sf_dir, "orders_q").withColumn("signal", F.signum("qty"))
    return portfolio.model(s).select("run_id", "ticker", "date", "model")


MODEL_SQL = """m as (select run_id, ticker, date, qty, sum(cast(sign(qty) as double)) over
        (partition by run_id, ticker order by date rows between unbounded preceding and current row) as model from orders_q),
wt as (select *, case when model > 0 then model / nullif(sum(case when model > 0 then model end) over d, 0) * 1.0
                      when model < 0 then model / nullif(sum(case when model < 0 then -model end) over d, 0) * 0.5
                      else 0.0 end as target_weight
       from m window d as (partition by run_id, date))"""


@query("g2_weights", with_views(f""", {MODEL_SQL}
select run_id, ticker, date, round(target_weight, 6) + 0.0 as target_weight from wt""", "orders_q"))
def g2_weights(spark, sf_dir):
    """Longs scaled to 1.0, shorts to 0.5 per (run, date)."""
    s = v(spark, sf_dir, "orders_q").withColumn("signal", F.signum("qty"))
    return portfolio.weights(portfolio.model(s), "model", 1.0, 0.5).select("run_id", "ticker", "date", "target_weight")


@query("g4_rebalance_orders", with_views(f""", {MODEL_SQL},
st as (select *, dense_rank() over (partition by run_id order by date) - 1 as step,
              coalesce(lag(target_weight) over (partition by run_id, ticker order by date), 0.0) as actual_weight from wt),
j as (select st.*, p.price from st join prices p on st.ticker = p.ticker and st.date = p.date),
dv as (select *, target_weight - actual_weight as dev, sum(abs(target_weight - actual_weight)) over (partition by run_id, date) as tot from j),
o as (select *, (dev / nullif(tot, 0)) * least(tot, greatest(1.0 / (1.0 + step / 2.0), {portfolio.MAX_DEV_FLOOR})) as deviation from dv)
select run_id, ticker, date, step, round(deviation, 6) + 0.0 as deviation,
       round(deviation * 1000.0 / nullif(price, 0), 6) + 0.0 as qty from o""", "orders_q", "prices"))
def g4_rebalance_orders(spark, sf_dir):
    """Rebalance orders toward the target weights from the previous
    targets as holdings (value 1000), with the step-dependent budget."""
    from tsfolds.plans import blocked

    s = v(spark, sf_dir, "orders_q").withColumn("signal", F.signum("qty"))
    w = portfolio.weights(portfolio.model(s), "model", 1.0, 0.5).drop("qty")
    w = blocked.rolling(w, ["run_id", "ticker"], "date", 1,
                        lambda ws: {"actual_weight": F.coalesce(F.lag("target_weight").over(ws), F.lit(0.0))})
    steps = blocked.rolling(w.select("run_id", "date").distinct(), ["run_id"], "date", 0, lambda ws: {}, with_step="step")
    x = w.join(steps, ["run_id", "date"]).join(v(spark, sf_dir, "prices"), ["ticker", "date"]).withColumn("value", F.lit(1000.0))
    return portfolio.rebalance_orders(x).select("run_id", "ticker", "date", "step", "deviation", "qty")


@query("g3_trade_days", with_views(GRID_SQL + """
select run_id, date, step, flow > 0 or step % 20 = 0 as trade_today from c""", "orders_q", "prices"))
def g3_trade_days(spark, sf_dir):
    """Trade day when the day's net flow is positive or every 20th step."""
    c = portfolio.cash(portfolio.positions(_grid(spark, sf_dir)), B0)
    return portfolio.trade_days(c, "flow", "step").select("run_id", "date", "step", "trade_today")


@query("g5_slippage", with_views(GRID_SQL + f"\nselect run_id, date, {_m('paid_slippage')} as paid_slippage from f",
                                 "orders_q", "prices"))
def g5_slippage(spark, sf_dir):
    """Paid slippage per (run, date) at the execution price."""
    return _money(portfolio.slippage(_grid(spark, sf_dir)), "paid_slippage")


@query("g6_positions", with_views(GRID_SQL + """
select run_id, ticker, date, round(position, 6) + 0.0 as position, round(exec_price, 6) + 0.0 as exec_price from g""",
                                  "orders_q", "prices"))
def g6_positions(spark, sf_dir):
    """Running position per (run, ticker) on the dense grid."""
    return portfolio.positions(_grid(spark, sf_dir)).select("run_id", "ticker", "date", "position", "exec_price")


@query("g7_cash", with_views(GRID_SQL + f"\nselect run_id, date, step, {_m('flow')} as flow, {_m('balance')} as balance from c",
                             "orders_q", "prices"))
def g7_cash(spark, sf_dir):
    """Interest-bearing cash ledger per run (closed form)."""
    c = portfolio.cash(portfolio.positions(_grid(spark, sf_dir)), B0)
    return _money(c.select("run_id", "date", "step", "flow", "balance"), "flow", "balance")


@query("g7_cash_varying_rate", with_views(GRID_SQL + f""", ra as (select run_id, date, step, flow, 1 + (month(date) % 5) * 0.01 / {portfolio.PERIODS} as g from c),
ba as (select * from (with recursive r(run_id, step, balance) as (select run_id, step, g * {B0} - flow from ra where step = 0
    union all select ra.run_id, ra.step, ra.g * r.balance - ra.flow from r join ra on ra.run_id = r.run_id and ra.step = r.step + 1) select * from r))
select ra.run_id, ra.date, ra.step, {_m('ra.flow')} as flow, {_m('ba.balance')} as balance from ra join ba on ra.run_id = ba.run_id and ra.step = ba.step""",
                                          "orders_q", "prices"))
def g7_cash_varying_rate(spark, sf_dir):
    """G7 with a rate for each date."""
    grid = portfolio.positions(_grid(spark, sf_dir))
    rates = grid.select("date").distinct().withColumn("rate", F.month("date") % 5 * 0.01)
    c = portfolio.cash(grid, B0, rates=rates)
    return _money(c.select("run_id", "date", "step", "flow", "balance"), "flow", "balance")


@query("g8_valuation", with_views(GRID_SQL + f"""
select run_id, date, {_m('market_value')} as market_value, {_m('net_value')} as net_value, {_m('gross_value')} as gross_value,
       round(gross_leverage, 6) + 0.0 as gross_leverage, round(long_weight, 6) + 0.0 as long_weight,
       round(short_weight, 6) + 0.0 as short_weight from val""", "orders_q", "prices"))
def g8_valuation(spark, sf_dir):
    """Market value, net / gross position value and leverage per (run, date)."""
    g = cut(portfolio.positions(_grid(spark, sf_dir)))
    val = portfolio.valuation(g, portfolio.cash(g, B0))
    return _money(val.select("run_id", "date", "market_value", "net_value", "gross_value", "gross_leverage", "long_weight",
                             "short_weight"), "market_value", "net_value", "gross_value")


@query("g9_score", with_views(GRID_SQL + """
select run_id, date, round(excess_ret, 6) + 0.0 as excess_ret, round(ret_vol, 6) + 0.0 as ret_vol, round(score, 6) + 0.0 as score
from sc""", "orders_q", "prices"))
def g9_score(spark, sf_dir):
    """Excess log return, expanding volatility and the
    risk-adjusted score logistic(yeo_johnson(ret / vol, 0.9))."""
    return _ledger_full(spark, sf_dir).select("run_id", "date", "excess_ret", "ret_vol", "score")


@query("g10_truncate_runs", with_views(GRID_SQL + f""",
t as (select *, sum(case when market_value < {0.5 * B0} then 1 else 0 end) over
        (partition by run_id order by date rows between unbounded preceding and current row) as seen_ from sc)
select run_id, date, step, {_m('market_value')} as market_value from t
where seen_ = 0 or (seen_ = 1 and market_value < {0.5 * B0})""", "orders_q", "prices"))
def g10_truncate_runs(spark, sf_dir):
    """Each run up to its first date with value below half the initial cash."""
    t = portfolio.truncate_runs(_ledger_full(spark, sf_dir), "market_value", B0)
    return _money(t.select("run_id", "date", "step", "market_value"), "market_value")


@query("g10_truncate_length", with_views(GRID_SQL + f""",
t as (select *, sum(case when market_value < {0.5 * B0} then 1 else 0 end) over
        (partition by run_id order by date rows between unbounded preceding and current row) as seen_ from sc)
select run_id, date, step, {_m('market_value')} as market_value from t
where (seen_ = 0 or (seen_ = 1 and market_value < {0.5 * B0})) and step < 20 - 1""", "orders_q", "prices"))
def g10_truncate_length(spark, sf_dir):
    """G10 with an episode length of 20: 19 rows of a run at most."""
    t = portfolio.truncate_runs(_ledger_full(spark, sf_dir), "market_value", B0, ep_length=20)
    return _money(t.select("run_id", "date", "step", "market_value"), "market_value")


UNPRICED_SQL = """, px as (select * from prices where month(date) % 5 <> 0), pairs as (select distinct run_id, ticker from orders_q),
g0 as (select r.run_id, p.ticker, p.date, p.price from px p join pairs r on p.ticker = r.ticker),
g1 as (select coalesce(g.run_id, o.run_id) as run_id, coalesce(g.ticker, o.ticker) as ticker, coalesce(g.date, o.date) as date,
              g.price, coalesce(o.qty, 0.0) as qty
       from g0 g full join orders_q o on o.run_id = g.run_id and o.ticker = g.ticker and o.date = g.date),
g2 as (select run_id, ticker, date, qty, last_value(price ignore nulls) over (partition by run_id, ticker order by date) as price from g1)"""


@query("g6_positions_unpriced", with_views(UNPRICED_SQL + """
select run_id, ticker, date, round(price, 6) + 0.0 as price, round(coalesce(lag(price) over w, price), 6) + 0.0 as exec_price,
  round(sum(qty) over (partition by run_id, ticker order by date rows between unbounded preceding and current row), 6) + 0.0 as position
from g2 window w as (partition by run_id, ticker order by date)""", "orders_q", "prices"))
def g6_positions_unpriced(spark, sf_dir):
    """G6 where some order dates have no price: the order counts, at the last mark."""
    px = v(spark, sf_dir, "prices").where(F.month("date") % 5 != 0)
    g = portfolio.grid(v(spark, sf_dir, "orders_q"), px)
    return portfolio.positions(g).select("run_id", "ticker", "date", "price", "exec_price", "position")


@query("g11_ledger", with_views(GRID_SQL + f"""
select run_id, date, step, {_m('market_value')} as market_value, {_m('balance')} as balance,
       {_m('paid_slippage')} as paid_slippage, round(score, 6) + 0.0 as score, round(gross_leverage, 6) + 0.0 as gross_leverage,
       round(long_weight, 6) + 0.0 as long_weight, round(short_weight, 6) + 0.0 as short_weight from sc""", "orders_q", "prices"))
def g11_ledger(spark, sf_dir):
    """The full render ledger per (run, date)."""
    led = portfolio.ledger(v(spark, sf_dir, "orders_q"), v(spark, sf_dir, "prices"), B0, lam=LAM)
    return _money(led, "market_value", "balance", "paid_slippage")


@query("g12_validation_returns", with_views(GRID_SQL + """,
d as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from val)),
vc as (select val.*, cast(floor(d.idx / 12) as integer) as chunk from val join d on val.date = d.date)
select run_id, chunk, date, round(case when market_value > 0 and lag(market_value) over w > 0
  then ln(market_value) - ln(lag(market_value) over w) end, 6) + 0.0 as ret
from vc window w as (partition by run_id, chunk order by date)""", "orders_q", "prices"))
def g12_validation_returns(spark, sf_dir):
    """Log returns of the market value per (run, 12-month chunk)."""
    g = cut(portfolio.positions(_grid(spark, sf_dir)))
    val = portfolio.valuation(g, portfolio.cash(g, B0)).select("run_id", "date", "market_value")
    c = folds.by_size(val, 12)
    return report.validation_returns(c).select("run_id", "chunk", "date", "ret")


@query("g12_validation_returns_chunks", with_views(GRID_SQL + """,
d as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from val)),
vc as (select val.*, cast(floor(d.idx / 12) as integer) as chunk from val join d on val.date = d.date)
select run_id, chunk, date, round(case when market_value > 0 and lag(market_value) over w > 0
  then ln(market_value) - ln(lag(market_value) over w) end, 6) + 0.0 as ret
from vc where chunk between 1 and 3 window w as (partition by run_id, chunk order by date)""", "orders_q", "prices"))
def g12_validation_returns_chunks(spark, sf_dir):
    """G12 over the chunks 1 to 3, as a summary that leaves the first chunk out."""
    g = cut(portfolio.positions(_grid(spark, sf_dir)))
    val = portfolio.valuation(g, portfolio.cash(g, B0)).select("run_id", "date", "market_value")
    return report.validation_returns(folds.by_size(val, 12), chunks=range(1, 4)).select("run_id", "chunk", "date", "ret")


SYMS = ["S1", "S2", "S3", "S4"]  # a caller's choice; d12_render reports all symbols


@query("d12_render_wide", with_views(GRID_SQL + """,
lv as (select g.run_id, g.ticker, g.date, g.qty, g.position * g.price / nullif(val.market_value, 0) as leverage
       from g join val on g.run_id = val.run_id and g.date = val.date)
select run_id, date, """ + ", ".join(
    f"round(max(case when ticker = '{s}' then leverage end), 6) + 0.0 as leverage_{s}, "
    f"round(max(case when ticker = '{s}' then qty end), 6) + 0.0 as action_{s}" for s in SYMS
) + " from lv group by run_id, date", "orders_q", "prices"))
def d12_render_wide(spark, sf_dir):
    """Wide render report, leverage_<sym> and action_<sym> per (run, date)."""
    g = cut(portfolio.positions(_grid(spark, sf_dir)))
    val = portfolio.valuation(g, portfolio.cash(g, B0))
    lv = portfolio.net_weights(g, val).withColumnRenamed("qty", "action")
    return report.render_wide(lv, SYMS, ["leverage", "action"])


@query("d12_render", with_views(GRID_SQL + """
select g.run_id, g.date, g.ticker, round(g.position * g.price / nullif(val.market_value, 0), 6) + 0.0 as leverage,
       round(g.qty, 6) + 0.0 as action
from g join val on g.run_id = val.run_id and g.date = val.date""", "orders_q", "prices"))
def d12_render(spark, sf_dir):
    """The render report of all symbols, one row per (run, date, symbol)."""
    g = cut(portfolio.positions(_grid(spark, sf_dir)))
    val = portfolio.valuation(g, portfolio.cash(g, B0))
    lv = portfolio.net_weights(g, val).withColumnRenamed("qty", "action")
    return lv.select("run_id", "date", "ticker", "leverage", "action")
