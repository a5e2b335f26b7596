"""Queries for rolling panel features on the supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfolds.functions import log_lags, ols_weights
from tsfolds.operators import align, clean, features, pairs, report
from tsfolds.operators.features import hurst_lags
from tsfolds.plans.fixtures import table, with_views
from tsfolds.plans.queries import query, v

B = 10
W = "window w as (partition by ticker order by date)"


def _sb(spark, sf_dir):
    return v(spark, sf_dir, "supp_bars").select("ticker", "date", "open", "high", "low", "close")


# --------------------------------------------------------------------------- E1 E2 E3 E15 E16 E17


@query("e1_ffill", with_views(""", b as (select ticker, min(date) as lo, max(date) as hi from gappy group by ticker),
s as (select ticker, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from b),
sp as (select s.ticker, s.date, g.close, g.volume from s left join gappy g on s.ticker = g.ticker and s.date = g.date)
select ticker, date, round(last_value(close ignore nulls) over w, 6) + 0.0 as close,
       last_value(volume ignore nulls) over w as volume
from sp window w as (partition by ticker order by date rows between unbounded preceding and current row)""", "gappy"))
def e1_ffill(spark, sf_dir):
    """Daily grid per ticker, forward filled."""
    g = v(spark, sf_dir, "gappy").select("ticker", "date", "close", "volume")
    return clean.ffill(align.daily_spine(g, "date", ["ticker"]), ["close", "volume"], "ticker", "date")


@query("e2_release_indicator", with_views(f"""select ticker, date, round(revenue, 6) + 0.0 as revenue,
coalesce(cast(lag(revenue) over w <> revenue as integer), 1) as release_indicator from fund {W}""", "fund"))
def e2_release_indicator(spark, sf_dir):
    """1 when revenue changed from the previous month (first / missing: 1)."""
    f = v(spark, sf_dir, "fund").select("ticker", "date", "revenue")
    return features.release_indicator(f, "revenue")


@query("e3_pct_change", with_views("""select m.series_id, m.date,
  round(case when c.pct_chg then
        (case when c.n = 4 then m.value / nullif(lag(m.value, 4) over w, 0) else m.value / nullif(lag(m.value, 1) over w, 0) end - 1) * 100
        else m.value end, 6) + 0.0 as value
from macro_obs m left join series_conf c on m.series_id = c.series_id
window w as (partition by m.series_id order by m.date)""", "macro_obs", "series_conf"))
def e3_pct_change(spark, sf_dir):
    """Per-series percent change over n rows where the series is flagged."""
    return features.pct_change_by_conf(v(spark, sf_dir, "macro_obs"), v(spark, sf_dir, "series_conf"))


@query("e15_delta", with_views(f"""select ticker, date,
  round(coalesce(revenue - lag(revenue) over w, 0), 6) + 0.0 as revenue_delta,
  round(coalesce(capex - lag(capex) over w, 0), 6) + 0.0 as capex_delta,
  round(coalesce(equity - lag(equity) over w, 0), 6) + 0.0 as equity_delta
from fund {W}""", "fund"))
def e15_delta(spark, sf_dir):
    """Last minus previous row per feature (0 without a previous row)."""
    f = v(spark, sf_dir, "fund").select("ticker", "date", "revenue", "capex", "equity")
    return features.delta(f, ["revenue", "capex", "equity"]).drop("revenue", "capex", "equity")


@query("e16_squared_return", with_views(f""", r as (select ticker, date,
  case when close > 0 and lag(close) over w > 0 then ln(close) - ln(lag(close) over w) end as ret from supp_bars {W})
select ticker, date, round(ret, 6) + 0.0 as ret, round(ret * ret, 6) + 0.0 as ret_sq from r""", "supp_bars"))
def e16_squared_return(spark, sf_dir):
    """Log return and squared return of the close."""
    return features.log_return(_sb(spark, sf_dir), "close", "ticker", "date", "ret", squared="ret_sq").select(
        "ticker", "date", "ret", "ret_sq"
    )


RS = """case when a > 0 and b > 0 then ln(a / b) end"""


def _lnr(a, b):
    return RS.replace("a >", f"{a} >").replace("b >", f"{b} >").replace("(a / b)", f"({a} / {b})")


@query("e17_rogers_satchell", with_views(f"""select ticker, date,
  round({_lnr('high', 'close')} * {_lnr('high', 'open')} + {_lnr('low', 'close')} * {_lnr('low', 'open')}, 6) + 0.0 as intraday_vol
from supp_bars""", "supp_bars"))
def e17_rogers_satchell(spark, sf_dir):
    """Rogers-Satchell intraday volatility."""
    return features.rogers_satchell(_sb(spark, sf_dir)).select("ticker", "date", "intraday_vol")


# --------------------------------------------------------------------------- frames E7 E9 E10 E11 E12


@query("e7_moving_average", with_views("""select ticker, date, round(ma, 6) + 0.0 as close_ma5 from
(select ticker, date, avg(close) over w as ma, count(*) over w as n from supp_bars
 window w as (partition by ticker order by date rows between 4 preceding and current row)) where n = 5""", "supp_bars"))
def e7_moving_average(spark, sf_dir):
    """5-row moving average of the close, full windows only."""
    return features.moving_average(_sb(spark, sf_dir), "close", 5).select("ticker", "date", "close_ma5")


WB = f"window w as (partition by ticker order by date rows between {B} preceding and current row)"


@query("e9_range_distance", with_views(f"""select ticker, date,
  round(max(close) over w / nullif(close, 0), 6) + 0.0 as dist_max,
  round(close / nullif(min(close) over w, 0), 6) + 0.0 as dist_min
from supp_bars {WB}""", "supp_bars"))
def e9_range_distance(spark, sf_dir):
    """Distance from the rolling max and min over B+1 rows."""
    return features.range_distance(_sb(spark, sf_dir), "close", B).select("ticker", "date", "dist_max", "dist_min")


@query("e10_rolling_percentile", with_views(f"""select ticker, date,
  round(len(list_filter(l, lambda x: x > close)) / len(l), 6) + 0.0 as spot_rank
from (select ticker, date, close, list(close) over w as l from supp_bars {WB})""", "supp_bars"))
def e10_rolling_percentile(spark, sf_dir):
    """Share of the B+1-row window above the current close."""
    return features.rolling_percentile(_sb(spark, sf_dir), "close", B).select("ticker", "date", "spot_rank")


RSI_SQL = f"""d as (select ticker, date, close, close - lag(close) over (partition by ticker order by date) as dx from supp_bars),
g as (select ticker, date, close,
        avg(case when dx is null then null when dx > 0 then dx else 0 end) over w as up,
        avg(case when dx is null then null when dx < 0 then -dx else 0 end) over w as dn
      from d window w as (partition by ticker order by date rows between {B - 1} preceding and current row)),
rs as (select ticker, date, close, case when dn = 0 then 100.0 else 100 - 100 / (1 + up / dn) end as rsi from g)"""


@query("e11_rsi", with_views(f""", {RSI_SQL}
select ticker, date, round(rsi, 6) + 0.0 as rsi from rs""", "supp_bars"))
def e11_rsi(spark, sf_dir):
    """RSI over the B differences of a B+1-row window."""
    return features.rsi(_sb(spark, sf_dir), "close", B).select("ticker", "date", "rsi")


_HW = ols_weights(log_lags(hurst_lags(B)))
HURST_SQL = (
    "h as (select ticker, date, close, "
    + ", ".join(f"close - lag(close, {L}) over (partition by ticker order by date) as d{L}" for L in hurst_lags(B))
    + ", count(*) over (partition by ticker order by date rows between "
    + f"{B} preceding and current row) as n from supp_bars),\n"
    + "t as (select ticker, date, n, "
    + ", ".join(
        f"stddev_pop(d{L}) over (partition by ticker order by date rows between {B - L} preceding and current row) as t{L}"
        for L in hurst_lags(B)
    )
    + " from h),\nhu as (select ticker, date, case when n = "
    + f"{B + 1} and "
    + " and ".join(f"t{L} > 0" for L in hurst_lags(B))
    + " then "
    + " + ".join(f"ln(t{L}) * {w!r}" for L, w in zip(hurst_lags(B), _HW))
    + " end as hurst from t)"
)


@query("e12_hurst", with_views(f""", {HURST_SQL}
select ticker, date, round(hurst, 6) + 0.0 as hurst from hu""", "supp_bars"))
def e12_hurst(spark, sf_dir):
    """Hurst exponent over a full B+1-row window (lags 2..B/2-1)."""
    return features.hurst(_sb(spark, sf_dir), "close", B).select("ticker", "date", "hurst")


@query("e12b_hurst_structure", with_views(""", i as (select ticker, date, close, row_number() over (partition by ticker order by date) - 1 as i
          from supp_bars),
n as (select ticker, count(*) as len from i group by ticker),
l as (select ticker, lag_ from (select ticker, cast(floor(least(len // 2, 300) / pow(2, k)) as bigint) as lag_
        from n, unnest(generate_series(0, 9)) as t(k)) where lag_ > 2),
tau as (select a.ticker, l.lag_, sqrt(avg(pow(b.close - a.close, 2)) / nullif(avg(a.close), 0)) as tau
        from i a join l on a.ticker = l.ticker join i b on b.ticker = a.ticker and b.i = a.i + l.lag_
        group by a.ticker, l.lag_),
e as (select ticker, max_by(tau, lag_) as th, max(lag_) as lh, min_by(tau, lag_) as tl, min(lag_) as ll from tau group by ticker)
select ticker, round((log10(th) - log10(tl)) / nullif(log10(lh) - log10(ll), 0), 6) + 0.0 as hurst_structure from e""", "supp_bars"))
def e12b_hurst_structure(spark, sf_dir):
    """Structure-function Hurst exponent of each supplier's series."""
    return features.hurst_structure(_sb(spark, sf_dir), "close")


@query("e13_rolling_corr", with_views(f"""select date, a, b,
  round(covar_pop(x_a, x_b) over w / nullif(stddev_pop(x_a) over w * stddev_pop(x_b) over w, 0), 6) + 0.0 as corr
from (select a.date, a.ticker as a, b.ticker as b, a.close as x_a, b.close as x_b
      from bars a join bars b on a.date = b.date and a.ticker <= b.ticker)
window w as (partition by a, b order by date rows between {B} preceding and current row)""", "bars"))
def e13_rolling_corr(spark, sf_dir):
    """Rolling correlation of every symbol pair (a <= b), B+1 rows."""
    bars = v(spark, sf_dir, "bars")
    return features.rolling_corr(bars, "close", B, pairs=features.symbol_pairs(bars)).select("date", "a", "b", "corr")


TOP_PAIRS = 3


@query("e13_top_pairs", with_views(f""", c as (select a.date, a.ticker as a, b.ticker as b, count(*) over w as n,
  covar_pop(a.close, b.close) over w / nullif(stddev_pop(a.close) over w * stddev_pop(b.close) over w, 0) as corr
  from supp_bars a join supp_bars b on a.date = b.date and a.ticker < b.ticker
  window w as (partition by a.ticker, b.ticker order by a.date rows between {B} preceding and current row)),
r as (select *, row_number() over (partition by date order by round(abs(corr), 9) desc, a, b) as rank
      from c where n = {B + 1} and corr is not null)
select date, rank, a, b, round(corr, 6) + 0.0 as corr from r where rank <= {TOP_PAIRS}""", "supp_bars"))
def e13_top_pairs(spark, sf_dir):
    """E13 over all supplier pairs by tiles: the most correlated pairs of every date over B+1 common dates."""
    x = pairs.rolling_tiles(_sb(spark, sf_dir), "close", B, top=TOP_PAIRS, full=True)
    return x.select("date", "rank", "a", "b", (F.round("corr", 6) + F.lit(0.0)).alias("corr"))


# y over each window from its own definition: y_j = x_j - sum over k < j of 2^-(j-k) x_k, rows counted from the window's start
CAUSAL_SQL = f""", i as (select ticker, date, open, high, low, close, row_number() over (partition by ticker order by date) as i from supp_bars),
wx as (select c.ticker, c.i as cur, w.i as j, w.close as x, w.open, w.high, w.low
       from i c join i w on w.ticker = c.ticker and w.i between c.i - {B} and c.i),
wy as (select a.ticker, a.cur, a.j, any_value(a.x) - coalesce(sum(pow(0.5, a.j - k.j) * k.x), 0) as y,
              any_value(a.open) as open, any_value(a.high) as high, any_value(a.low) as low
       from wx a left join wx k on k.ticker = a.ticker and k.cur = a.cur and k.j < a.j group by a.ticker, a.cur, a.j),
cs as (select ticker, cur, """ + ", ".join(
    f"case when max({c}) > min({c}) and max(y) > min(y) then corr(y, {c}) else 0.0 end as causal_{c}" for c in ("open", "high", "low")
) + """ from wy group by ticker, cur)"""


@query("e14_causal_strength", with_views(CAUSAL_SQL + """
select i.ticker, i.date, """ + ", ".join(f"round(causal_{c}, 6) + 0.0 as causal_{c}" for c in ("open", "high", "low")) + """
from cs join i on i.ticker = cs.ticker and i.i = cs.cur""", "supp_bars"))
def e14_causal_strength(spark, sf_dir):
    """Causal strength of open/high/low against the filtered close."""
    return features.causal_strength(_sb(spark, sf_dir), "close", ["open", "high", "low"], B).select(
        "ticker", "date", "causal_open", "causal_high", "causal_low"
    )


def smooth_sql(source: str, value: str, n: int) -> str:
    """The smoothing loop itself, folded over each row's whole history; missing values are skipped."""
    return f"""st as (select *, row_number() over (partition by ticker order by date) - 1 as step from {source}),
sm as (select ticker, date, case when step > {n} and {value} is null then null else
        list_reduce(list_prepend({{'s': 0::bigint, 'v': 50.0::double}}, list_filter(list({{'s': step, 'v': {value}::double}}) over
          (partition by ticker order by date rows between unbounded preceding and current row), lambda e: e.s > {n} and e.v is not null)),
        lambda acc, e: {{'s': 0::bigint, 'v': (e.v + {n - 1}.0 * acc.v) / {n}.0}}).v end as rsi_smooth from st)
select ticker, date, round(rsi_smooth, 6) + 0.0 as rsi_smooth from sm"""


@query("e18_wilder_smooth", with_views(f", {RSI_SQL},\n" + smooth_sql("rs", "rsi", B), "supp_bars"))
def e18_wilder_smooth(spark, sf_dir):
    """Recursive (Wilder) smoothing of the RSI from 50 once step > B."""
    x = features.rsi(_sb(spark, sf_dir), "close", B, with_step="step")
    return features.wilder_smooth(x, "rsi", 50.0, B, name="rsi_smooth").select("ticker", "date", "rsi_smooth")


@query("e18_wilder_smooth_gaps", with_views(f", {RSI_SQL},\ngp as (select ticker, date, case when day(date) % 7 <> 0 then rsi end as v from rs),\n"
                                            + smooth_sql("gp", "v", 50), "supp_bars"))
def e18_wilder_smooth_gaps(spark, sf_dir):
    """E18 with B = 50 and missing values (every seventh day of a month)."""
    x = features.rsi(_sb(spark, sf_dir), "close", B, with_step="step")
    x = x.withColumn("v", F.when(F.dayofmonth("date") % 7 != 0, F.col("rsi")))
    return features.wilder_smooth(x, "v", 50.0, 50, name="rsi_smooth").select("ticker", "date", "rsi_smooth")


@query("e19_lag_tensor", with_views(""", i as (select *, row_number() over w as rn, first_value(open) over w as f_open, first_value(close) over w as f_close,
  lag(open, 1) over w as open_1, lag(open, 2) over w as open_2, lag(close, 1) over w as close_1, lag(close, 2) over w as close_2
  from supp_bars window w as (partition by ticker order by date))
select ticker, date, """ + ", ".join(
    f"round(case when rn > {k} then {c + (f'_{k}' if k else '')} else f_{c} end, 6) + 0.0 as {c}_lag{k}" for k in (2, 1, 0) for c in ("open", "close")
) + " from i", "supp_bars"))
def e19_lag_tensor(spark, sf_dir):
    """The last 3 (open, close) vectors per row, front-padded, as columns."""
    x = features.lag_tensor(_sb(spark, sf_dir), ["open", "close"], 3)
    parts = [F.col("obs")[2 - k][j].alias(f"{c}_lag{k}") for k in (2, 1, 0) for j, c in enumerate(("open", "close"))]
    return x.select("ticker", "date", *parts)


@query("e23_trailing_returns", with_views(""", lr as (select ticker, date, case when close > 0 and lag(close) over w > 0
    then ln(close) - ln(lag(close) over w) end as ret from supp_bars window w as (partition by ticker order by date)),
i as (select *, row_number() over (partition by ticker order by date) as rn from lr where ret is not null)
select ticker, date, """ + ", ".join(
    f"round(case when rn > {k} then lag(ret, {k}) over (partition by ticker order by date) else 0.0 end, 6) + 0.0 as ret_lag{k}" for k in range(B)
) + " from i", "supp_bars"))
def e23_trailing_returns(spark, sf_dir):
    """The last B log returns per row, zero-padded, as columns."""
    r = features.log_return(_sb(spark, sf_dir), "close", "ticker", "date", "ret").where(F.col("ret").isNotNull())
    x = features.trailing_vector(r, "ret", B, "ticker")
    return x.select("ticker", "date", *[F.col("ret_window")[B - 1 - k].alias(f"ret_lag{k}") for k in range(B)])


@query("e8_learning_curve", """with lg as (select event_type as run, epoch(ts) as t, value as r, length(props) as l from events),
x as (select *, cast(sum(l) over (partition by run order by t rows between unbounded preceding and current row) as bigint) as timesteps,
        avg(r) over w as ma, count(*) over w as n from lg
      window w as (partition by run order by t rows between 9 preceding and current row))
select run, round(t, 6) + 0.0 as t, timesteps, round(ma, 6) + 0.0 as reward_ma from x where n = 10""")
def e8_learning_curve(spark, sf_dir):
    """Cumulative timesteps and 10-episode smoothed reward per run, with
    the event log read as a monitor log (run, t, r, l)."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"),
        (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1e6).alias("t"),
        F.col("value").alias("r"),
        F.length("props").cast("long").alias("l"),
    )
    return report.learning_curve(e, "run", "t", "r", "l", 10).select("run", "t", "timesteps", "reward_ma")
