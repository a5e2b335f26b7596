"""Minimum slice: supp_bars -> chunks -> returns -> index / drawdown -> Sharpe."""

from __future__ import annotations

from tsfolds.operators import folds, report
from tsfolds.operators.features import log_return
from tsfolds.plans.fixtures import with_views
from tsfolds.plans.queries import query, v

CHUNK = 250  # dates per chunk of the panel

# DuckDB pieces shared by the oracles --------------------------------------
CHUNKED = f"""d as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from supp_bars)),
c as (select b.*, cast(floor(d.idx / {CHUNK}) as integer) as chunk from supp_bars b join d on b.date = d.date)"""
RETS = """r as (select *, case when close > 0 and lag(close) over w > 0 then ln(close) - ln(lag(close) over w) end as ret
       from c window w as (partition by ticker, chunk order by date))"""
IDX = """x as (select *, sum(ret) over w as cs,
              max(case when ret is not null then sum_r end) over w as cm
       from (select *, sum(ret) over (partition by ticker order by date rows between unbounded preceding and current row) as sum_r
             from r) window w as (partition by ticker order by date rows between unbounded preceding and current row)),
y as (select *, case when ret is not null then 100 * exp(cs) end as ret_index,
             case when ret is not null then 100 * (exp(cs - cm) - 1) end as drawdown from x)"""


def _chunked_returns(spark, sf_dir):
    b = folds.by_size(v(spark, sf_dir, "supp_bars"), CHUNK)
    return log_return(b, "close", ["ticker", "chunk"], "date", "ret")


@query("f1_by_size", with_views(f""", {CHUNKED}
select distinct date, chunk from c""", "supp_bars"))
def f1_by_size(spark, sf_dir):
    """Date -> chunk of 7 dates on the bar panel."""
    return folds.by_size(v(spark, sf_dir, "supp_bars"), CHUNK).select("date", "chunk").distinct()


@query("e4_log_return", with_views(f""", {CHUNKED}, {RETS}
select ticker, date, chunk, round(ret, 6) + 0.0 as ret from r""", "supp_bars"))
def e4_log_return(spark, sf_dir):
    """Log return of the close per (ticker, chunk)."""
    return _chunked_returns(spark, sf_dir).select("ticker", "date", "chunk", "ret")


@query("e5_e6_index_drawdown", with_views(f""", {CHUNKED}, {RETS}, {IDX}
select ticker, date, round(ret_index, 6) + 0.0 as ret_index, round(drawdown, 6) + 0.0 as drawdown from y""", "supp_bars"))
def e5_e6_index_drawdown(spark, sf_dir):
    """Return index and drawdown per ticker over its chunked returns."""
    return report.returns_drawdown(_chunked_returns(spark, sf_dir), "ret", "ticker").select(
        "ticker", "date", "ret_index", "drawdown"
    )


@query("d11_sharpe", with_views(f""", {CHUNKED}, {RETS}
select ticker, chunk, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 6) + 0.0 as sharpe
from r group by ticker, chunk""", "supp_bars"))
def d11_sharpe(spark, sf_dir):
    """Sharpe ratio per ticker and fold."""
    return report.sharpe(_chunked_returns(spark, sf_dir), "ret", ["ticker", "chunk"])


SUMMARY_SQL = with_views(f""", {CHUNKED}, {RETS}, {IDX}
select ticker, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 6) + 0.0 as sharpe,
       round(100 * exp(sum(ret)), 6) + 0.0 as final_index, round(min(drawdown), 6) + 0.0 as max_drawdown,
       count(ret) as n
from y group by ticker""", "supp_bars")


@query("d13_summary", SUMMARY_SQL)
def d13_summary(spark, sf_dir):
    """D13 (flagship): Sharpe, final index, max drawdown and n per symbol over
    its walk-forward chunks."""
    return report.summary(_chunked_returns(spark, sf_dir), "ret", "ticker")
