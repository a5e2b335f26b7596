"""Queries for walk-forward folds and standardisation (F, D1, D2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfolds.operators import folds
from tsfolds.plans.fixtures import with_views
from tsfolds.plans.q_core import CHUNK, CHUNKED
from tsfolds.plans.queries import query, v

BAR_COLS = ["open", "high", "low", "close", "volume"]


def _r(c: str) -> str:
    return f"round({c}, 6) + 0.0"


@query("d1_column_stats", with_views("""select ticker, """ + ", ".join(
    f"{_r(f'avg({c})')} as mean_{c}, {_r(f'stddev_samp({c})')} as std_{c}" for c in ["open", "close", "volume"]
) + " from supp_bars group by ticker", "supp_bars"))
def d1_column_stats(spark, sf_dir):
    """Mean and sample std of several columns in one aggregate, per ticker."""
    return folds.column_stats(v(spark, sf_dir, "supp_bars"), ["open", "close", "volume"], ["ticker"])


@query("d2_prior_stats", with_views(f""", {CHUNKED}, k as (select distinct chunk from c)
select k.chunk, """ + ", ".join(
    f"{_r(f'avg(c.{x})')} as mean_{x}, {_r(f'stddev_samp(c.{x})')} as std_{x}, count(c.{x}) as n_{x}" for x in BAR_COLS
) + """ from k join c on (c.chunk < k.chunk or (k.chunk = 0 and c.chunk = 0)) group by k.chunk""", "supp_bars"))
def d2_prior_stats(spark, sf_dir):
    """Statistics of all earlier chunks for every chunk (chunk 0: itself),
    from per-chunk mergeable moments."""
    return folds.prior_stats(folds.by_size(v(spark, sf_dir, "supp_bars"), CHUNK), BAR_COLS)


def _gappy_chunks_sql(size_expr: str) -> str:
    return f""", n as (select count(distinct date) as nd from gappy),
d as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from gappy)),
dc as (select d.date, cast(floor(d.idx / ({size_expr})) as integer) as chunk from d, n)"""


@query("f2_by_number", with_views(_gappy_chunks_sql("nd // 4") + "\nselect date, chunk from dc", "gappy"))
def f2_by_number(spark, sf_dir):
    """chunk size = n_dates // 4 (may give more than 4 chunks)."""
    return folds.by_number(v(spark, sf_dir, "gappy"), 4).select("date", "chunk").distinct()


@query("f3_equal", with_views(_gappy_chunks_sql("nd // 5") + """
select g.ticker, g.date, dc.chunk from gappy g join dc on g.date = dc.date where dc.chunk < 5""", "gappy"))
def f3_equal(spark, sf_dir):
    """five equal folds; remainder dates dropped."""
    return folds.equal(v(spark, sf_dir, "gappy"), 5).select("ticker", "date", "chunk")


TT_SQL = f""", {CHUNKED}, kk as (select max(chunk) + 1 as k from c),
tt as (select c.*, cast(f.fold as integer) as fold, 'train' as role from c, kk, unnest(generate_series(0, kk.k - 2)) as f(fold)
       where c.chunk <= f.fold
       union all select c.*, cast(c.chunk - 1 as integer) as fold, 'test' as role from c where c.chunk >= 1)"""


@query("f5_train_test", with_views(TT_SQL + "\nselect ticker, date, chunk, fold, role from tt", "supp_bars"))
def f5_train_test(spark, sf_dir):
    """expanding train / next-chunk test split for every fold."""
    return folds.train_test(folds.by_size(v(spark, sf_dir, "supp_bars"), CHUNK)).select("ticker", "date", "chunk", "fold", "role")


@query("f6_standardize_train_test", with_views(TT_SQL + """,
st as (select f.fold, avg(c.close) as mc, stddev_samp(c.close) as sc, avg(c.volume) as mv, stddev_samp(c.volume) as sv
       from (select distinct fold from tt) f join c on c.chunk <= f.fold group by f.fold)
select tt.ticker, tt.date, tt.chunk, tt.fold, tt.role,
  round((tt.close - st.mc) / nullif(st.sc, 0), 6) + 0.0 as close, round((tt.volume - st.mv) / nullif(st.sv, 0), 6) + 0.0 as volume
from tt join st on tt.fold = st.fold""", "supp_bars"))
def f6_standardize_train_test(spark, sf_dir):
    """both roles of every fold z-scored with the fold's train statistics."""
    c = folds.by_size(v(spark, sf_dir, "supp_bars"), CHUNK)
    return folds.standardize_train_test(c, ["close", "volume"]).select("ticker", "date", "chunk", "fold", "role", "close", "volume")


FUND_COLS = ["capex", "equity", "revenue"]


def _prior_z_sql(size_expr: str) -> str:
    return f""", n as (select count(distinct date) as nd from fund),
d as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from fund)),
c as (select f.*, cast(floor(d.idx / ({size_expr})) as integer) as chunk from fund f join d on f.date = d.date, n),
k as (select distinct chunk from c),
st as (select k.chunk, """ + ", ".join(
        f"avg(c.{x}) as m_{x}, stddev_samp(c.{x}) as s_{x}" for x in FUND_COLS
    ) + """ from k join c on (c.chunk < k.chunk or (k.chunk = 0 and c.chunk = 0)) group by k.chunk)
select c.ticker, c.date, c.chunk, round(c.closeadj, 6) + 0.0 as closeadj, """ + ", ".join(
        f"round((c.{x} - st.m_{x}) / nullif(st.s_{x}, 0), 6) + 0.0 as {x}" for x in FUND_COLS
    ) + " from c join st on c.chunk = st.chunk"


@query("f7_standardize_prior", with_views(_prior_z_sql("6"), "fund"))
def f7_standardize_prior(spark, sf_dir):
    """chunks of 6 months z-scored with the statistics of the earlier
    chunks (chunk 0 with itself); prices preserved."""
    f = v(spark, sf_dir, "fund").select("ticker", "date", "closeadj", *FUND_COLS)
    return folds.standardize_prior(folds.by_size(f, 6)).select("ticker", "date", "chunk", "closeadj", *FUND_COLS)


@query("f8_prepare", with_views(_prior_z_sql("nd // 5"), "fund"))
def f8_prepare(spark, sf_dir):
    """F8: the whole prepare step (5 chunks by number + prior standardisation)."""
    f = v(spark, sf_dir, "fund").select("ticker", "date", "closeadj", *FUND_COLS)
    return folds.prepare(f, n_folds=5).select("ticker", "date", "chunk", "closeadj", *FUND_COLS)


@query("f9_walk_forward_line", with_views(""", d as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from supp_bars)),
s as (select count(*) // 4 as size from d),
c as (select b.*, d.idx // s.size as chunk from supp_bars b join d using (date), s),
m as (select f.fold, regr_slope(c.close, c.open) as a, regr_intercept(c.close, c.open) as b
      from (select distinct chunk as fold from c) f join c on c.chunk <= f.fold group by f.fold)
select c.ticker, c.date, m.fold, round(c.close, 6) + 0.0 as close, round(m.a * c.open + m.b, 4) + 0.0 as prediction
from c join m on c.chunk = m.fold + 1""", "supp_bars"))
def f9_walk_forward_line(spark, sf_dir):
    """a line of the close on the open, fit on chunks <= f and scored on
    chunk f+1 (ordinary least squares)."""
    from pyspark.ml.regression import LinearRegression

    c = folds.by_number(v(spark, sf_dir, "supp_bars").select("ticker", "date", "open", "close"), 4)
    out = folds.walk_forward(c, LinearRegression(solver="normal"), ["open"], "close")
    return out.select("ticker", "date", "fold", "close", F.round("prediction", 4).alias("prediction"))


def _cov(a: str, b: str) -> str:
    return f"covar_pop(c.{a}, c.{b})"


# normal equations of three regressors, solved by determinants
X3 = ["open", "high", "low"]


@query("f9_walk_forward", with_views(""", d as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from supp_bars)),
s as (select count(*) // 4 as size from d),
c as (select b.*, d.idx // s.size as chunk from supp_bars b join d using (date), s),
g as (select f.fold, """ + ", ".join(f"avg(c.{x}) as m_{x}" for x in [*X3, "close"]) + ", "
                                     + ", ".join(f"{_cov(x, y)} as q{i}{j}" for i, x in enumerate(X3) for j, y in enumerate(X3) if i <= j) + ", "
                                     + ", ".join(f"{_cov(x, 'close')} as b{i}" for i, x in enumerate(X3)) + """
      from (select distinct chunk as fold from c) f join c on c.chunk <= f.fold group by f.fold),
i as (select *, q11 * q22 - q12 * q12 as c00, q02 * q12 - q01 * q22 as c01, q01 * q12 - q02 * q11 as c02,
        q00 * q22 - q02 * q02 as c11, q01 * q02 - q00 * q12 as c12, q00 * q11 - q01 * q01 as c22 from g),
m as (select *, q00 * c00 + q01 * c01 + q02 * c02 as det from i),
k as (select *, (c00 * b0 + c01 * b1 + c02 * b2) / det as k0, (c01 * b0 + c11 * b1 + c12 * b2) / det as k1, (c02 * b0 + c12 * b1 + c22 * b2) / det as k2 from m)
select c.ticker, c.date, k.fold, round(c.close, 6) + 0.0 as close,
  round(m_close + k0 * (c.open - m_open) + k1 * (c.high - m_high) + k2 * (c.low - m_low), 0) + 0.0 as prediction
from c join k on c.chunk = k.fold + 1""", "supp_bars"))
def f9_walk_forward(spark, sf_dir):
    """linear model of the close on open/high/low, fit on chunks <= f and scored on chunk f+1, from merged Gram statistics."""
    c = folds.by_number(v(spark, sf_dir, "supp_bars").select("ticker", "date", "open", "high", "low", "close"), 4)
    out = folds.walk_forward_linear(c, X3, "close")
    return out.select("ticker", "date", "fold", "close", F.round("prediction", 0).alias("prediction"))
