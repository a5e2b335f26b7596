"""Composite queries: the per-date state frame (E20), a feature graph (L2)
and the offline macro build (SURVEY 3.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfolds.operators import align, features, ingest
from tsfolds.plans.fixtures import with_views
from tsfolds.plans.q_clean import NATIONS
from tsfolds.plans.pipeline import FeatureGraph
from tsfolds.plans.q_features import CAUSAL_SQL, HURST_SQL, RSI_SQL
from tsfolds.plans.queries import query, v

B = 10

STATE_SQL = f""", {RSI_SQL}, {HURST_SQL},
base as (select ticker, date, close, row_number() over w - 1 as step,
           case when close > 0 and lag(close) over w > 0 then ln(close) - ln(lag(close) over w) end as r,
           list(close) over wb as xs, max(close) over wb as mx, min(close) over wb as mn
         from supp_bars window w as (partition by ticker order by date),
                               wb as (partition by ticker order by date rows between {B} preceding and current row)),
hr as (select t.ticker, t.date, case when """ + " and ".join(f"t.t{L} > 0" for L in features.hurst_lags(B)) + " then " + " + ".join(
    f"ln(t.t{L}) * {w!r}" for L, w in zip(features.hurst_lags(B), __import__('tsfolds.functions', fromlist=['x']).ols_weights(
        __import__('tsfolds.functions', fromlist=['x']).log_lags(features.hurst_lags(B))))
) + f""" end as hurst_raw from t),
j as (select b.*, hr.hurst_raw, rs.rsi as rsi_raw from base b join hr on b.ticker = hr.ticker and b.date = hr.date
      join rs on b.ticker = rs.ticker and b.date = rs.date),
sm as (select *,
    case when step > {B} and hurst_raw is null then null else
    list_reduce(list_prepend({{'s': 0::bigint, 'v': 0.5::double}}, list_filter(list({{'s': step, 'v': hurst_raw::double}}) over p, lambda e: e.s > {B} and e.v is not null)),
                lambda acc, e: {{'s': 0::bigint, 'v': (e.v + {B - 1}.0 * acc.v) / {B}.0}}).v end as hurst,
    case when step > {B} and rsi_raw is null then null else
    list_reduce(list_prepend({{'s': 0::bigint, 'v': 50.0::double}}, list_filter(list({{'s': step, 'v': rsi_raw::double}}) over p, lambda e: e.s > {B} and e.v is not null)),
                lambda acc, e: {{'s': 0::bigint, 'v': (e.v + {B - 1}.0 * acc.v) / {B}.0}}).v end as rsi
  from j window p as (partition by ticker order by date rows between unbounded preceding and current row))
select ticker, date, step, round(coalesce(r, 0.0), 6) + 0.0 as ret, round(coalesce(r * r, 0.0), 6) + 0.0 as ret_sq,
  round(len(list_filter(xs, lambda x: x > close)) / len(xs), 6) + 0.0 as spot_rank,
  round(case when step > {B} then mx / nullif(close, 0) else 1.0 end, 6) + 0.0 as dist_max,
  round(case when step > {B} then close / nullif(mn, 0) else 1.0 end, 6) + 0.0 as dist_min,
  round(hurst, 6) + 0.0 as hurst, round(rsi, 6) + 0.0 as rsi
from sm"""


@query("e20_panel_state", with_views(STATE_SQL, "supp_bars"))
def e20_panel_state(spark, sf_dir):
    """The state frame of every (ticker, date) at once — returns,
    rank, distances, smoothed Hurst and RSI with their defaults until the
    buffer is full."""
    x = v(spark, sf_dir, "supp_bars").select("ticker", "date", F.col("close"))
    return features.panel_state(x, "close", B).select(
        "ticker", "date", "step", "ret", "ret_sq", "spot_rank", "dist_max", "dist_min", "hurst", "rsi"
    )


FULL_SQL = STATE_SQL.replace("\nselect ticker, date, step,", ",\nfs as (select ticker, date, step,", 1) + ")" + CAUSAL_SQL + """,
dl as (select ticker, date, """ + ", ".join(f"coalesce({c} - lag({c}) over w, 0) as {c}_delta" for c in ("open", "volume")) + """
       from supp_bars window w as (partition by ticker order by date))
select fs.*, """ + ", ".join(f"round(case when fs.step > {B} then cs.causal_{c} else 0.0 end, 6) + 0.0 as causal_{c}" for c in ("open", "high")) + """,
  round(dl.open_delta, 6) + 0.0 as open_delta, round(dl.volume_delta, 6) + 0.0 as volume_delta
from fs join cs on fs.ticker = cs.ticker and fs.step + 1 = cs.cur join dl on fs.ticker = dl.ticker and fs.date = dl.date"""


@query("e20_panel_state_full", with_views(FULL_SQL, "supp_bars"))
def e20_panel_state_full(spark, sf_dir):
    """E20 with causal strengths (E14) and deltas (E15) in the same frame."""
    x = v(spark, sf_dir, "supp_bars").select("ticker", "date", "open", "high", "close", F.col("volume").cast("double").alias("volume"))
    out = features.panel_state(x, "close", B, features=["open", "high"], deltas=["open", "volume"])
    return out.select(
        "ticker", "date", "step", "ret", "ret_sq", "spot_rank", "dist_max", "dist_min", "hurst", "rsi",
        "causal_open", "causal_high", "open_delta", "volume_delta",
    )


def feature_graph(spark, sf_dir) -> FeatureGraph:
    """The 4-node example graph over the bar panel: node4 depends on node2
    and node3, which both depend on node1."""
    g = FeatureGraph()
    g.add("node1", lambda: v(spark, sf_dir, "bars").select("ticker", "date", "close"))
    g.add("node2", lambda d: features.log_return(d, "close", "ticker", "date", "ret"), ["node1"])
    g.add("node3", lambda d, B: features.rsi(d, "close", B).select("ticker", "date", "rsi"), ["node1"], B=B)
    g.add("node4", lambda a, b: a.join(b, ["ticker", "date"]), ["node2", "node3"])
    return g


@query("l2_feature_graph", with_views(""", supp_bars as (select * from bars), """ + RSI_SQL + """,
lr as (select ticker, date, close, case when close > 0 and lag(close) over w > 0 then ln(close) - ln(lag(close) over w) end as ret
       from bars window w as (partition by ticker order by date))
select lr.ticker, lr.date, round(lr.close, 6) + 0.0 as close, round(lr.ret, 6) + 0.0 as ret, round(rs.rsi, 6) + 0.0 as rsi
from lr join rs on lr.ticker = rs.ticker and lr.date = rs.date""", "bars"))
def l2_feature_graph(spark, sf_dir):
    """L2: a 4-node feature graph composed lazily into one plan."""
    return feature_graph(spark, sf_dir).build("node4")


MACRO_SQL = """, pc as (select m.series_id, m.date,
    case when c.pct_chg then
        (case when c.n = 4 then m.value / nullif(lag(m.value, 4) over w, 0) else m.value / nullif(lag(m.value, 1) over w, 0) end - 1) * 100
        else m.value end as value
  from macro_obs m left join series_conf c on m.series_id = c.series_id window w as (partition by m.series_id order by m.date)),
a as (select o.series_id, o.date, o.value,
        (select min(r.release_date) from releases r where r.series_id = o.series_id and r.release_date >= o.date) as release_date
      from pc o),
cv as (select series_id, release_date as date, min_by(value, date) as value from a
       where value is not null and release_date is not null group by series_id, release_date),
b as (select min(date) as lo, max(date) as hi from cv),
ids as (select distinct series_id from cv),
sp as (select ids.series_id, cast(unnest(generate_series(b.lo, b.hi, interval 1 day)) as date) as date from ids, b),
f as (select sp.series_id, sp.date, last_value(cv.value ignore nulls) over
        (partition by sp.series_id order by sp.date rows between unbounded preceding and current row) as value
      from sp left join cv on sp.series_id = cv.series_id and sp.date = cv.date),
ok as (select date from f group by date having count(value) = (select count(*) from ids)),
res as (select f.series_id, f.date, round(f.value, 6) + 0.0 as value from f join ok on f.date = ok.date)
select date, """ + ", ".join(f"max(case when series_id = '{n}' then value end) as {n}" for n in NATIONS) + " from res group by date"


@query("macro_build", with_views(MACRO_SQL, "macro_obs", "releases", "series_conf"))
def macro_build(spark, sf_dir):
    """SURVEY 3.4: percent changes, forward as-of to releases, first value
    per release, one pivot, daily spine, forward fill, dropna — one job."""
    out = align.macro_build(v(spark, sf_dir, "macro_obs"), v(spark, sf_dir, "releases"), v(spark, sf_dir, "series_conf"))
    # one column per nation, also for one that has no observation
    return out.select("date", *[F.col(n) if n in out.columns else F.lit(None).cast("double").alias(n) for n in NATIONS])


MARKET = [f"M{i}" for i in range(1, 6)]
MARKET_SQL = MACRO_SQL.replace("select date, max(case when series_id = 'NATION_0'", ", panel as (select date, max(case when series_id = 'NATION_0'", 1) + """),
mk as (select 'M' || left(ticker, 1) as series_id, date, sqrt(close) as value from gappy),
al as (select * from mk
  union all select 'M1xM2', coalesce(a.date, b.date), a.value * b.value
    from (select * from mk where series_id = 'M1') a full join (select * from mk where series_id = 'M2') b on a.date = b.date
  union all select 'M3perM4', coalesce(a.date, b.date), a.value / nullif(b.value, 0)
    from (select * from mk where series_id = 'M3') a full join (select * from mk where series_id = 'M4') b on a.date = b.date),
mw as (select date, """ + ", ".join(f"max(case when series_id = '{m}' then value end) as {m}" for m in [*MARKET, "M1xM2", "M3perM4"]) + """
       from al group by date),
bo as (select coalesce(p.date, mw.date) as date, """ + ", ".join([f"p.{n}" for n in NATIONS] + [f"mw.{m}" for m in [*MARKET, "M1xM2", "M3perM4"]]) + """
       from panel p full join mw on p.date = mw.date)
select date, """ + ", ".join(
    f"round(last_value({c} ignore nulls) over (order by date rows between unbounded preceding and current row), 6) + 0.0 as {c}"
    for c in [*NATIONS, *MARKET, "M1xM2", "M3perM4"]
) + " from bo"


@query("macro_market", with_views(MARKET_SQL, "macro_obs", "releases", "series_conf", "gappy"))
def macro_market(spark, sf_dir):
    """The whole macro build: the release panel, market series (one per order
    priority) and two crosses, merged on the date and filled forward."""
    panel = macro_build(spark, sf_dir)
    market = v(spark, sf_dir, "gappy").select(
        F.concat(F.lit("M"), F.substring("ticker", 1, 1)).alias("series_id"), "date", F.sqrt("close").alias("value")
    )
    crosses = [("M1xM2", "M1", "M2", "mul"), ("M3perM4", "M3", "M4", "div")]
    out = align.macro_market(panel, market, crosses, [*MARKET, "M1xM2", "M3perM4"])
    return out.select("date", *[F.round(c, 6).alias(c) for c in out.columns if c != "date"])


INGEST_SQL = """, f as (select ticker, date, datekey, capex, equity, revenue, closeadj, closeadj * 0.99 as open, closeadj * 1.02 + 100 as high,
    closeadj * 0.97 as low, case when month(date) <> 7 then closeadj end as close from fund),
r as (select * from f where close is not null and datekey is not null and closeadj is not null),
d as (select *, capex / nullif(equity, 0) as capexratio, closeadj as spot,
        case when revenue = lag(revenue) over (partition by ticker order by date) then 0 else 1 end as release_indicator,
        ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) as intraday_vol from r),
s as (select * from d where date >= date '1993-03-01'),
dt as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from s)),
n as (select count(*) // 5 as size from dt),
c as (select s.*, dt.idx // n.size as chunk from s join dt using (date), n where dt.idx // n.size < 5),
fo as (select c.*, fold, case when chunk <= fold then 'train' else 'test' end as role from c, range(0, 4) t(fold) where chunk <= fold + 1),
st as (select fold, """ + ", ".join(f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}" for c in ("capexratio", "revenue", "intraday_vol")) + """
       from fo where role = 'train' group by fold)
select ticker, date, fold, role, round(spot, 6) + 0.0 as spot, release_indicator, """ + ", ".join(
    f"round(({c} - m_{c}) / nullif(s_{c}, 0), 4) + 0.0 as {c}" for c in ("capexratio", "revenue", "intraday_vol")
) + " from fo join st using (fold)"


@query("ingest_folds", with_views(INGEST_SQL, "fund"))
def ingest_folds(spark, sf_dir):
    """Ingest as one step: required columns, derived columns, start date, five
    folds, each standardised on its train part."""
    f = v(spark, sf_dir, "fund")
    x = f.withColumns({"open": F.col("closeadj") * 0.99, "high": F.col("closeadj") * 1.02 + 100, "low": F.col("closeadj") * 0.97,
                       "close": F.when(F.month("date") != 7, F.col("closeadj"))})
    x = ingest.process(x, ["capexratio", "revenue"], start_date="1993-03-01")
    cols = ["capexratio", "revenue", "intraday_vol"]
    out = ingest.walk_forward(x, cols, 5)
    return out.select("ticker", "date", "fold", "role", "spot", "release_indicator", *[F.round(c, 4).alias(c) for c in cols])
