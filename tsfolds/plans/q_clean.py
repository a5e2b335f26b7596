"""Queries for scans, cleaning, panel lookups and alignment (A, B, C, D3-D6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfolds.operators import align, clean, features, folds, panel
from tsfolds.plans import fixtures as fx
from tsfolds.plans.fixtures import with_views
from tsfolds.plans.queries import query, v
from tsfolds.sources import io, store

IDS3 = ["NATION_6", "NATION_7", "NATION_12"]


# --------------------------------------------------------------------------- A


@query("a2_parse_dates", """select o_orderkey, strptime(strftime(o_orderdate, '%-m/%-d/%Y'), '%m/%d/%Y')::date as date
from orders""")
def a2_parse_dates(spark, sf_dir):
    """A2: M/D/YYYY text (rendered from the order date) parsed natively."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("date"))
    return clean.parse_dates(o, "date", "M/d/yyyy")


@query("a3_read_table", """select l_orderkey, l_linenumber, round(l_extendedprice, 6) + 0.0 as l_extendedprice
from lineitem where l_shipdate >= timestamp '1998-01-01' and l_returnflag = 'R'""")
def a3_read_table(spark, sf_dir):
    """A3: Parquet scan with the filter and projection pushed to the reader."""
    li = io.read_table(spark, f"{sf_dir}/lineitem.parquet")
    return li.where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "R")).select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )


@query("a7_latest_version", """select user_id, event_id, ts, event_type, round(value, 6) + 0.0 as value, props
from (select *, row_number() over (partition by user_id order by event_id desc, ts desc, event_type desc, value desc, props desc) as rn
      from events) where rn = 1""")
def a7_latest_version(spark, sf_dir):
    """Latest version (highest event id) per user of an append-only log."""
    return store.latest_version(fx.table(spark, sf_dir, "events"), ["user_id"], "event_id")


# --------------------------------------------------------------------------- B


@query("b1_select_features", with_views("""select ticker, date, round(revenue, 6) + 0.0 as revenue,
round(capex, 6) + 0.0 as capex from fund""", "fund"))
def b1_select_features(spark, sf_dir):
    """B1: column pruning to the used columns."""
    return clean.select_features(v(spark, sf_dir, "fund"), ["ticker", "date", "revenue", "capex"])


@query("b2_at_date", with_views("select * from bars where date = date '2024-01-15'", "bars"))
def b2_at_date(spark, sf_dir):
    """B2: the panel on one date."""
    return panel.at_date(v(spark, sf_dir, "bars"), "2024-01-15")


@query("b3_at_dates", with_views("""select * from gappy where date in (select release_date from releases where series_id = 'NATION_6')""", "gappy", "releases"))
def b3_at_dates(spark, sf_dir):
    """The panel on a table of dates (semi-join)."""
    d = v(spark, sf_dir, "releases").where(F.col("series_id") == "NATION_6").select("release_date")
    return panel.at_dates(v(spark, sf_dir, "gappy"), d)


@query("b4_predicates", with_views("""select * from job_log
where (parent = 'job1' and pct_complete >= 0.5) or name in ('job0.train.0', 'job2.validate.3')""", "job_log"))
def b4_predicates(spark, sf_dir):
    """Conjunction, disjunction and IN list."""
    j = v(spark, sf_dir, "job_log")
    return j.where(((F.col("parent") == "job1") & (F.col("pct_complete") >= 0.5)) | F.col("name").isin("job0.train.0", "job2.validate.3"))


@query("b5_require", with_views("select * from fund where datekey is not null", "fund"))
def b5_require(spark, sf_dir):
    """Drop rows with a missing datekey."""
    return clean.require(v(spark, sf_dir, "fund"), ["datekey"])


@query("b6_require_all", with_views("""select * from fund where datekey is not null and capex is not null
and closeadj is not null and equity is not null and revenue is not null""", "fund"))
def b6_require_all(spark, sf_dir):
    """Drop rows with any missing value."""
    return clean.require_all(v(spark, sf_dir, "fund"))


@query("b7_drop_cols", with_views("select ticker, date, closeadj, capex, revenue from fund", "fund"))
def b7_drop_cols(spark, sf_dir):
    """Drop columns."""
    return clean.drop_cols(v(spark, sf_dir, "fund"), "datekey", "equity")


@query("b8_base_columns", with_views("""select *, round(case when equity <> 0 then capex / equity end, 6) + 0.0 as capexratio,
closeadj as spot from fund""", "fund"))
def b8_base_columns(spark, sf_dir):
    """capexratio = capex / equity (NULL on 0), spot = closeadj."""
    return features.base_columns(v(spark, sf_dir, "fund"))


@query("b9_fill_nan", with_views("""select ticker, date, round(case when month(date) = 3 then 0.0 else capex end, 6) + 0.0 as x
from fund""", "fund"))
def b9_fill_nan(spark, sf_dir):
    """NaN (March values made NaN) replaced by 0; NULL stays NULL."""
    f = v(spark, sf_dir, "fund").select(
        "ticker", "date", F.when(F.month("date") == 3, F.lit(float("nan"))).otherwise(F.col("capex")).alias("x")
    )
    return clean.fill_nan(f, 0.0, ["x"])


@query("b11_dates", with_views("select distinct date from gappy", "gappy"))
def b11_dates(spark, sf_dir):
    """Distinct dates."""
    return panel.dates(v(spark, sf_dir, "gappy"))


@query("b11_symbols", with_views("select distinct ticker from supp_bars", "supp_bars"))
def b11_symbols(spark, sf_dir):
    """Distinct symbols."""
    return panel.symbols(v(spark, sf_dir, "supp_bars"))


@query("b12_with_step", with_views("""select ticker, date, dense_rank() over (order by date) - 1 as step from gappy""", "gappy"))
def b12_with_step(spark, sf_dir):
    """Position of each row's date among the sorted distinct dates."""
    return panel.with_step(v(spark, sf_dir, "gappy").select("ticker", "date"))


@query("b13_sample_windows", with_views(""", d as (select date, row_number() over (order by date) - 1 as idx from (select distinct date from gappy)),
e as (select episode, ('0x' || substr(md5('7:' || episode), 1, 8))::bigint % ((select count(*) from d) - 9) as lo from range(8) t(episode))
select g.*, e.episode from e join d on d.idx between e.lo and e.lo + 9 join gappy g on g.date = d.date""", "gappy"))
def b13_sample_windows(spark, sf_dir):
    """8 seeded random episodes of 10 consecutive dates."""
    return panel.sample_windows(v(spark, sf_dir, "gappy"), 10, 8, seed=7)


# --------------------------------------------------------------------------- C


NATIONS = [f"NATION_{i}" for i in range(25)]


@query("c1_merge_series", with_views("select date, " + ", ".join(
    f"round(max(case when series_id = '{n}' then value end), 6) + 0.0 as {n}" for n in NATIONS) + " from macro_obs group by date", "macro_obs"))
def c1_merge_series(spark, sf_dir):
    """Full outer merge of all series: one pivot, one column per id (the
    ids are the nations; one without observations is an empty column)."""
    return align.merge_series(v(spark, sf_dir, "macro_obs"), NATIONS)


@query("c2_assemble", with_views("""select date, max(case when series_id = 'NATION_6' then value end) as NATION_6,
max(case when series_id = 'NATION_7' then value end) as NATION_7, max(case when series_id = 'NATION_12' then value end) as NATION_12
from macro_obs where series_id in ('NATION_6', 'NATION_7', 'NATION_12') group by date""", "macro_obs"))
def c2_assemble(spark, sf_dir):
    """Named series assembled column-wise (explicit id list)."""
    return align.merge_series(v(spark, sf_dir, "macro_obs"), IDS3)


ASOF_SQL = """select o.series_id, o.date, round(o.value, 6) + 0.0 as value,
  (select min(r.release_date) from releases r where r.series_id = o.series_id and r.release_date >= o.date) as release_date
from macro_obs o"""


@query("c3_asof_forward", with_views(ASOF_SQL, "macro_obs", "releases"))
def c3_asof_forward(spark, sf_dir):
    """Each observation to the first release on or after its date."""
    return align.asof_forward(v(spark, sf_dir, "macro_obs"), v(spark, sf_dir, "releases"))


@query("c3_asof_last", with_views("""select o.series_id, o.date, round(o.value, 6) + 0.0 as value,
  coalesce((select min(r.release_date) from releases r where r.series_id = o.series_id and r.release_date >= o.date),
           (select max(r.release_date) from releases r where r.series_id = o.series_id)) as release_date
from macro_obs o""", "macro_obs", "releases"))
def c3_asof_last(spark, sf_dir):
    """C3 with ``fallback="last"``: no later release -> the last release."""
    return align.asof_forward(v(spark, sf_dir, "macro_obs"), v(spark, sf_dir, "releases"), fallback="last")


SPINE_SQL = """b as (select ticker, min(date) as lo, max(date) as hi from gappy group by ticker),
s as (select ticker, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from b),
sp as (select s.ticker, s.date, g.close, g.volume from s left join gappy g on s.ticker = g.ticker and s.date = g.date)"""


@query("c4_daily_spine", with_views(f""", {SPINE_SQL}
select ticker, date, round(close, 6) + 0.0 as close, volume from sp""", "gappy"))
def c4_daily_spine(spark, sf_dir):
    """C4: a daily calendar per ticker, left-joined with the sparse panel."""
    g = v(spark, sf_dir, "gappy").select("ticker", "date", "close", "volume")
    return align.daily_spine(g, "date", ["ticker"])


@query("c5_combine", with_views(""", k as (select series_id, date, value / 1000 as value from macro_obs)
select 'N6_x_N7' as series_id, coalesce(a.date, b.date) as date,
  round(a.value * b.value, 6) + 0.0 as value
from (select date, value from k where series_id = 'NATION_6') a
full join (select date, value from k where series_id = 'NATION_7') b on a.date = b.date
union all
select 'N6_per_N7', coalesce(a.date, b.date), round(case when b.value <> 0 then a.value / b.value end, 6) + 0.0
from (select date, value from k where series_id = 'NATION_6') a
full join (select date, value from k where series_id = 'NATION_7') b on a.date = b.date""", "macro_obs"))
def c5_combine(spark, sf_dir):
    """Date-aligned product and ratio of two series (values in
    thousands, so that the product keeps 6 decimals)."""
    m = v(spark, sf_dir, "macro_obs").withColumn("value", F.col("value") / 1000)
    return align.combine(m, "NATION_6", "NATION_7", "mul", "N6_x_N7").unionByName(
        align.combine(m, "NATION_6", "NATION_7", "div", "N6_per_N7")
    )


@query("c10_pairs", with_views("""select a.date, a.ticker as a, b.ticker as b, round(a.close, 6) + 0.0 as x_a,
round(b.close, 6) + 0.0 as x_b from bars a join bars b on a.date = b.date and a.ticker <= b.ticker""", "bars"))
def c10_pairs(spark, sf_dir):
    """Pair panel (a <= b) on common dates."""
    bars = v(spark, sf_dir, "bars")
    return features.pair_panel(bars, "close", pairs=features.symbol_pairs(bars))


# --------------------------------------------------------------------------- D3-D6


@query("d3_collapse_vintages", with_views(f"""select series_id, release_date, round(min_by(value, date), 6) + 0.0 as value
from ({ASOF_SQL}) where value is not null and release_date is not null group by series_id, release_date""", "macro_obs", "releases"))
def d3_collapse_vintages(spark, sf_dir):
    """D3: first non-NULL value per (series, release)."""
    a = align.asof_forward(v(spark, sf_dir, "macro_obs"), v(spark, sf_dir, "releases"))
    return align.collapse_vintages(a.where(F.col("release_date").isNotNull()))


@query("d4_date_bounds", with_views("select ticker, min(date) as min_date, max(date) as max_date from gappy group by ticker", "gappy"))
def d4_date_bounds(spark, sf_dir):
    """First and last date per ticker."""
    return panel.date_bounds(v(spark, sf_dir, "gappy"), "date", ["ticker"])


@query("d5_symbol_count", with_views("select count(distinct ticker) as n_symbols from supp_bars", "supp_bars"))
def d5_symbol_count(spark, sf_dir):
    """Number of distinct symbols."""
    return panel.symbol_count(v(spark, sf_dir, "supp_bars"))


@query("d6_chunk_count", with_views("""select ticker as jobname, count(distinct chunk) as n_chunks from
(select g.ticker, cast(floor(d.idx / 250) as integer) as chunk from gappy g join
 (select date, row_number() over (order by date) - 1 as idx from (select distinct date from gappy)) d on g.date = d.date)
group by ticker""", "gappy"))
def d6_chunk_count(spark, sf_dir):
    """Number of chunks per job (ticker as the job), counted in the engine."""
    c = folds.by_size(v(spark, sf_dir, "gappy"), 250).withColumnRenamed("ticker", "jobname")
    return store.chunk_count(c)


@query("h3_concat", with_views("select * from bars union all select * from gappy", "bars", "gappy"))
def h3_concat(spark, sf_dir):
    """H3: union all by name."""
    return panel.concat(v(spark, sf_dir, "bars"), v(spark, sf_dir, "gappy"))
