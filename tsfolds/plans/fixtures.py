"""Fixture views over the driver tables.

Each view is built twice: as a Spark DataFrame (what the library runs) and as
portable SQL (what the DuckDB oracle runs).  Both read the whole tables, so
the work grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _d(c):
    return F.to_date(F.col(c))


def _named(grouped: DataFrame) -> DataFrame:
    """Suppliers by name, once they are grouped: a key of eight bytes takes less room in the aggregates than its text."""
    return grouped.withColumnsRenamed({"l_suppkey": "ticker"}).withColumn("ticker", F.concat(F.lit("S"), F.col("ticker").cast("string")))


def bars(spark, sf_dir) -> DataFrame:
    """Dense panel: event type x day, OHLCV from the event values."""
    e = table(spark, sf_dir, "events").where(F.col("value") > 0)
    return e.groupBy(F.col("event_type").alias("ticker"), _d("ts").alias("date")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def gappy(spark, sf_dir) -> DataFrame:
    """Sparse panel: order priority x order day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), _d("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def supp_bars(spark, sf_dir) -> DataFrame:
    """Large sparse panel: supplier x ship day, prices per unit.  About 530
    dates per supplier at every scale, suppliers grow with the scale factor,
    so this is the panel the bench scales with."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 0)
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return _named(li.groupBy("l_suppkey", _d("l_shipdate").alias("date")).agg(
        F.round(F.avg(px), 6).alias("open"),
        F.max(px).alias("high"),
        F.min(px).alias("low"),
        F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("close"),
        F.sum("l_quantity").alias("volume"),
    ))


def fund(spark, sf_dir) -> DataFrame:
    """Monthly fundamentals per customer (customers grow with the scale factor)."""
    o = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    o = o.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"),
        F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("q"),
        "o_totalprice",
        "o_orderkey",
        "o_orderpriority",
        "c_acctbal",
    )
    r = o.groupBy("ticker", "q").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return (
        o.join(r, ["ticker", "q"])
        .groupBy("ticker", "date")
        .agg(
            F.max_by("o_totalprice", "o_orderkey").alias("closeadj"),
            F.round(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))), 2).alias("capex"),
            F.round(F.sum("c_acctbal"), 2).alias("equity"),
            F.max("revenue").alias("revenue"),
        )
        .withColumn("datekey", F.when(F.month("date") != 2, F.col("date")))
        .select("ticker", "date", "datekey", "closeadj", "capex", "equity", "revenue")
    )


def macro_obs(spark, sf_dir) -> DataFrame:
    """Long macro series: nation x month, mean line price, some NULLs."""
    li = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    d = F.to_date(F.date_trunc("month", "l_shipdate"))
    g = (
        li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("series_id"), d.alias("date"))
        .agg(F.max("n_nationkey").alias("k"), F.round(F.avg("l_extendedprice"), 6).alias("v"))
    )
    return g.select(
        "series_id",
        "date",
        F.when((F.col("k") % 5 == 0) & (F.month("date") == 6), F.lit(None).cast("double"))
        .otherwise(F.col("v"))
        .alias("value"),
    )


def releases(spark, sf_dir) -> DataFrame:
    """Release dates per series: the days a nation placed an urgent order.
    Irregular, and they stop before the last macro observation."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("series_id"), _d("o_orderdate").alias("release_date"))
        .distinct()
    )


def series_conf(spark, sf_dir) -> DataFrame:
    """Per-series percent-change flag and lag, from the nation table."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_name").alias("series_id"),
        (F.col("n_nationkey") % 2 == 0).alias("pct_chg"),
        F.when(F.col("n_nationkey") % 10 == 0, 4).otherwise(1).alias("n"),
    )


def orders_q(spark, sf_dir) -> DataFrame:
    """Signed traded quantity per run (return flag), ticker (supplier) and month."""
    li = table(spark, sf_dir, "lineitem")
    return _named(li.groupBy(
        F.col("l_returnflag").alias("run_id"),
        "l_suppkey",
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"),
    ).agg(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity"))).alias("qty")))


def prices(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 0)
    return _named(
        li.groupBy("l_suppkey", F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"))
        .agg(F.sqrt(F.max("l_extendedprice")).alias("price"))
    )  # the same double in every engine, and no rounding ties


def jobs(spark, sf_dir) -> DataFrame:
    """Job tree root -> region -> nation -> customer."""
    r = table(spark, sf_dir, "region")
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer")
    root = r.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("root").alias("name"), F.lit(None).cast("string").alias("parent")
    )
    return root.unionByName(r.select(F.col("r_name").alias("name"), F.lit("root").alias("parent"))).unionByName(
        n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_name").alias("name"), F.col("r_name").alias("parent")
        )
    ).unionByName(
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_name").alias("name"), F.col("n_name").alias("parent")
        )
    )


def deep_jobs(spark, sf_dir) -> DataFrame:
    """Job trees whose depth grows with the data: the customers of a nation hang one below the other in the order of
    their keys; every fourth key hangs beside the chain."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, -1)
    above = F.max(F.when(F.col("c_custkey") % 4 != 0, F.struct("c_custkey", "c_name"))).over(w)["c_name"]
    below = c.select(F.col("c_name").alias("name"), F.coalesce(above, F.col("n_name")).alias("parent"))
    return n.select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("parent")).unionByName(below)


def job_log(spark, sf_dir) -> DataFrame:
    """Append-only progress log of fold jobs."""
    e = table(spark, sf_dir, "events")
    job = F.concat(F.lit("job"), (F.col("user_id") % 3).cast("string"))
    kind = F.when(F.col("event_type").isin("click", "view"), F.lit(".train.")).otherwise(F.lit(".validate."))
    return e.select(
        F.concat(job, kind, (F.col("user_id") % 4).cast("string")).alias("name"),
        job.alias("parent"),
        "ts",
        F.when(F.col("value") > 100, F.lit(1.0)).otherwise(F.round(F.col("value") / 100, 4)).alias("pct_complete"),
    )


def workers(spark, sf_dir) -> DataFrame:
    """Workers named after suppliers; job = the customer whose key is 20x the
    supplier key (keys beyond the customer range give orphans)."""
    s = table(spark, sf_dir, "supplier")
    c = table(spark, sf_dir, "customer")
    return s.join(c, F.col("s_suppkey") * 20 == F.col("c_custkey"), "left").select(
        F.col("s_suppkey").alias("id"),
        F.coalesce(F.col("c_name"), F.concat(F.lit("missing#"), F.col("s_suppkey").cast("string"))).alias("jobname"),
        F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias("name"),
        F.when(F.col("s_acctbal") > 0, F.lit("running")).otherwise(F.lit("idle")).alias("status"),
    )


# ---------------------------------------------------------------------------
# The same views as portable SQL, for the DuckDB oracle (CTE bodies).
SQL = {
    "bars": """select event_type as ticker, cast(ts as date) as date, min_by(value, ts) as open, max(value) as high,
       min(value) as low, max_by(value, ts) as close, count(*) as volume
from events where value > 0 group by event_type, cast(ts as date)""",
    "gappy": """select o_orderpriority as ticker, cast(o_orderdate as date) as date, min_by(o_totalprice, o_orderkey) as open,
       max(o_totalprice) as high, min(o_totalprice) as low, max_by(o_totalprice, o_orderkey) as close, count(*) as volume
from orders group by o_orderpriority, cast(o_orderdate as date)""",
    "supp_bars": """select 'S' || cast(l_suppkey as varchar) as ticker, cast(l_shipdate as date) as date,
       round(avg(l_extendedprice / l_quantity), 6) as open, max(l_extendedprice / l_quantity) as high,
       min(l_extendedprice / l_quantity) as low, round(sum(l_extendedprice) / sum(l_quantity), 6) as close,
       sum(l_quantity) as volume
from lineitem where l_quantity > 0 group by l_suppkey, cast(l_shipdate as date)""",
    "fund": """with o as (select 'C' || cast(o_custkey as varchar) as ticker, cast(date_trunc('month', o_orderdate) as date) as date,
                  cast(date_trunc('quarter', o_orderdate) as date) as q, o_totalprice, o_orderkey, o_orderpriority, c_acctbal
           from orders join customer on o_custkey = c_custkey),
     r as (select ticker, q, round(sum(o_totalprice), 2) as revenue from o group by ticker, q)
select o.ticker, o.date, case when month(o.date) = 2 then null else o.date end as datekey,
       max_by(o_totalprice, o_orderkey) as closeadj,
       round(sum(case when o_orderpriority = '1-URGENT' then o_totalprice end), 2) as capex,
       round(sum(c_acctbal), 2) as equity, max(r.revenue) as revenue
from o join r on o.ticker = r.ticker and o.q = r.q group by o.ticker, o.date""",
    "macro_obs": """select n_name as series_id, cast(date_trunc('month', l_shipdate) as date) as date,
       case when max(n_nationkey) % 5 = 0 and month(cast(date_trunc('month', l_shipdate) as date)) = 6 then null
            else round(avg(l_extendedprice), 6) end as value
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
group by n_name, cast(date_trunc('month', l_shipdate) as date)""",
    "releases": """select distinct n_name as series_id, cast(o_orderdate as date) as release_date
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where o_orderpriority = '1-URGENT'""",
    "series_conf": """select n_name as series_id, n_nationkey % 2 = 0 as pct_chg,
       case when n_nationkey % 10 = 0 then 4 else 1 end as n from nation""",
    "orders_q": """select l_returnflag as run_id, 'S' || cast(l_suppkey as varchar) as ticker,
       cast(date_trunc('month', l_shipdate) as date) as date,
       sum(case when l_linestatus = 'O' then l_quantity else -l_quantity end) as qty
from lineitem group by l_returnflag, l_suppkey, cast(date_trunc('month', l_shipdate) as date)""",
    "prices": """select 'S' || cast(l_suppkey as varchar) as ticker, cast(date_trunc('month', l_shipdate) as date) as date,
       sqrt(max(l_extendedprice)) as price
from lineitem where l_quantity > 0 group by l_suppkey, cast(date_trunc('month', l_shipdate) as date)""",
    "jobs": """select 'root' as name, cast(null as varchar) as parent union all select r_name, 'root' from region
union all select n_name, r_name from nation join region on n_regionkey = r_regionkey
union all select c_name, n_name from customer join nation on c_nationkey = n_nationkey""",
    "deep_jobs": """select n_name as name, cast(null as varchar) as parent from nation
union all select c_name, coalesce(max(case when c_custkey % 4 <> 0 then struct_pack(k := c_custkey, n := c_name) end)
    over (partition by n_name order by c_custkey rows between unbounded preceding and 1 preceding).n, n_name)
  from customer join nation on c_nationkey = n_nationkey""",
    "job_log": """select 'job' || cast(user_id % 3 as varchar)
         || case when event_type in ('click', 'view') then '.train.' else '.validate.' end
         || cast(user_id % 4 as varchar) as name,
       'job' || cast(user_id % 3 as varchar) as parent, ts,
       case when value > 100 then 1.0 else round(value / 100, 4) end as pct_complete
from events""",
    "workers": """select s_suppkey as id, coalesce(c_name, 'missing#' || cast(s_suppkey as varchar)) as jobname,
       'w' || cast(s_suppkey as varchar) as name, case when s_acctbal > 0 then 'running' else 'idle' end as status
from supplier left join customer on s_suppkey * 20 = c_custkey""",
}

BUILDERS = {
    "bars": bars,
    "gappy": gappy,
    "supp_bars": supp_bars,
    "fund": fund,
    "macro_obs": macro_obs,
    "releases": releases,
    "series_conf": series_conf,
    "orders_q": orders_q,
    "prices": prices,
    "jobs": jobs,
    "deep_jobs": deep_jobs,
    "job_log": job_log,
    "workers": workers,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, sf_dir)


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the named fixture views as CTEs; a body starting
    with a comma continues the CTE list."""
    ctes = ",\n".join(f"{n} as ({SQL[n]})" for n in names)
    return f"with {ctes}\n{body}"
