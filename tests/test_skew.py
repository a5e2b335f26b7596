"""A hot key is split: the window stage of a blocked operator spreads one
ticker over many tasks, while a plain per-ticker window holds it in one."""

import datetime as dt
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tsfolds.operators import features
from tsfolds.plans import blocked, fixtures

D0 = dt.date(2000, 1, 1)


def test_hot_ticker_spreads_over_tasks(spark):
    hot = spark.range(0, 20000).select(
        F.lit("HOT").alias("ticker"), F.date_add(F.lit(D0), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("x")
    )
    cold = spark.range(0, 300).select(
        F.concat(F.lit("C"), (F.col("id") % 3).cast("string")).alias("ticker"),
        F.date_add(F.lit(D0), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("x"),
    )
    df = hot.unionByName(cold)
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = blocked.rolling(df, ["ticker"], "date", 5, lambda w: {"m": F.avg("x").over(w.rowsBetween(-5, 0))})
        out = out.withColumn("pid", F.spark_partition_id())
        tasks = out.where((F.col("ticker") == "HOT") & F.col("m").isNotNull()).select("pid").distinct().count()
        plain = df.select("ticker", F.avg("x").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(-5, 0)).alias("m"))
        plain = plain.withColumn("pid", F.spark_partition_id())
        plain_tasks = plain.where((F.col("ticker") == "HOT") & F.col("m").isNotNull()).select("pid").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)
    assert plain_tasks == 1
    assert tasks >= 4
    # and the values are those of the plain window
    a = {r["date"]: r["m"] for r in out.where(F.col("ticker") == "HOT").select("date", "m").collect()}
    b = df.where(F.col("ticker") == "HOT").select(
        "date", F.avg("x").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(-5, 0)).alias("m")
    ).collect()
    assert all(abs(a[r["date"]] - r["m"]) < 1e-9 for r in b)


def test_affine_scan_against_a_loop(spark):
    """Zero, negative, tiny and missing gains, several recursions at once, NULL keys and block widths from 1 up."""
    import numpy as np

    from tsfolds.plans import blocked

    rng = np.random.default_rng(9)
    rows, want = [], {}
    for key in ("a", None, "b"):
        y, z = 5.0, -1.0
        for t in range(400):
            m = None if rng.random() < 0.1 else float(rng.choice([0.0, -0.7, 1e-40, 1e30, 1.01, 0.5, 2.0, -3.0])) if rng.random() < 0.5 else 0.9
            c = None if rng.random() < 0.1 else float(rng.normal())
            if m is not None and c is not None and abs(m * y + c) > 1e60:
                m = 0.0
            rows.append((key, t, m, c))
            y = y if m is None or c is None else m * y + c
            z = z if c is None else 0.99 * z + c
            want[key, t] = (y, z)
    df = spark.createDataFrame(rows, "k string, t long, m double, c double")
    from pyspark.sql import functions as F

    for block in (1, 37, 1000):
        got = blocked.affine(df, ["k"], "t", {"y": ("m", "c", 5.0), "z": (F.lit(0.99), "c", -1.0)}, block=block).collect()
        assert len(got) == len(rows) and got[0].__fields__ == ["k", "t", "m", "c", "y", "z"]
        for r in got:
            y, z = want[r.k, r.t]
            assert abs(r.y - y) <= 1e-9 * max(1, abs(y)) and abs(r.z - z) <= 1e-9 * max(1, abs(z))
    assert blocked.affine(df.limit(0), ["k"], "t", {"y": ("m", "c", 5.0)}).collect() == []


def test_affine_scan_over_a_million_steps(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tsfolds.plans import blocked

    n = 1_000_000
    df = spark.range(n).select("id", (1 + (F.col("id") % 7 - 3) * 1e-4).alias("m"), ((F.col("id") * 37 % 101) - 50).cast("double").alias("c"))
    got = blocked.affine(df, [], "id", {"y": ("m", "c", 1000.0)}, block=10_000).where("id % 9973 = 0 or id > 999990").toPandas()
    m, c = (1 + (np.arange(n) % 7 - 3) * 1e-4).tolist(), ((np.arange(n) * 37 % 101) - 50.0).tolist()
    y, out = 1000.0, np.empty(n)
    for t in range(n):
        y = m[t] * y + c[t]
        out[t] = y
    scale = np.abs(out).max()
    assert (np.abs(got.y.to_numpy() - out[got.id.to_numpy()]) <= 1e-9 * scale).all()


def test_rows_of_one_time_have_one_order(spark):
    """Running results over rows of one key and time do not depend on the block width or on where the rows lie."""
    day = F.date_add(F.lit(D0), (F.col("id") % 7).cast("int"))
    value = F.when(F.col("id") % 5 > 0, (F.col("id") * 7919 % 101).cast("double") / 3)
    df = spark.range(0, 400).select(
        (F.col("id") % 3).alias("ticker"), day.alias("date"), F.col("id").alias("row"), value.alias("x"),
        F.when(F.col("id") % 4 == 0, 0.5).otherwise(0.25).alias("m"),
    )

    def results(d, width):
        a = blocked.running(d, ["ticker"], "date", {"last": ("last", "x"), "peak": ("max", "x"), "total": ("sum", "x")}, block=width, with_step="step")
        b = blocked.affine(d, ["ticker"], "date", {"y": ("m", "x", 1.0)}, block=width)
        c = blocked.running_moments(d, ["ticker"], "date", "x", "n", "m2", block=width)
        e = blocked.running_sum_peak(d, ["ticker"], "date", "x", "s", "p", block=width)
        out = {}
        for part in (a, b, c, e):
            for r in part.collect():
                r = r.asDict()
                out.setdefault(r.pop("row"), {}).update(r)
        return out

    w = Window.partitionBy("ticker").orderBy("date", blocked.tie_break(df))
    plain = {r["row"]: r["v"] for r in df.select("row", F.last("x", ignorenulls=True).over(w).alias("v")).collect()}
    first = results(df, 1)
    assert {k: r["last"] for k, r in first.items()} == plain
    for d, width in ((df.repartition(7, "x"), 400), (df.orderBy(F.desc("row")).coalesce(1), 3)):
        for k, r in results(d, width).items():
            for name, v in r.items():
                u = first[k][name]
                assert u == v or abs(u - v) < 1e-6, (k, name, u, v)


def test_blocks_are_dealt_once(spark):
    """The windows and the smoothing run over the blocks where they lie: copies of boundary rows and entering states come to them."""
    rows = [(f"T{i % 7}", dt.date(2020, 1, 1) + dt.timedelta(days=i // 7), float(i * 37 % 101 + 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "ticker string, date date, spot double")
    out = features.rolling_percentile(df, "spot", 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("Union")
    between = plan[plan.index("Window") : plan.index("Union")]
    assert "Exchange" not in between
    state = features.panel_state(df, "spot", 10)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in state
    assert "Exchange" not in state[: state.index("Union")]


def test_suppliers_are_grouped_by_key(spark, tmp_path):
    """The aggregates of the supplier views hold the key, not its text; a row without a supplier has no ticker."""
    day = dt.datetime(2020, 1, 1)
    rows = [(k, 2.0, 10.0, "A", "O", day) for k in (1, 1, 12, None)]
    spark.createDataFrame(
        rows, "l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("supp_bars", "orders_q", "prices"):
        x = fixtures.view(spark, str(tmp_path), name)
        exchange = x._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1].split(")")[0]
        assert "l_suppkey" in exchange, (name, exchange)
        assert {r.ticker for r in x.collect()} == {"S1", "S12", None}


def _structure_exponent(x, max_lag):
    """The definition, row by row; a missing value takes its pairs with it."""
    taus, lag = [], min(len(x) // 2, max_lag)
    while lag > 2:
        pairs = [(x[j], x[j + lag]) for j in range(len(x) - lag)]
        squares = [(b - a) ** 2 for a, b in pairs if a is not None and b is not None]
        levels = [a for a, _ in pairs if a is not None]
        taus.append((lag, math.sqrt(sum(squares) / len(squares) / (sum(levels) / len(levels)))))
        lag //= 2
    if len(taus) < 2:
        return None
    (hi, a), (lo, b) = taus[0], taus[-1]
    return (math.log10(a) - math.log10(b)) / (math.log10(hi) - math.log10(lo))


def test_structure_exponent_against_a_loop(spark):
    """Series of every length around the lags, in thin, thick and mixed blocks, with missing values, times and keys."""
    import random

    rng = random.Random(4)
    times = {
        **{f"n{n}": range(n) for n in (1, 5, 6, 12, 15, 16, 17, 18, 33)},
        "thick": range(1500), "thin": range(0, 90_000, 60), "cut": range(120, 137), "gaps": [t for t in range(4000) if t // 500 % 2],
        "thin, thick": [*range(0, 3000, 70), *range(3000, 3700)], "thick, thin": [*range(700), *range(1000, 9000, 70), *range(9000, 9300)],
    }
    series = {k: [(t, None if rng.random() < 0.1 and k != "n6" else 50 + 40 * rng.random()) for t in ts] for k, ts in times.items()}
    series["untimed"] = [(None, 70.0), *series["thick"][:200]]
    rows = [(k, len(k), t, v) for k, s in series.items() for t, v in s]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1, 1, 2.0), ("thin", None, 1, 2.0)], "k string, size int, t long, v double")
    want = {(k, len(k)): _structure_exponent([v for _, v in s], 8) for k, s in series.items()} | {(None, 1): None, ("thin", None): None}
    assert sum(v is None for v in want.values()) < len(want) / 2
    by_day = df.withColumn("t", F.timestamp_seconds(F.col("t") * 720))  # 120 to a block
    for x, width in ((df, 1), (df, 1000), (df.repartition(9), 10**6), (by_day, 1)):
        spark.conf.set(blocked.BLOCK_CONF, str(width))
        try:
            got = {(r.k, r.size): r.hurst_structure for r in features.hurst_structure(x, "v", ["k", "size"], "t", 8).collect()}
        finally:
            spark.conf.unset(blocked.BLOCK_CONF)
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert (got[k] is None) if v is None else abs(got[k] - v) < 1e-9, (k, got[k], v)


def test_structure_exponent_deals_its_rows_once(spark):
    """The rows are read and dealt once, whatever the number of lags: no pair of rows is a row."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(f"T{i % 3}", D0 + dt.timedelta(days=i // 3), float(i * 37 % 101 + 1)) for i in range(3000)]
    src = spark.createDataFrame(rows, "ticker string, date date, spot double")
    out = features.hurst_structure(src.mapInArrow(counted, src.schema))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2
    got = {r.ticker: r.hurst_structure for r in out.collect()}
    assert seen.value == 3000
    for k, v in got.items():
        assert abs(v - _structure_exponent([x for t, _, x in rows if t == k], 300)) < 1e-9
