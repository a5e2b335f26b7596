"""Hand-worked golden values (FIXTURES.md section 4) through the operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tsfolds.functions import logistic, yeo_johnson
from tsfolds.operators import align, features, folds, jobs, portfolio, report

X = [10, 11, 10.5, 12, 11.5, 12.5, 13, 12, 12.8, 13.5, 13.1]
D0 = dt.date(2020, 1, 1)


def series(spark, xs, extra=None):
    rows = [("T", D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "ticker string, date date, spot double")


def last(df, col):
    return df.orderBy(F.desc("date")).first()[col]


def test_rsi(spark):
    assert last(features.rsi(series(spark, X)), "rsi") == pytest.approx(69.62025316455696, abs=1e-12)


def test_hurst(spark):
    assert last(features.hurst(series(spark, X)), "hurst") == pytest.approx(0.26655857491882007, abs=1e-12)


def test_distances_percentile_return(spark):
    d = features.range_distance(series(spark, X))
    assert last(d, "dist_max") == pytest.approx(1.0305343511450382)
    assert last(d, "dist_min") == pytest.approx(1.31)
    assert last(features.rolling_percentile(series(spark, X)), "spot_rank") == pytest.approx(1 / 11)
    assert last(features.log_return(series(spark, X), "spot"), "ret") == pytest.approx(-0.03007745523727795)


def test_smoothing_of_rsi(spark):
    # one update of the seed 50 with the RSI above: (69.62 + 9 * 50) / 10
    xs = X
    x = features.rsi(series(spark, xs))
    from tsfolds.plans import blocked

    x = blocked.rolling(x, ["ticker"], "date", 0, lambda w: {}, with_step="step")
    # step of the last row is 10 = B: not yet updated; shift steps by one to update once
    x = x.withColumn("step", F.col("step") + 1)
    s = features.wilder_smooth(x, "rsi", 50.0, name="rsi_s")
    assert last(s, "rsi_s") == pytest.approx(51.962025316455694)


def test_causal_filter_and_strength(spark):
    df = series(spark, X).withColumn("f", (F.datediff("date", F.lit(D0)).cast("double")) ** 2)
    r = features.causal_strength(df, "spot", ["f"])
    assert last(r, "causal_f") == pytest.approx(-0.6336170186613116, abs=1e-12)
    from tsfolds.plans import blocked

    exp = [10, 6, 2.5, 2.75, 0.875, 1.4375, 1.21875, -0.390625, 0.604688, 1.002344, 0.101172]
    y = blocked.rolling(series(spark, X), ["ticker"], "date", 10, features._causal_stages("spot", [], 10))
    assert [round(last(y, f"_y{i}"), 6) for i in range(11)] == pytest.approx(exp, abs=1e-6)


def test_rogers_satchell(spark):
    df = spark.createDataFrame([(10.0, 12.0, 9.0, 11.0)], "open double, high double, low double, close double")
    assert features.rogers_satchell(df).first()["intraday_vol"] == pytest.approx(0.03700681766284182)


def test_sharpe_index_drawdown(spark):
    mv = [100, 102, 101, 105, 99]
    df = spark.createDataFrame([("r", D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(mv)],
                               "run_id string, date date, market_value double")
    r = features.log_return(df, "market_value", "run_id", "date", "ret")
    x = report.returns_drawdown(r, "ret", "run_id").orderBy("date").collect()
    assert [round(v["ret_index"], 6) for v in x[1:]] == pytest.approx([102, 101, 105, 99])
    assert [round(v["drawdown"], 6) for v in x[1:]] == pytest.approx([0, -0.98039216, 0, -5.71428571], abs=1e-6)
    s = report.summary(r, "ret", "run_id").first()
    assert s["sharpe"] == pytest.approx(-0.9371170300571358)


def test_yeo_johnson_logistic(spark):
    df = spark.createDataFrame([(-1.5,), (0.0,), (0.5,), (2.0,)], "x double")
    out = df.select(yeo_johnson("x", 0.9).alias("y")).withColumn("s", logistic("y")).collect()
    assert [o["y"] for o in out] == pytest.approx([-1.5817232417845848, 0.0, 0.48932972354258564, 1.875417088358096])
    assert [o["s"] for o in out] == pytest.approx([0.17055156739671365, 0.5, 0.6199485196319248, 0.8670838363691271])


def _dates(spark, n):
    return spark.createDataFrame([(D0 + dt.timedelta(days=i),) for i in range(n)], "date date")


def test_chunking(spark):
    sizes = lambda df: [r["n"] for r in df.groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()]  # noqa
    assert sizes(folds.by_size(_dates(spark, 11), 4)) == [4, 4, 3]
    assert sizes(folds.by_number(_dates(spark, 11), 4)) == [2, 2, 2, 2, 2, 1]
    assert sizes(folds.equal(_dates(spark, 11), 4)) == [2, 2, 2, 2]
    with pytest.raises(ValueError):
        folds.by_number(_dates(spark, 3), 4)


def test_standardize_prior(spark):
    rows = [(0, 1.0), (0, 2.0), (0, 3.0), (1, 4.0), (1, 6.0), (2, 5.0)]
    df = spark.createDataFrame(rows, "chunk int, v double")
    z = folds.standardize_prior(df, cols=["v"]).orderBy("chunk", "v").collect()
    got = [round(r["v"], 12) for r in z]
    assert got[:3] == [-1.0, 0.0, 1.0]
    assert got[3:5] == [round((4 - 2) / 1.0, 12), round((6 - 2) / 1.0, 12)]
    assert got[5] == pytest.approx((5 - 3.2) / 1.9235384061671346)


def test_weights_and_rebalance(spark):
    df = spark.createDataFrame([("r", "d", i, float(m)) for i, m in enumerate([2, -1, 6, 0])], "run_id string, date string, i int, model double")
    w = portfolio.weights(df, "model", 1.0, 0.05, ["run_id", "date"]).orderBy("i").collect()
    assert [r["target_weight"] for r in w] == pytest.approx([0.25, -0.05, 0.75, 0.0])
    o = spark.createDataFrame([("r", "d", 0.6, 0.2, 1000.0, 10.0, 8), ("r", "d", -0.1, 0.0, 1000.0, 20.0, 8)],
                              "run_id string, date string, target_weight double, actual_weight double, value double, price double, step int")
    got = portfolio.rebalance_orders(o).orderBy("price").collect()
    assert [r["deviation"] for r in got] == pytest.approx([0.16, -0.04])
    assert [r["qty"] for r in got] == pytest.approx([16, -2])


def test_cash_and_valuation(spark):
    prices = spark.createDataFrame([("A", D0 + dt.timedelta(days=i), p) for i, p in enumerate([10.0, 11.0, 12.0])],
                                   "ticker string, date date, price double")
    orders = spark.createDataFrame([("r", "A", D0, 5.0), ("r", "A", D0 + dt.timedelta(days=2), -2.0)],
                                   "run_id string, ticker string, date date, qty double")
    g = portfolio.positions(portfolio.grid(orders, prices))
    c = portfolio.cash(g, 1000.0, 0.01, 0.0025)
    v = portfolio.valuation(g, c).orderBy("date").collect()
    assert [r["balance"] for r in v] == pytest.approx([949.9146825396824, 949.9523775667673, 971.9350740896865], abs=1e-9)
    assert [r["market_value"] for r in v] == pytest.approx([999.9146825396824, 1004.9523775667673, 1007.9350740896865], abs=1e-9)


def test_asof_forward(spark):
    obs = spark.createDataFrame([("s", dt.date(2020, m, 1)) for m in (1, 2, 3)], "series_id string, date date")
    rel = spark.createDataFrame([("s", dt.date(2020, 1, 15)), ("s", dt.date(2020, 2, 1))], "series_id string, release_date date")
    got = [r["release_date"] for r in align.asof_forward(obs, rel).orderBy("date").collect()]
    assert got == [dt.date(2020, 1, 15), dt.date(2020, 2, 1), None]
    got = [r["release_date"] for r in align.asof_forward(obs, rel, fallback="last").orderBy("date").collect()]
    assert got[-1] == dt.date(2020, 2, 1)


def test_release_indicator_and_ma(spark):
    rev = [5.0, 5.0, 7.0, None, 7.0]
    df = spark.createDataFrame([("T", D0 + dt.timedelta(days=i), v) for i, v in enumerate(rev)], "ticker string, date date, revenue double")
    got = [r["release_indicator"] for r in features.release_indicator(df).orderBy("date").collect()]
    assert got == [1, 0, 1, 1, 1]
    s = spark.createDataFrame([("T", D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate([1, 2, 3, 4])], "ticker string, date date, x double")
    assert [r["x_ma2"] for r in features.moving_average(s, "x", 2).orderBy("date").collect()] == [1.5, 2.5, 3.5]


def test_progress_rollup(spark):
    st = spark.createDataFrame(
        [("j.train.0", "j", 1.0), ("j.train.1", "j", 0.5), ("j.validate.0", "j", 1.0), ("j.validate.1", "j", 0.0)],
        "name string, parent string, pct_complete double",
    )
    assert jobs.progress(st, 9).first()["pct_complete"] == pytest.approx(0.725)


def test_levels_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "y")], "parent string, name string")
    got = {r["node"]: (r["level"], r["in_cycle"]) for r in jobs.levels(e).collect()}
    assert got["x"] == (0, False) and got["y"] == (1, False)
    assert got["a"] == (None, True) and got["b"] == (None, True)


def test_descendants_cycle_ends(spark):
    j = spark.createDataFrame([("a", "root"), ("b", "a"), ("a2", "b"), ("b", "a2")], "name string, parent string")
    got = sorted((r["name"], r["level"]) for r in jobs.descendants(j, "root").collect())
    assert got == [("a", 1), ("a2", 3), ("b", 2)]


def test_feature_graph(spark):
    from tsfolds.plans.pipeline import FeatureGraph, GraphError

    g = FeatureGraph()
    base = spark.createDataFrame([(42,)], "v int")
    g.add("node1", lambda: base)
    g.add("node2", lambda d, k: d.select((F.col("v") * k).alias("v")), ["node1"], k=2)
    g.add("node3", lambda: base.select(F.lit(10).alias("v")))
    g.add("node4", lambda a, b: a.join(b.withColumnRenamed("v", "w")).select((F.col("v") + F.col("w")).alias("v")), ["node2", "node3"])
    assert g.build("node4").first()["v"] == 94
    assert g.levels() == {"node1": 0, "node2": 1, "node3": 0, "node4": 2}
    g.add("bad", lambda d: d, ["missing"])
    with pytest.raises(GraphError):
        g.build("node4")
    h = FeatureGraph()
    h.add("a", lambda d: d, ["b"]).add("b", lambda d: d, ["a"])
    with pytest.raises(GraphError):
        h.order()


def test_yeo_johnson_special_lambdas(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,)], "x double")
    y0 = [r[0] for r in df.select(yeo_johnson("x", 0.0)).collect()]
    assert y0[0] == pytest.approx(math.log(2.0))
    y2 = [r[0] for r in df.select(yeo_johnson("x", 2.0)).collect()]
    assert y2[1] == pytest.approx(-math.log(2.0))
