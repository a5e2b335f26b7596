"""Rows that joins, caps or missing values must not lose, and values they must not bend."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tsfolds.operators import clean, features, folds, jobs, panel, portfolio, report
from tsfolds.plans import blocked
from tsfolds.sources import io

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def test_null_keys_and_dates_stay(spark):
    rows = [("a", D0, 1.0), (None, D0, 2.0), (None, day(1), None), ("a", None, 3.0), ("a", day(1), None)]
    df = spark.createDataFrame(rows, "ticker string, date date, v double")
    got = sorted((str(r.ticker), str(r.date), r.v) for r in clean.ffill(df, ["v"]).collect())
    assert got == [("None", "2020-01-01", 2.0), ("None", "2020-01-02", 2.0), ("a", "2020-01-01", 1.0), ("a", "2020-01-02", 1.0), ("a", "None", 3.0)]
    assert report.returns_drawdown(df, "v", "ticker").count() == 5
    assert features.rsi(df, "v", 3, with_step="step").count() == 5
    assert folds.by_size(df, 1).count() == 5 and panel.with_step(df).count() == 5
    chunks = {str(r.date): r.chunk for r in folds.by_size(df, 1).collect()}
    assert chunks == {"2020-01-01": 0, "2020-01-02": 1, "None": None}


@pytest.mark.parametrize("B", [1, 2, 10, 50, 100, 250])
def test_smoothing_equals_the_loop(spark, B):
    values = [(math.sin(i * 1.7) + 1) * 50 if i % 11 else None for i in range(2500)]
    df = spark.createDataFrame([("a", day(i), i, x) for i, x in enumerate(values)], "ticker string, date date, step long, v double")
    got = [r.s for r in features.wilder_smooth(df, "v", 60.0, B, name="s").orderBy("date").collect()]
    s, want = 60.0, []
    for i, x in enumerate(values):
        if i > B:
            s = s if x is None else (x + (B - 1) * s) / B
            want.append(None if x is None else s)
        else:
            want.append(60.0)
    assert [g is None for g in got] == [w is None for w in want]
    assert max(abs(g - w) for g, w in zip(got, want) if w is not None) < 1e-9


def test_smoothing_holds_over_a_gap(spark):
    values = [60.0] * 20 + [None] * 30 + [60.0]
    df = spark.createDataFrame([("a", day(i), i, x) for i, x in enumerate(values)], "ticker string, date date, step long, v double")
    assert features.wilder_smooth(df, "v", 60.0, 10, name="s").orderBy("date").collect()[-1].s == pytest.approx(60.0, abs=1e-12)


def test_expanding_volatility_of_steady_growth_is_the_default(spark):
    df = spark.createDataFrame([("r", day(i), 0.001 + 1e-4) for i in range(900)], "run_id string, date date, excess_ret double")
    assert {r.ret_vol for r in portfolio.expanding_vol(df).collect()} == {portfolio.DEFAULT_VOL}
    values = [1e6 + math.sin(i) for i in range(900)]
    df = spark.createDataFrame([("r", day(i), x) for i, x in enumerate(values)], "run_id string, date date, excess_ret double")
    got = portfolio.expanding_vol(df).orderBy("date").collect()[-1].ret_vol
    mean = sum(values) / 900
    assert got == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in values) / 900), rel=1e-9)


def test_runs_keep_rows_without_a_value_and_their_length(spark):
    rows = [("r", day(i), i, None if i < 3 else 1000.0) for i in range(10)]
    df = spark.createDataFrame(rows, "run_id string, date date, step long, market_value double")
    assert portfolio.truncate_runs(df).count() == 10
    assert portfolio.truncate_runs(df, ep_length=10).count() == 9


def test_orders_without_a_price_count(spark):
    orders = spark.createDataFrame([("r", "a", day(0), 2.0), ("r", "a", day(2), 3.0), ("r", "b", day(1), 1.0)], "run_id string, ticker string, date date, qty double")
    prices = spark.createDataFrame([("a", day(0), 10.0), ("a", day(1), 11.0), ("a", day(3), 12.0)], "ticker string, date date, price double")
    got = {(r.ticker, r.date): (r.position, r.price, r.exec_price) for r in portfolio.positions(portfolio.grid(orders, prices)).collect()}
    assert got == {
        ("a", day(0)): (2.0, 10.0, 10.0), ("a", day(1)): (2.0, 11.0, 10.0), ("a", day(2)): (5.0, 11.0, 11.0), ("a", day(3)): (5.0, 12.0, 11.0),
        ("b", day(1)): (1.0, None, None),
    }


def test_walk_forward_computes_its_rows_once(spark):
    """Fits and scores of all folds read one written table, however many folds there are."""
    from pyspark.ml.regression import LinearRegression

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    src = spark.createDataFrame([(float(i), 2.0 * i, i // 5) for i in range(20)], "x double, y double, chunk int")
    got = folds.walk_forward(src.mapInArrow(counted, src.schema), LinearRegression(), ["x"], "y").collect()
    assert sorted((r.x, r.fold) for r in got) == [(float(i), i // 5 - 1) for i in range(5, 20)]
    assert seen.value == 20


def test_walk_forward_keeps_rows_with_a_missing_feature(spark):
    from pyspark.ml.regression import LinearRegression

    df = spark.createDataFrame([(i // 10, float(i) if i != 15 else None, 2.0 * i) for i in range(30)], "chunk int, x double, y double")
    got = folds.walk_forward(df, LinearRegression(), ["x"], "y").collect()
    assert len(got) == 20 and [r.x for r in got if r.prediction is None] == [None]


def test_short_series_keep_a_row(spark):
    df = spark.createDataFrame([("a", day(i), float(i + 1)) for i in range(4)] + [("b", day(i), float(i % 7 + 1)) for i in range(40)], "ticker string, date date, spot double")
    got = {r.ticker: r.hurst_structure for r in features.hurst_structure(df).collect()}
    assert got.keys() == {"a", "b"} and got["a"] is None and got["b"] is not None


def test_deep_trees_have_no_cap(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(8)], "name string, parent string")
    assert jobs.descendants(chain, "n0").count() == 7
    got = {r.node: (r.level, r.in_cycle) for r in jobs.levels(chain).collect()}
    assert got == {f"n{i}": (i, False) for i in range(8)}
    assert jobs.tree(chain).first().tree.count('"name"') == 8


def test_progress_with_a_fold_column(spark):
    df = spark.createDataFrame([("p.train.0", "p", 0.5, 2), ("p.validate.0", "p", 1.0, 2)], "name string, parent string, pct_complete double, n int")
    assert jobs.progress(df, 9, n_folds="n").first().pct_complete == pytest.approx((4.5 + 1) / 20)


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("a", day(i)) for i in range(50)], "ticker string, date date")
    pick = lambda n: sorted((r.episode, r.date) for r in panel.sample_windows(df.repartition(n), 5, 6, seed=3).collect())
    assert pick(1) == pick(4) and len(pick(1)) == 30


def test_windows_on_ties_keep_all_rows(spark):
    df = spark.createDataFrame([("a", day(i % 3), float(i)) for i in range(3000)], "ticker string, date date, v double")
    out = blocked.rolling(df, ["ticker"], "date", 5, lambda w: {"p": F.lag("v", 5).over(w)}, block=1)
    assert out.count() == 3000 and out.where("p is null").count() == 5


def test_replacing_a_table_replaces_all_of_it(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        io.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string"), p, partition_by="k")
        io.write_table(spark.createDataFrame([(3, "b")], "x int, k string"), p, partition_by="k")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert [(r.x, r.k) for r in spark.read.parquet(p).collect()] == [(3, "b")]


def test_series_files_with_missing_marks(spark, tmp_path):
    (tmp_path / "GDP.csv").write_text("date,value\n2020-01-01,1.5\n2020-02-01,.\n")
    assert [r.value for r in io.read_series(spark, str(tmp_path)).orderBy("date").collect()] == [1.5, None]


def test_vectors_keep_the_place_of_a_missing_value(spark):
    df = spark.createDataFrame([("r", day(0), 1.0), ("r", day(1), None), ("r", day(2), 3.0)], "run_id string, date date, v double")
    assert features.trailing_vector(df, "v", 3).orderBy("date").collect()[-1].ret_window == [1.0, None, 3.0]
