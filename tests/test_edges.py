"""Edge panels (FIXTURES.md): one row, one symbol, constant price, zero
price, gaps, duplicate keys, all-NULL column, NaN next to NULL.  No operator
may fail under ANSI mode, and undefined values come out NULL."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tsfolds.operators import clean, features, folds, report

D0 = dt.date(2020, 1, 1)


def mk(spark, vals, ticker="T", step=1):
    rows = [(ticker, D0 + dt.timedelta(days=i * step), v) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "ticker string, date date, spot double")


CASES = {
    "one_row": [10.0],
    "constant": [5.0] * 30,
    "zero_price": [1.0, 0.0, 2.0, 0.0, 3.0] * 5,
    "with_null": [1.0, None, 2.0, None, 3.0] * 5,
    "with_nan": [1.0, float("nan"), 2.0, None, 3.0] * 5,
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_feature_family_does_not_fail(spark, case):
    df = mk(spark, CASES[case])
    if case == "with_nan":
        df = clean.nan_to_null(df)
    out = features.panel_state(clean.require(df, ["spot"]) if case in ("with_null", "with_nan") else df, "spot")
    rows = out.collect()
    assert len(rows) == df.na.drop(subset=["spot"]).count() if case in ("with_null", "with_nan") else len(CASES[case])
    r = features.log_return(df, "spot")
    s = report.summary(r, "ret", "ticker").collect()
    assert len(s) == 1
    features.hurst(df, "spot").collect()
    features.rsi(df, "spot").collect()
    features.range_distance(df, "spot").collect()
    features.rolling_percentile(df, "spot").collect()


def test_constant_price_gives_null_not_error(spark):
    df = mk(spark, [5.0] * 20)
    h = features.hurst(df, "spot").where(F.col("hurst").isNotNull()).count()
    assert h == 0  # zero std at every lag: ln(0) is undefined -> NULL
    rsi = [r["rsi"] for r in features.rsi(df, "spot").orderBy("date").collect()]
    assert rsi[0] is None and all(v == 100.0 for v in rsi[1:])


def test_standardize_zero_std(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 2.0)], "chunk int, v double")
    z = [r["v"] for r in folds.standardize_prior(df, cols=["v"]).orderBy("chunk").collect()]
    assert z == [None, None, None]
    z0 = [r["v"] for r in folds.standardize_prior(df, cols=["v"], zero_std=0.0).orderBy("chunk").collect()]
    assert z0 == [0.0, 0.0, 0.0]


def test_all_null_column_and_gaps(spark):
    df = mk(spark, [None] * 10, step=3).withColumn("spot", F.col("spot").cast("double"))
    ff = clean.ffill(df, ["spot"])
    assert ff.where(F.col("spot").isNotNull()).count() == 0
    spine = clean.ffill(
        mk(spark, [1.0, 2.0], step=5).transform(lambda d: d), ["spot"]
    )
    assert spine.count() == 2


def test_duplicate_keys_do_not_fail(spark):
    df = mk(spark, [1.0, 2.0, 3.0]).unionByName(mk(spark, [1.5, 2.5, 3.5]))
    assert features.log_return(df, "spot").count() == 6
    assert folds.by_size(df, 2).select("chunk").distinct().count() == 2
