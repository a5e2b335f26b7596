"""Spark operators against plain NumPy loops on random panels, and
metamorphic checks (results do not depend on the time-block width)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsfolds.operators import features, portfolio
from tsfolds.plans import blocked

D0 = dt.date(2020, 1, 1)
B = 10


def panel(spark, n_tickers=3, n=80, seed=1, gaps=True):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(n_tickers):
        day = 0
        x = 100.0
        for _ in range(n):
            day += int(rng.integers(1, 4)) if gaps else 1
            x *= float(np.exp(rng.normal(0, 0.02)))
            rows.append((f"T{t}", D0 + dt.timedelta(days=day), x, float(rng.normal())))
    return spark.createDataFrame(rows, "ticker string, date date, spot double, f double")


def by_ticker(df, col):
    pdf = df.select("ticker", "date", col).toPandas().sort_values(["ticker", "date"])
    return {t: g[col].to_numpy() for t, g in pdf.groupby("ticker")}


def np_smooth(v, seed, B):
    s, out = seed, []
    for i, x in enumerate(v):
        if i > B:
            s = (x + (B - 1) * s) / B
        out.append(s)
    return np.array(out)


def lfilter(x):
    y, px, py = [], 0.0, 0.0
    for v in x:
        cur = v - px + 0.5 * py
        y.append(cur)
        px, py = v, cur
    return np.array(y)


def test_causal_strength_vs_numpy(spark):
    df = panel(spark)
    got = by_ticker(features.causal_strength(df, "spot", ["f"], B), "causal_f")
    xs, fs = by_ticker(df, "spot"), by_ticker(df, "f")
    for t in xs:
        for i in range(B, len(xs[t])):
            w = xs[t][i - B:i + 1]
            c = np.corrcoef(lfilter(w), fs[t][i - B:i + 1])[0, 1]
            assert got[t][i] == pytest.approx(np.nan_to_num(c), abs=1e-9)


def test_smoothing_vs_loop(spark):
    df = panel(spark, n=400, gaps=False)
    x = features.rsi(df, "spot", B)
    x = blocked.rolling(x, ["ticker"], "date", 0, lambda w: {}, with_step="step")
    got = by_ticker(features.wilder_smooth(x, "rsi", 50.0, B, name="s"), "s")
    rsi = by_ticker(x, "rsi")
    for t in got:
        exp = np_smooth(rsi[t], 50.0, B)
        assert np.allclose(got[t], exp, atol=1e-9)


def test_lag_tensor_padding(spark):
    df = panel(spark, n_tickers=1, n=5)
    got = features.lag_tensor(df, ["spot"], 3).orderBy("date").select("obs").collect()
    xs = by_ticker(df, "spot")["T0"]
    assert [v[0] for v in got[0]["obs"]] == pytest.approx([xs[0]] * 3)
    assert [v[0] for v in got[1]["obs"]] == pytest.approx([xs[0], xs[0], xs[1]])
    assert [v[0] for v in got[4]["obs"]] == pytest.approx(list(xs[2:5]))


@pytest.mark.parametrize("width", [1, 5, 40, 400])
def test_block_width_invariance(spark, width):
    df = panel(spark, n=120)
    spark.conf.set(blocked.BLOCK_CONF, str(width))
    try:
        a = features.panel_state(df, "spot", B).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
        r = features.log_return(df, "spot")
        from tsfolds.operators import report

        s = report.summary(r, "ret", "ticker").toPandas().sort_values("ticker").reset_index(drop=True)
    finally:
        spark.conf.unset(blocked.BLOCK_CONF)
    b = features.panel_state(df, "spot", B).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    s2 = report.summary(features.log_return(df, "spot"), "ret", "ticker").toPandas().sort_values("ticker").reset_index(drop=True)
    for c in ["ret", "spot_rank", "dist_max", "dist_min", "hurst", "rsi", "step"]:
        assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-9, equal_nan=True), c
    for c in ["sharpe", "final_index", "max_drawdown", "n"]:
        assert np.allclose(s[c].astype(float), s2[c].astype(float), atol=1e-9, equal_nan=True), c


def test_ledger_vs_loop(spark):
    rng = np.random.default_rng(3)
    days = [D0 + dt.timedelta(days=i) for i in range(30)]
    pr = {t: 10 + np.cumsum(rng.normal(0, 0.5, 30)).clip(-5) for t in ("A", "B")}
    prices = spark.createDataFrame([(t, d, float(pr[t][i])) for t in pr for i, d in enumerate(days)],
                                   "ticker string, date date, price double")
    q = {(t, i): float(rng.integers(-3, 4)) for t in pr for i in range(30) if rng.random() < 0.4}
    orders = spark.createDataFrame([("r", t, days[i], v) for (t, i), v in q.items()], "run_id string, ticker string, date date, qty double")
    g = portfolio.positions(portfolio.grid(orders, prices))
    val = portfolio.valuation(g, portfolio.cash(g, 1000.0)).orderBy("date").collect()
    cash, pos, g1 = 1000.0, {"A": 0.0, "B": 0.0}, 1 + 0.01 / 252
    for i, row in enumerate(val):
        cash *= g1
        for t in pos:
            qty = q.get((t, i), 0.0)
            px = pr[t][i - 1] if i > 0 else pr[t][0]
            cash -= qty * px + abs(qty) * px * 0.0025
            pos[t] += qty
        mv = cash + sum(pos[t] * pr[t][i] for t in pos)
        assert row["balance"] == pytest.approx(cash, rel=1e-10)
        assert row["market_value"] == pytest.approx(mv, rel=1e-10)


def test_shuffled_input_same_result(spark):
    df = panel(spark)
    a = features.hurst(df, "spot").toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    b = features.hurst(df.repartition(7).orderBy(F.rand(5)), "spot").toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    assert np.allclose(a["hurst"].astype(float), b["hurst"].astype(float), equal_nan=True)


def test_walk_forward_linear_against_numpy(spark):
    """Merged Gram statistics give each fold's own least squares, with missing values, an empty chunk and levels far from 0."""
    import numpy as np

    from tsfolds.operators import folds

    rng = np.random.default_rng(4)
    n = 400
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [1e6, -3e5, 7]
    y = x @ [2.0, -0.3, 40.0] + rng.normal(size=n)
    chunk = np.repeat([0, 1, 2, 4, 5], n // 5)
    rows = [(i, int(k), *(None if rng.random() < 0.05 else float(v) for v in r), None if rng.random() < 0.05 else float(t)) for i, (k, r, t) in enumerate(zip(chunk, x, y))]
    rows += [(1000, 3, None, 1.0, 2.0, 3.0), (1001, None, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "id long, chunk int, a double, b double, c double, y double")
    got = {r.id: (r.fold, r.prediction) for r in folds.walk_forward_linear(df, ["a", "b", "c"], "y").collect()}
    assert set(got) == {r[0] for r in rows if r[1] is not None and r[1] >= 1}
    whole = [r for r in rows if r[1] is not None and None not in r]
    for i, k, *f, _ in rows:
        if i not in got:
            continue
        fit = np.array([r[2:] for r in whole if r[1] < k])
        mean = fit.mean(axis=0)
        beta = np.linalg.lstsq(fit[:, :3] - mean[:3], fit[:, 3] - mean[3], rcond=None)[0]
        fold, value = got[i]
        assert fold == k - 1
        if None in f:
            assert value is None
        else:
            assert abs(value - (mean[3] + (np.array(f) - mean[:3]) @ beta)) < 1e-6 * abs(value)
    assert folds.walk_forward_linear(df.limit(0), ["a"], "y").collect() == []


def test_causal_strength_in_batches_of_odd_values(spark):
    x = [5.0, 3.0, None, 4.0, 4.0, 9.0, float("nan"), 2.0, 8.0, 1.0, 7.0, 6.0]
    f = [1.0, 1.0, 2.0, 3.0, None, 4.0, 4.0, 4.0, 4.0, 5.0, 9.0, 8.0]
    rows = [("T", D0 + dt.timedelta(days=i), a, b, 1.0, float("nan")) for i, (a, b) in enumerate(zip(x, f, strict=True))]
    df = spark.createDataFrame(rows, "ticker string, date date, spot double, f double, one double, nothing double")
    out = features.causal_strength(df, "spot", ["f", "one", "nothing"], 2)
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString() and out.columns[:6] == df.columns
    got = by_ticker(out, "causal_f")["T"]
    for i in range(len(x)):
        w, v = x[max(0, i - 2) : i + 1], f[max(0, i - 2) : i + 1]
        if None in w or None in v or len(set(v)) == 1:
            assert got[i] == 0.0
        elif any(a != a for a in w):
            assert got[i] != got[i]
        else:
            assert got[i] == pytest.approx(np.corrcoef(lfilter(w), v)[0, 1], abs=1e-9)
    assert set(by_ticker(out, "causal_one")["T"]) == {0.0} and set(by_ticker(out, "causal_nothing")["T"]) == {0.0}
