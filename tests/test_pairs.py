"""Rolling correlations by tiles against the pair table's windows and a loop, for any tile size and block width."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001
from tsfolds.operators import features, pairs
from tsfolds.plans.queries import v

D0 = dt.date(2020, 1, 1)
SCHEMA = "ticker string, date date, close double"


def brute(rows, B):
    """{(date, a, b): (correlation or None, dates in the window)} by a loop over every pair."""
    series = {}
    for s, t, x in rows:
        if s is not None and t is not None and x is not None and x == x:
            old = series.setdefault(s, {})
            old[t] = max(x, old.get(t, x))
    out = {}
    for a in series:
        for b in series:
            if a < b:
                common = sorted(series[a].keys() & series[b].keys())
                for k, t in enumerate(common):
                    w = common[max(0, k - B) : k + 1]
                    x, y = (np.array([series[s][u] for u in w]) for s in (a, b))
                    flat = (x == x[0]).all() or (y == y[0]).all()
                    out[t, a, b] = (None if flat else float(np.corrcoef(x, y)[0, 1]), len(w))
    return out


def sparse_panel():
    rnd = random.Random(3)
    rows = []
    for s in range(23):
        level = 10.0 ** rnd.randrange(-3, 6)
        for d in range(120):
            if rnd.random() < (0.9 if s % 3 else 0.15):
                x = level * (5 + rnd.choice([0, 0, 0, 1])) if s % 5 == 0 else level * (1 + d / 50 + rnd.random())
                rows.append((f"T{s}", D0 + dt.timedelta(days=d), x))
    rows += [("T1", rows[0][1], 99.0), rows[5], (None, D0, 1.0), ("T2", None, 1.0), ("T3", D0, None), ("T4", D0, float("nan"))]
    return rows


def test_every_pair_for_any_tiles_and_blocks(spark):
    rows = sparse_panel()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as a", "2 as own", "3 as blk")
    for B, tile, block in ((3, 64, None), (10, 4, 7), (5, 9, 30), (0, 5, 50)):
        want = brute(rows, B)
        got = {(r.date, r.a, r.b): r["corr"] for r in pairs.rolling_tiles(df, "close", B, tile=tile, block=block).collect()}
        assert got.keys() == want.keys()
        for k, (c, _) in want.items():
            assert (got[k] is None) == (c is None) and (c is None or abs(got[k] - c) < 1e-7), (B, tile, k, got[k], c)


def test_top_pairs(spark):
    rows, B = sparse_panel(), 4
    df = spark.createDataFrame(rows, SCHEMA)
    by_date = {}
    for (t, a, b), (c, n) in brute(rows, B).items():
        if c is not None and n == B + 1:
            by_date.setdefault(t, []).append((-round(abs(c), 6), a, b))
    for tile, block in ((64, None), (3, 20)):
        got = {}
        for r in pairs.rolling_tiles(df, "close", B, top=3, full=True, tile=tile, block=block).orderBy("date", "rank").collect():
            got.setdefault(r.date, []).append((-round(abs(r["corr"]), 6), r.a, r.b))
        assert got == {t: sorted(c)[:3] for t, c in by_date.items()}


def test_drift_and_long_windows_keep_their_digits(spark):
    days = np.arange(3000)
    rng = np.random.default_rng(1)
    x, y = 1e6 + days * 10.0 + rng.normal(size=3000), 50 + rng.normal(size=3000) * 1e-3
    rows = [(s, int(d), float(z)) for s, col in (("A", x), ("B", y)) for d, z in zip(days, col, strict=True)]
    df = spark.createDataFrame(rows, "ticker string, date long, close double")
    for B in (10, 250):
        got = {r.date: r["corr"] for r in pairs.rolling_tiles(df, "close", B, block=700, full=True).collect()}
        assert len(got) == 3000 - B
        for d in range(B, 3000, 97):
            assert abs(got[d] - np.corrcoef(x[d - B : d + 1], y[d - B : d + 1])[0, 1]) < 1e-8


def test_equals_the_pair_table(spark):
    bars = v(spark, SF001, "bars")
    table = features.rolling_corr(bars, "close", 10, pairs=features.symbol_pairs(bars)).where("a < b")
    want = {(r.date, r.a, r.b): r["corr"] for r in table.collect()}
    got = {(r.date, r.a, r.b): r["corr"] for r in pairs.rolling_tiles(bars, "close", 10, tile=2).collect()}
    assert got.keys() == want.keys()
    assert all((c is None) == (got[k] is None) and (c is None or abs(c - got[k]) < 1e-9) for k, c in want.items())


def test_empty_and_no_pairs(spark):
    df = spark.createDataFrame([("A", D0, 1.0), ("A", D0 + dt.timedelta(days=1), 2.0)], SCHEMA)
    for t in (df.limit(0), df):
        assert pairs.rolling_tiles(t, "close").collect() == [] and pairs.rolling_tiles(t, "close", top=2).collect() == []


def test_no_step_orders_all_symbols_and_no_row_is_a_pair(spark):
    n = 1000
    rng = spark.range(n * 40)
    df = rng.select(F.concat(F.lit("S"), (F.col("id") % n).cast("string")).alias("ticker"), F.date_add(F.lit(D0), (F.col("id") / n).cast("int")).alias("date"), F.rand(5).alias("close"))
    out = pairs.rolling_tiles(df, "close", 10, top=2, full=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "WindowGroupLimit" in plan
    assert out.count() == 30 * 2
    table = features.symbol_pairs(df)
    assert "SinglePartition" not in table._jdf.queryExecution().executedPlan().toString()
    assert table.count() == n * (n + 1) // 2


def test_rows_are_dealt_once_however_many_tiles(spark):
    df = spark.createDataFrame(sparse_panel(), SCHEMA)
    for tile in (1, 64):
        plan = pairs.rolling_tiles(df, "close", 4, top=2, tile=tile)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan


def test_best_rows_of_a_task_do_not_pile_up():
    import pyarrow as pa

    best = pairs._Best(2)
    for k in range(8):
        n = 1 << 16
        t = np.arange(n, dtype=np.int32) % 5
        best.add(pa.RecordBatch.from_arrays([pa.array(t).cast(pa.date32()), pa.array(["A"] * n), pa.array([f"B{k}{i:05d}" for i in range(n)]), pa.array(np.full(n, 0.5 if k != 6 else -0.6))], ["t", "a", "b", "corr"]))
        assert best.rows <= (1 << 18) + n
    got = pa.Table.from_batches(list(best.batches())).to_pydict()
    assert got["b"] == [f"B6{t + 5 * i:05d}" for t in range(5) for i in range(2)] and set(got["corr"]) == {-0.6}
