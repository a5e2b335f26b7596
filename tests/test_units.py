"""UNIT checks for the operators that return driver-side values or
presentation output (B10, F4, I3, D5 approx, B13 determinism, H1 sink order)."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF01
from tsfolds.operators import folds, jobs, panel
from tsfolds.plans import fixtures as fx
from tsfolds.sources import store


def test_numeric_columns(spark):
    f = fx.view(spark, SF01, "fund")
    assert folds.numeric_columns(f) == ["capex", "equity", "revenue"]
    assert "closeadj" in folds.numeric_columns(f, preserve=())


def test_count_for_length(spark):
    g = fx.view(spark, SF01, "gappy")
    n = g.select("date").distinct().count()
    assert folds.count_for_length(g, 250) == n // 250


def test_symbol_count_approx(spark):
    s = fx.view(spark, SF01, "supp_bars")
    exact = panel.symbol_count(s).first()[0]
    approx = panel.symbol_count(s, approx=True).first()[0]
    assert abs(approx - exact) <= 0.05 * exact


def test_sample_windows_deterministic(spark):
    g = fx.view(spark, SF01, "gappy")
    a = sorted(map(tuple, panel.sample_windows(g, 10, 4, seed=3).select("episode", "date", "ticker").collect()))
    b = sorted(map(tuple, panel.sample_windows(g, 10, 4, seed=3).select("episode", "date", "ticker").collect()))
    assert a == b
    per = panel.sample_windows(g, 10, 4, seed=3).groupBy("episode").agg(F.count_distinct("date").alias("d")).collect()
    assert all(r["d"] == 10 for r in per)


def test_tree_documents(spark):
    j = fx.view(spark, SF01, "jobs")
    t = jobs.tree(j, max_depth=4).collect()
    assert len(t) == 1 and t[0]["name"] == "root"
    doc = json.loads(t[0]["tree"])
    regions = doc["children"]
    assert len(regions) == 5
    n_customers = sum(len(n.get("children", [])) for r in regions for n in r["children"])
    assert n_customers == fx.table(spark, SF01, "customer").count()
    leaf = regions[0]["children"][0]["children"][0]
    assert "children" not in leaf  # empty fields dropped


def test_sorted_chunk_files(spark, tmpdir_):
    path = os.path.join(tmpdir_, "s")
    c = folds.by_size(fx.view(spark, SF01, "bars"), 7).withColumn("jobname", F.lit("j"))
    store.write_chunks(c, path)
    parts = sorted(d for d in os.listdir(os.path.join(path, "jobname=j")) if d.startswith("chunk="))
    assert parts == [f"chunk={i}" for i in range(5)]


def test_index_and_drawdown_separately_equal_fused(spark):
    from tsfolds.operators import features, report

    r = features.log_return(fx.view(spark, SF01, "bars"), "close", "ticker")
    sep = report.drawdown(report.return_index(r, "ret", "ticker"), "ret_index", "ticker")
    fused = report.returns_drawdown(r, "ret", "ticker")
    j = sep.alias("a").join(fused.alias("b"), ["ticker", "date"])
    bad = j.where(
        ~(F.abs(F.col("a.ret_index") - F.col("b.ret_index")) < 1e-9) & ~(F.col("a.ret_index").isNull() & F.col("b.ret_index").isNull())
        | ~(F.abs(F.col("a.drawdown") - F.col("b.drawdown")) < 1e-9) & ~(F.col("a.drawdown").isNull() & F.col("b.drawdown").isNull())
    )
    assert j.count() == 150 and bad.count() == 0


def test_densify_equals_spine_and_fill(spark):
    from tsfolds.operators import align, clean

    g = fx.view(spark, SF01, "gappy").select("ticker", "date", "close")
    a = panel.densify(g, ["close"])
    b = clean.ffill(align.daily_spine(g, "date", ["ticker"]), ["close"], "ticker", "date")
    assert a.count() == b.count() == a.select("ticker", "date").distinct().count()
    assert a.exceptAll(b.select(*a.columns)).count() == 0
