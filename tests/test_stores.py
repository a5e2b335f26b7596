"""Versioned results, incremental landing, shared nodes of a feature graph."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tsfolds.operators import folds
from tsfolds.plans.pipeline import FeatureGraph, GraphError
from tsfolds.sources import files, landing, store, versions


def test_versions_append_and_read(spark, tmpdir_):
    name = "render/a b"  # a name is any text
    with pytest.raises(KeyError):
        versions.read(spark, tmpdir_, name)
    assert versions.commits(spark, tmpdir_).count() == 0
    for i in range(3):
        assert versions.append(spark.range(i + 1), tmpdir_, name) == i
    assert versions.append(spark.range(9), tmpdir_, "other") == 0
    last = versions.read(spark, tmpdir_, name)
    assert last.count() == 3 and last.first()["version"] == 2
    assert versions.read(spark, tmpdir_, name, 0).count() == 1
    top = store.latest_version(versions.commits(spark, tmpdir_), ["name"], "version")
    assert sorted((r["name"], r["version"]) for r in top.collect()) == [("other", 0), (name, 2)]


def test_two_writers_and_one_that_dies(spark, tmpdir_, monkeypatch):
    got, both = [], threading.Barrier(2)
    seen = versions.versions

    def same_view(*args):
        found = seen(*args)
        both.wait(60)  # both have listed the versions before either commits
        return found

    monkeypatch.setattr(versions, "versions", same_view)
    writers = [threading.Thread(target=lambda n=n: got.append((versions.append(spark.range(n), tmpdir_, "r"), n))) for n in (5, 7)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    monkeypatch.undo()
    assert sorted(v for v, _ in got) == [0, 1]
    for v, n in got:
        assert versions.read(spark, tmpdir_, "r", v).count() == n

    def dies(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(files, "create_new", dies)
    with pytest.raises(RuntimeError):
        versions.append(spark.range(100), tmpdir_, "r")
    monkeypatch.undo()
    assert versions.read(spark, tmpdir_, "r").count() == dict(got)[1]
    assert versions.append(spark.range(3), tmpdir_, "r") == 2
    folders = lambda: len(os.listdir(os.path.join(tmpdir_, "data", "r")))
    assert folders() == 4
    assert versions.expire(spark, tmpdir_, "r", keep=2, grace_secs=3600) == [0]
    assert folders() == 3  # what was never committed is still within its grace
    assert versions.expire(spark, tmpdir_, "r", keep=2, grace_secs=-1) == []
    assert folders() == 2 and versions.read(spark, tmpdir_, "r").count() == 3
    assert not [n for n in os.listdir(os.path.join(tmpdir_, "_commits", "r")) if n.endswith(".tmp")]


def _series(path, vintage, sid, body):
    folder = os.path.join(path, f"vintage={vintage}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{sid}.csv"), "w") as fh:
        fh.write("date,value\n" + body)


def test_series_land_once_and_keep_vintages(spark, tmpdir_):
    src, table, ck = (os.path.join(tmpdir_, n) for n in ("src", "table", "ck"))
    _series(src, "2024-01-31", "GDP", "2023-10-01,1.0\n2024-01-01,2.0\n")
    _series(src, "2024-01-31", "CPI", "2024-01-01,.\nnever,5\n")
    land = lambda: landing.land_series(spark, src, table, checkpoint=ck).awaitTermination(120)
    land()
    assert landing.vintages(spark, table).count() == 4
    before = sorted(os.listdir(table))
    land()  # nothing is new
    assert sorted(os.listdir(table)) == before
    _series(src, "2024-02-29", "GDP", "2024-01-01,2.5\n")
    land()
    rows = landing.vintages(spark, table)
    assert rows.count() == 5
    new = {r["file"].split("/")[-2] for r in landing.ledger(rows).where("batch = 1").collect()}
    assert new == {"vintage=2024-02-29"}  # the second run read the new file only
    value = lambda when: {(r["series_id"], str(r["date"])): r["value"] for r in landing.as_of(rows, when).collect()}
    assert value("2024-02-01")["GDP", "2024-01-01"] == 2.0 and value(None)["GDP", "2024-01-01"] == 2.5
    assert value(None)["CPI", "2024-01-01"] is None and value(None)["GDP", "2023-10-01"] == 1.0
    assert value("2020-01-01") == {}


def test_a_corrected_file_of_one_vintage_replaces_its_rows(spark, tmpdir_):
    src, table, ck = (os.path.join(tmpdir_, n) for n in ("src", "table", "ck"))
    for i, value in enumerate((1.0, 4.0, 2.0, 3.0)):
        _series(src, "2024-01-31", f"GDP.{i}", f"2024-01-01,{value}\n")
        landing.land_series(spark, src, table, checkpoint=ck, every=2).awaitTermination(120)
    assert [tuple(r) for r in landing.vintages(spark, table).select("series_id", "value", "batch").collect()] == [("GDP", 3.0, 3)]
    assert any(n.startswith("base=") for n in os.listdir(table))


def test_monitor_logs_land_once(spark, tmpdir_):
    src, table, ck = (os.path.join(tmpdir_, n) for n in ("logs", "table", "ck"))
    for run in range(2):
        folder = os.path.join(src, f"run{run}")
        os.makedirs(folder)
        with open(os.path.join(folder, "0.monitor.csv"), "w") as fh:
            fh.write('#{"t_start": 1000.5}\nr,l,t\n1.0,10,0.5\n2.0,12,1.5\n')
        landing.land_monitor_logs(spark, src, table, checkpoint=ck).awaitTermination(120)
    rows = landing.monitor_rows(spark, table)
    assert rows.count() == 4 and sorted(r["batch"] for r in landing.ledger(rows).collect()) == [0, 1]


def test_chosen_folds(spark):
    df = spark.createDataFrame([(c, float(c * 10 + i)) for c in range(6) for i in range(5)] + [(None, 1.0)], "chunk int, x double")
    key = ["chunk", "x", "fold", "role"]
    rows = lambda d: sorted(map(tuple, d.select(*key).collect()))
    every = folds.train_test(df)
    assert rows(folds.train_test(df, folds=[3, 1])) == rows(every.where("fold in (1, 3)"))
    whole, some = folds.standardize_train_test(df, ["x"]), folds.standardize_train_test(df, ["x"], folds=[4])
    a, b = rows(whole.where("fold = 4")), rows(some)
    assert len(a) == len(b) and all(p[0] == q[0] and abs(p[1] - q[1]) < 1e-9 for p, q in zip(a, b))
    for bad in ([], [-1]):
        with pytest.raises(ValueError):
            folds.train_test(df, folds=bad)


def test_shared_nodes_are_built_once(spark, tmpdir_):
    path = os.path.join(tmpdir_, "source")
    spark.range(20).write.parquet(path)
    calls = []
    g = FeatureGraph()
    g.add("source", lambda: calls.append("source") or spark.read.parquet(path))
    g.add("even", lambda d: d.where("id % 2 = 0"), ["source"])
    g.add("odd", lambda d: d.where("id % 2 = 1"), ["source"])
    g.add("all", lambda a, b: a.unionByName(b), ["even", "odd"])
    g.add("unused", lambda d: d, ["source"])
    assert g.consumers(["all"]) == {"source": 2, "even": 1, "odd": 1, "all": 1}
    out = g.build_all(["all"])
    assert list(out) == ["all"] and out["all"].count() == 20 and calls == ["source"]
    assert not any(path in f for f in out["all"].inputFiles())  # the source was read for the written node only
    every = g.build_all()
    assert set(every) == {"source", "even", "odd", "all", "unused"}
    assert not any(path in f for df in every.values() for f in df.inputFiles())
    long = FeatureGraph().add("n0", lambda: spark.read.parquet(path))
    for i in range(1, 9):
        long.add(f"n{i}", lambda d, i=i: d.withColumn(f"c{i}", F.col("id") + i), [f"n{i - 1}"])
    assert any(path in f for f in long.build_all(["n8"])["n8"].inputFiles())
    cut = long.build_all(["n8"], depth=4)["n8"]
    assert not any(path in f for f in cut.inputFiles()) and cut.count() == 20 and len(cut.columns) == 9
    with pytest.raises(GraphError):
        g.build_all(["none"])
