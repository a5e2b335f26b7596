"""Sources, sinks, stores and streaming (UNIT checks)."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from tsfolds.operators import folds, jobs
from tsfolds.plans import fixtures as fx
from tsfolds.sources import io, store
from tsfolds.streaming import progress as stream


def test_panel_csv_roundtrip(spark, tmpdir_):
    bars = fx.view(spark, SF01, "bars")
    txt = bars.select(F.date_format("date", "M/d/yyyy").alias("date"), "ticker", "open", "close")
    path = os.path.join(tmpdir_, "bars_csv")
    io.write_csv(txt, path)
    back = io.read_panel_csv(spark, path, date_fmt="M/d/yyyy")
    assert back.count() == bars.count()
    assert dict(back.dtypes)["date"] == "date"
    j = back.join(bars, ["ticker", "date"])
    assert j.where(F.abs(back["close"] - bars["close"]) > 1e-9).count() == 0


def test_blank_index_column_dropped(spark, tmpdir_):
    p = os.path.join(tmpdir_, "up.csv")
    with open(p, "w") as fh:
        fh.write(",date,ticker,close\n0,1/2/2020,A,1.5\n1,1/3/2020,A,1.7\n")
    df = io.read_panel_csv(spark, p, date_fmt="M/d/yyyy")
    assert "_c0" not in df.columns and df.count() == 2


def test_bad_dates(spark):
    df = spark.createDataFrame([("13/45/2020",), ("1/2/2020",)], "date string")
    from tsfolds.operators import clean

    assert clean.parse_dates(df, errors="null").where(F.col("date").isNull()).count() == 1
    with pytest.raises(Exception):
        clean.parse_dates(df).collect()


def test_chunk_store_upsert_and_read(spark, tmpdir_):
    path = os.path.join(tmpdir_, "store")
    c = folds.by_size(fx.view(spark, SF01, "bars"), 7)
    store.write_chunks(c.withColumn("jobname", F.lit("j1")), path)
    n0 = store.read_chunk(spark, path, "j1", 0).count()
    # upsert: rewrite only chunk 0 with fewer rows; other chunks stay
    store.write_chunks(c.where((F.col("chunk") == 0) & (F.col("ticker") == "click")).withColumn("jobname", F.lit("j1")), path)
    assert store.read_chunk(spark, path, "j1", 0).count() < n0
    assert store.read_chunk(spark, path, "j1", 1).count() == c.where(F.col("chunk") == 1).count()
    assert store.chunk_count(store.read_store(spark, path)).first()["n_chunks"] == 5
    with pytest.raises(KeyError):
        store.read_chunk(spark, path, "j1", 99)


def test_table_sink_and_scan(spark, tmpdir_):
    p = os.path.join(tmpdir_, "t")
    io.write_table(fx.view(spark, SF01, "fund"), p)
    back = io.read_table(spark, p)
    assert back.count() == fx.view(spark, SF01, "fund").count()
    plan = back.where(F.col("ticker") == "BUILDING").select("revenue")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "ReadSchema: struct<ticker:string,revenue:double>" in plan


def test_monitor_logs(spark, tmpdir_):
    for k in range(2):
        d = os.path.join(tmpdir_, "logs", f"run{k}")
        os.makedirs(d)
        with open(os.path.join(d, "0.monitor.csv"), "w") as fh:
            fh.write('#{"t_start": %d.5, "env_id": null}\nr,l,t\n1.0,10,0.5\n2.0,12,1.5\n' % (1000 + k))
    df = io.read_monitor_logs(spark, os.path.join(tmpdir_, "logs"))
    assert df.count() == 4
    assert sorted({r["t_start"] for r in df.collect()}) == [1000.5, 1001.5]


def test_series_files(spark, tmpdir_):
    d = os.path.join(tmpdir_, "series")
    os.makedirs(d)
    for sid in ("GDP", "CPI"):
        with open(os.path.join(d, f"{sid}.csv"), "w") as fh:
            fh.write("date,value\n2020-01-01,1.5\n2020-02-01,\n")
    df = io.read_series(spark, d)
    assert sorted(r["series_id"] for r in df.select("series_id").distinct().collect()) == ["CPI", "GDP"]
    assert df.where(F.col("value").isNull()).count() == 2


def _write_log_parts(spark, path, parts=4):
    log = fx.view(spark, SF01, "job_log")
    # land the log in time order, several files, as a live writer would
    bounds = log.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    span = (bounds["b"] - bounds["a"]) / parts
    for i in range(parts):
        lo, hi = bounds["a"] + span * i, bounds["a"] + span * (i + 1)
        cond = (F.col("ts") >= F.lit(lo)) & ((F.col("ts") < F.lit(hi)) if i < parts - 1 else F.lit(True))
        log.where(cond).coalesce(1).write.mode("append").parquet(path)
    return log


def test_stream_progress_equals_batch(spark, tmpdir_):
    src = os.path.join(tmpdir_, "log")
    log = _write_log_parts(spark, src)
    out = os.path.join(tmpdir_, "progress")
    q = stream.progress(spark, src, out, 1000, checkpoint=os.path.join(tmpdir_, "ck1"))
    q.awaitTermination(120)
    got = {r["parent"]: r["pct_complete"] for r in stream.read_progress(spark, out).collect()}
    st = jobs.current_state(log).withColumn("parent", F.split("name", r"\.")[0])
    exp = {r["parent"]: r["pct_complete"] for r in jobs.progress(st, 1000).collect()}
    assert got.keys() == exp.keys()
    for k in exp:
        assert got[k] == pytest.approx(exp[k])


def test_two_streams_without_a_checkpoint_name_and_a_restart(spark, tmpdir_):
    src, outs = os.path.join(tmpdir_, "log"), [os.path.join(tmpdir_, f"progress{i}") for i in range(2)]
    _write_log_parts(spark, src, 2)
    for out in outs:
        stream.progress(spark, src, out, 1000).awaitTermination(120)
    first = [sorted(map(tuple, stream.read_progress(spark, out).collect())) for out in outs]
    assert first[0] == first[1]
    before = sorted(os.listdir(outs[0]))
    stream.progress(spark, src, outs[0], 1000).awaitTermination(120)  # a restart finds nothing new
    assert sorted(os.listdir(outs[0])) == before


def test_stream_eta_equals_batch(spark, tmpdir_):
    src = os.path.join(tmpdir_, "log")
    log = _write_log_parts(spark, src)
    out = os.path.join(tmpdir_, "eta")
    q = stream.eta(spark, src, out, checkpoint=os.path.join(tmpdir_, "ck2"), max_files=1)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    exp = jobs.eta(log)
    assert got.count() == exp.count()
    diff = got.alias("a").join(exp.alias("b"), ["name", "ts"]).where(
        ~F.col("a.eta_secs").eqNullSafe(F.col("b.eta_secs"))
        & ~(F.abs(F.col("a.eta_secs") - F.col("b.eta_secs")) < 1e-6)
    )
    assert diff.count() == 0


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0 and "sharpe" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_stream_eta_transform_with_state(spark, tmpdir_):
    key = "spark.sql.streaming.stateStore.providerClass"
    prev = spark.conf.get(key, None)
    spark.conf.set(key, stream.ROCKSDB)
    try:
        src = os.path.join(tmpdir_, "log")
        log = _write_log_parts(spark, src)
        out = os.path.join(tmpdir_, "eta_tws")
        q = stream.eta(spark, src, out, checkpoint=os.path.join(tmpdir_, "ck3"), max_files=1, engine="transformWithStateInPandas")
        q.awaitTermination(300)
        got = spark.read.parquet(out)
        exp = jobs.eta(log)
        assert got.count() == exp.count()
        diff = got.alias("a").join(exp.alias("b"), ["name", "ts"]).where(
            ~F.col("a.eta_secs").eqNullSafe(F.col("b.eta_secs")) & ~(F.abs(F.col("a.eta_secs") - F.col("b.eta_secs")) < 1e-6)
        )
        assert diff.count() == 0
    finally:
        if prev is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, prev)


def test_stream_progress_follows_changes_and_keeps_few_folders(spark, tmpdir_):
    src, out, ck = (os.path.join(tmpdir_, n) for n in ("log", "progress", "ck"))
    rows = [("a.train.0", None, 1, 0.5), ("a.validate.0", None, 1, 0.25), ("a.train.1", None, 1, 0.1), ("b.train.0", "a", 1, 1.0), ("c.other.3", None, 1, 0.3)]
    later = [[("a.train.0", None, 2, 0.75)], [("b.train.0", "b", 2, 0.5)], [("a.train.1", None, 1, 0.05)], [("a.train.1", None, 3, None)],
             [("a.train.1", None, 4, 0.4)], [("b.train.0", "b", 3, 0.5)], [("a.train.1", None, 4, 0.45)]]

    def land(part):
        log = spark.createDataFrame(part, "name string, parent string, sec long, pct_complete double")
        ts = F.timestamp_add("SECOND", F.col("sec"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        log.select("name", "parent", ts.alias("ts"), "pct_complete").coalesce(1).write.mode("append").parquet(src)

    def run():
        stream.progress(spark, src, out, 10, checkpoint=ck, every=3).awaitTermination(120)

    def expected():
        log = spark.read.schema(stream.LOG_SCHEMA).parquet(src)
        last = log.groupBy("name").agg(F.max(F.struct("ts", "pct_complete", "parent")).alias("_l"))
        st = last.select("name", "_l.pct_complete", F.coalesce("_l.parent", F.split("name", r"\.")[0]).alias("parent"))
        return {r["parent"]: (r["folds"], r["pct_complete"]) for r in jobs.progress(st, 10).collect()}

    land(rows)
    run()
    for part in later:
        land(part)
        run()
        got = {r["parent"]: (r["folds"], r["pct_complete"]) for r in stream.read_progress(spark, out).collect()}
        exp = expected()
        assert got.keys() == exp.keys()
        for k in exp:
            assert got[k][0] == exp[k][0] and got[k][1] == pytest.approx(exp[k][1])
    kept = sorted(n for n in os.listdir(out) if "=" in n)
    assert "base=5" in kept and "batch=0" not in kept and len(kept) <= 8
    # the delta of a batch holds the parents of its changed jobs only
    delta = spark.read.parquet(os.path.join(out, "batch=7"))
    assert [r["parent"] for r in delta.collect()] == ["a"]


def test_a_repeated_batch_replaces_its_own_delta(spark, tmpdir_):
    from tsfolds.sources import deltas

    merge = lambda d: d.groupBy("k").agg(F.sum("v").alias("v"))
    delta = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v long")
    for n in (0, 1, 1, 2, 2, 3, 3):  # every batch but the first is repeated, some of them after their merge
        deltas.write(delta, tmpdir_, n, merge, every=3)
    assert sorted(map(tuple, deltas.read(spark, tmpdir_, merge, delta.schema).collect())) == [("x", 4), ("y", 8)]
    os.remove(os.path.join(tmpdir_, "batch=3", "_SUCCESS"))  # a batch that is half written is not seen
    assert sorted(map(tuple, deltas.read(spark, tmpdir_, merge, delta.schema).collect())) == [("x", 3), ("y", 6)]
    with pytest.raises(FileNotFoundError):
        deltas.read(spark, os.path.join(tmpdir_, "none"), merge, delta.schema)


def test_eta_in_event_time(spark, tmpdir_):
    key = "spark.sql.streaming.stateStore.providerClass"
    prev = spark.conf.get(key, None)
    spark.conf.set(key, stream.ROCKSDB)
    try:
        src, out, ck = (os.path.join(tmpdir_, n) for n in ("log", "eta", "ck"))

        def land(rows):
            log = spark.createDataFrame(rows, "name string, sec long, pct_complete double")
            ts = F.timestamp_add("SECOND", F.col("sec"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
            log.select("name", F.lit(None).cast("string").alias("parent"), ts.alias("ts"), "pct_complete").coalesce(1).write.mode("append").parquet(src)

        def run():
            stream.eta_ordered(spark, src, out, checkpoint=ck, delay="100 seconds", expire_secs=1000).awaitTermination(300)

        first = [("j", 50, 0.2), ("j", 10, 0.1), ("k", 30, 0.5), ("j", 30, 0.15)]  # out of order
        second = [("k", 60, 0.6), ("j", 40, 0.18), ("j", 400, 0.5), ("x", None, 0.1)]  # 40 comes before the watermark has passed it
        third = [("j", 45, 0.19), ("k", 700, 0.7)]  # 45 is late: the watermark stands at 300
        fourth = [("j", 2000, 0.9), ("k", 2100, 0.8)]  # after more than 1000 s: anew
        fifth = [("z", 9000, 0.1)]
        for part in (first, second, third, fourth, fifth):
            land(part)
            run()
        late = [(r["name"], r["pct_complete"]) for r in stream.read_eta(spark, out, late=True).collect()]
        assert sorted(late) == [("j", 0.19), ("x", 0.1)]
        log = spark.read.schema(stream.LOG_SCHEMA).parquet(src)
        in_time = log.where("ts is not null and pct_complete not in (0.19) and name <> 'z'")
        exp = {(r["name"], r["ts"]): r for r in jobs.eta(in_time).collect()}
        rows = stream.read_eta(spark, out).collect()
        assert len(rows) == len(exp) == 10
        for r in rows:
            e = exp[r["name"], r["ts"]]
            if r["ts"].minute >= 33:  # 2000 s and later, more than 1000 s after the one before
                assert r["delta"] is None or r["delta"] != r["delta"]
                assert r["eta_secs"] is None or r["eta_secs"] != r["eta_secs"]
            elif e["eta_secs"] is None:
                assert r["eta_secs"] is None or r["eta_secs"] != r["eta_secs"]
            else:
                assert r["eta_secs"] == pytest.approx(e["eta_secs"]) and r["delta"] == pytest.approx(e["delta"])
    finally:
        if prev is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, prev)
