import corpus_pipeline as P
from conftest import SF001
from test_minhash import brute as near
from test_packing import check
from test_repeats import brute as repeats


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert [k for k, _ in P.STAGES] == ["quality", "near_duplicates", "repeats", "pii", "packing"]
    kept = {}
    for i, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF001).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if name == "packing":
            n = check(after.collect(), {k: r.text for k, r in before.items()}, 1024)
            assert 0 < n <= len(before)
            break
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        kept = {r.doc_id: r for r in after.collect()}
        rows = [(k, r.text) for k, r in before.items()]
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{SF001}/labels.parquet").where("quality = 0").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{SF001}/labels.parquet").where("quality = 1").collect()}
            assert len(good & kept.keys()) >= 0.95 * len(good) and len(bad & kept.keys()) <= 0.1 * len(bad)
        if name == "near_duplicates":
            assert kept.keys() == {k for k, x in near(rows, 5).items() if x[2]} and len(kept) < len(before)
        if name == "repeats":
            for k, (_, gone, text) in repeats(rows, 35).items():
                assert kept[k].text == (text if gone else before[k].text)
        if name == "pii":
            assert kept.keys() == before.keys() and not any("@" in r.text and "example.com" in r.text for r in kept.values())
        assert all(r.n_chars == len(r.text) for r in kept.values())
        docs = after


def test_run(spark):
    assert P.run(spark, SF001).count() > 0


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, copies without doc_id and versions of one id: one row a group, whose text the next stage leaves."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    near = text("a") + " more"
    rows = [(5, text("a")), (7, near), (7, text("b")), (9, text("b")), (9, text("b")), (None, text("b")), (12, text("c")), (12, text("c"))]
    rows += [(None, text("d")), (None, text("d")), (None, text("d") + " more"), (None, text("e")), (3, ""), (4, None), (4, None), (None, text("f")), (20, text("f"))]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    one = P.one_of_near_duplicates(spark, docs, SF001)
    assert one.dtypes == docs.dtypes
    got = sorted((str(r.doc_id), (r.text or "")[:1], r.n_chars) for r in one.collect())
    assert [x[:2] for x in got] == [("12", "c"), ("20", "f"), ("3", ""), ("4", ""), ("5", "a"), ("7", "b"), ("None", "d"), ("None", "e")]
    kept = P.without_repeats(spark, one, SF001).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:1], r.n_chars) for r in kept) == got
