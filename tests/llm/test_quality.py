import zlib

import numpy as np
import pyarrow as pa

from conftest import SF01
from tsfolds.llm import crf, quality
from tsfolds.llm import queries as Q


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in Q.op6_quality_crf(spark, SF01).collect()}
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    rows = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()]
    rows = [(x, q) for x, q in rows if x.held_out]
    assert np.mean([x.predicted == q for x, q in rows]) >= 0.95
    good, bad = [x.score for x, q in rows if q == 1], [x.score for x, q in rows if q == 0]
    assert np.mean([a > b for a in good for b in bad]) >= 0.97


def test_odd_rows(spark):
    fitted = quality.train([("A plain sentence of words.\nAnd one more of them.", 1), ("A&&& b%%% c###\nd*** e$$$ f###", 0)] * 20)
    rows = [(None, None), (1, ""), (1, ""), (2, "\n\n"), (3, "word " * 30000), (4, "A plain sentence."), (5, "x### y&&& z***")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as score", "1 as emit")
    got = quality.classify(df, fitted).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.emit == 1 for r in got)
    by = {r.text: r.score for r in got}
    assert by["A plain sentence."] > by["x### y&&& z***"]
    assert [r.score for r in quality.classify(df, None).collect()] == [0.5] * len(rows)
    assert quality.classify(df.limit(0), fitted).collect() == []


def test_fit_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 7)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None


def test_forward_backward_and_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    first = np.array([0, 3, 3, 4, 8])
    emit, trans = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    p, norm, pairs = crf.forward_backward(emit, first, trans)
    path = crf.viterbi(emit, first, trans)
    want_p, want_norm, want_pairs = np.zeros_like(emit), 0.0, np.zeros_like(trans)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        paths = list(itertools.product(range(3), repeat=b - a))
        score = np.array([sum(emit[a + i, s] for i, s in enumerate(x)) + sum(trans[s, t] for s, t in zip(x, x[1:])) for x in paths])
        z = np.logaddexp.reduce(score)
        want_norm += z
        for x, w in zip(paths, np.exp(score - z)):
            for i, s in enumerate(x):
                want_p[a + i, s] += w
            for s, t in zip(x, x[1:]):
                want_pairs[s, t] += w
        assert tuple(path[a:b]) == paths[int(score.argmax())]
    assert np.allclose(p, want_p) and np.isclose(norm, want_norm) and np.allclose(pairs, want_pairs)


def test_line_table_of_odd_texts():
    x, length, first = quality._line_table(pa.array([None, "", "a\n\nb", "\n"]))
    assert list(np.diff(first)) == [1, 1, 3, 2] and list(length) == [0, 0, 1, 0, 1, 0, 0]
    assert x.shape[0] == 7 and np.isfinite(x).all()
