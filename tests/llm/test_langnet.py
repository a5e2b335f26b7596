import zlib

import numpy as np
import pyarrow as pa

from conftest import SF01
from tsfolds.llm import langnet
from tsfolds.llm import queries as Q
from tsfolds.llm import text as tx


def test_held_out_accuracy(spark):
    rows = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    got = {r.doc_id: r for r in Q.op12_language_cnn(spark, SF01).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    known = [(got[r.doc_id].lang_pred, r.lang) for r in rows if got[r.doc_id].held_out and r.lang is not None]
    assert len(known) > 200 and np.mean([a == b for a, b in known]) >= 0.97
    for lang in {b for _, b in known}:
        assert np.mean([a == b for a, b in known if b == lang]) >= 0.9
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in t)) for r, t in ((got[x.doc_id], x.text or "") for x in rows))


def toy(rounds=30):
    rng = np.random.default_rng(0)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(3, 8)))
    texts = [" ".join(word("abcdeé") for _ in range(40)).encode()[:256] for _ in range(60)]
    texts += [" ".join(word("mnopqü") for _ in range(40)).encode()[:256] for _ in range(20)]
    return langnet.train(texts, ["xx"] * 60 + ["yy"] * 20, rounds=rounds)


def test_lookup_tables_equal_the_network():
    net = toy(2)
    x = np.random.default_rng(1).integers(0, 256, (9, langnet.WINDOW)).astype(np.uint8)
    pooled = np.concatenate([langnet._respond(x, t).max(axis=1) for t in net.filters], axis=1)
    score = (np.maximum(pooled + net.shift, 0) @ net.weights + net.bias).astype(float)
    want = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
    assert np.allclose(np.exp(langnet._Lookup(net).logs(x)), want, atol=1e-5)


def test_gradient_of_the_training_step():
    """One step on one window goes the way that lowers its loss."""
    texts, labels = [b"abc abd", b"mno mnp"], ["xx", "yy"]
    at = lambda rounds: langnet.train(texts, labels, rounds=rounds, seed=3)
    x = np.zeros((2, langnet.WINDOW), np.uint8)
    for i, t in enumerate(texts):
        x[i, : len(t)] = np.frombuffer(t, np.uint8)
    loss = [-langnet._Lookup(at(r)).logs(x)[[0, 1], [0, 1]].mean() for r in (1, 10, 40)]
    assert loss[0] > loss[1] > loss[2] and loss[2] < 0.1


def test_windows_cover_whole_texts():
    texts = ["", "é" * 300, "x" * 256, "y" * 257, "z"]
    x, doc, filled = langnet.windows(*tx.buffers(pa.array(texts)))
    assert doc.tolist() == [1, 1, 1, 2, 3, 3, 4] and filled.tolist() == [256, 256, 88, 256, 256, 1, 1]
    assert [b"".join(x[i].tobytes() for i in np.flatnonzero(doc == d)).rstrip(b"\0").decode() for d in range(5)] == texts


def test_odd_rows(spark):
    net = toy()
    rows = [(1, None), (None, ""), (2, "123 456 !"), (2, "123 456 !"), (3, "abc abd éea " * 40_000), (4, "mno pqü nom"), (5, "m"), (6, "你好")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as lang_pred", "'s' as score", "1 as _letters", "'de' as lang")
    got = langnet.predict(df, net).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score"}
    by = {r.text: (r.lang_pred, r.score) for r in got}
    assert by[None] == by[""] == by["123 456 !"] == ("und", 0.0)
    assert by[rows[4][1]][0] == "xx" and by["mno pqü nom"][0] == "yy" and by["你好"][0] in ("xx", "yy")
    assert {(r.lang_pred, r.score) for r in langnet.predict(df, None).collect()} == {("und", 0.0)}
    assert langnet.predict(df.limit(0), net).collect() == []


def test_fit_without_usable_rows(spark):
    df = spark.createDataFrame([(1, None, "de"), (3, "abc", None), (4, "12", "de")], "doc_id long, text string, lang string")
    assert langnet.fit(df) is None and langnet.fit(df.limit(0)) is None
