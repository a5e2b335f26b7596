import hashlib
import re
from collections import Counter

import pandas as pd

from conftest import SF001
from tsfolds.llm import queries as Q
from tsfolds.llm.repeats import remove_repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    """rows: (doc_id, text); kept text and removed count by doc_id."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    n = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = {}
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if n[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_query_against_brute_force(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op7_substring_dedup(spark, SF001).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = {i: (a, b, hashlib.sha256(t.encode()).hexdigest()) for i, (a, b, t) in brute(rows, 35).items()}
    assert got == want
    assert sum(x[1] for x in got.values()) > 0


def test_small_windows_periodic_and_odd_texts(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 60)))) for i in range(60)]
    rows += [(100, "x " * 90), (101, ""), (102, None), (103, "éè " * 3 + "tail word"), (104, " \t\n")]
    rows += [(200 + i, "one two three four five six seven eight nine ten") for i in range(30)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]).assign(found=1, doc="x", kept_text="y"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, window=9, gram=4).collect()}
    assert got == brute(rows, 9)


def test_empty_null_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).collect() == []
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (8, "short")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [("7", 40, 40), ("7", 40, 40), ("8", 1, 0), ("None", 40, 40)]


def test_versions_of_one_id_do_not_crash(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(7, t), (7, "a short one"), (9, t + " more"), (9, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(7, 3, 0), (7, 60, 60), (9, 0, 0), (9, 61, 60)]


def test_rows_go_by_their_own_text(spark):
    """Texts without doc_id, and different texts of one doc_id, do not share copies, marks or places."""
    text = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    passage = text("p", 40)
    rows = [(None, "copy", text("a", 50)), (None, "copy", text("a", 50)), (None, "alone", text("b", 50)), (1, "copy", text("c", 45)), (None, "copy", text("c", 45))]
    rows += [(None, "part", passage + " " + text("d", 50)), (2, "part", text("e", 30) + " " + passage), (None, "alone", text("f", 120))]
    rows += [(3, "copy", text("g", 50)), (3, "copy", text("g", 50)), (3, "alone", text("h", 50)), (3, "part", text("i", 9) + " " + passage), (None, "none", None), (None, "none", "")]
    df = spark.createDataFrame(rows, "doc_id long, kind string, text string")
    got = sorted((str(r.doc_id), r.kind, str(r.text), r.n_removed, r.kept_text) for r in remove_repeats(df).collect())
    want = brute([(i, t) for i, (_, _, t) in enumerate(rows)], 35)
    assert got == sorted((str(d), kind, str(t), *want[i][1:]) for i, (d, kind, t) in enumerate(rows))
    assert {(x[1], x[3] > 0) for x in got} == {("copy", True), ("part", True), ("alone", False), ("none", False)}
