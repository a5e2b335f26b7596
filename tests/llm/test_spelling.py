import re
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import SF001
from tsfolds.llm import queries as Q
from tsfolds.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_words(rows, every=None):
    out = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def brute(n):
    """Near words by the texts that lack one letter: two words are near if they share one, at the same place."""
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    for w in n:
        for i in range(len(w)):
            x = w[:i] + w[i + 1 :]
            if x in n:
                near[w].add(x)
                near[x].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None)
    return out


def result(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = brute(brute_words(rows, 97))
    assert result(Q.op11_spelling_variants(spark, SF001)) == want
    assert sum(x[0] is not None for x in want.values()) > 20


@pytest.mark.parametrize("cell, leaf, sample", [(40, 3, 300), (8, 1, 10_000), (1000, 16, 0)])
def test_random_words_over_few_letters(spark, cell, leaf, sample):
    rng = np.random.default_rng(5)
    letters = list("abcdyéÿ")
    n = {}
    for length in (5, 6, 7, 8):
        for _ in range(300):
            n["".join(rng.choice(letters, length))] = int(rng.integers(3, 60))
    n |= {"abcab": 4000, "abcad": 2000, "abcdd": 900, "abydd": 400, "é" * 300: 3, "é" * 301: 9}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert result(spelling.variants(df, cell=cell, leaf=leaf, sample=sample)) == brute(n)


def test_a_class_of_equal_letters_larger_than_a_cell(spark):
    import itertools

    n = {"".join(p): 3 + i % 7 for i, p in enumerate(itertools.permutations("abcde"))} | {"abcdf": 50, "abcdef": 7}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert result(spelling.variants(df, cell=10, leaf=4)) == brute(n)


def test_odd_rows(spark):
    long = "Étés " * 3 + "x" * 70_000 + " " + "x" * 70_001
    rows = [(None, "Hello hello HELLO"), (1, None), (2, ""), (2, ""), (3, long), (3, long), (4, long), (5, "hallo hallo hallo 你好 hallo7hallo"), (5, "abc 123 --")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' as word", "9 as n", "'f' as form")
    counted = spelling.words(df)
    assert {r.word: r.n for r in counted.collect()} == brute_words(rows)
    got = result(spelling.variants(counted))
    assert got == brute(brute_words(rows)) and got["x" * 70_000][3] == 1
    assert spelling.variants(spelling.words(df.limit(0))).collect() == []
    assert spelling.variants(spelling.words(df.where("doc_id in (1, 2)"))).collect() == []
