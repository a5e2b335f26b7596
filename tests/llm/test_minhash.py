import random
import re

import pandas as pd

from conftest import SF001
from tsfolds.llm import queries as Q
from tsfolds.llm.minhash import least_matches, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((root(x), root(y)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def rows_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = brute(rows, 4)
    assert rows_of(Q.op1_minhash_dedup(spark, SF001)) == want
    assert any(not x[2] for x in want.values())


def test_chains_and_a_group_of_near_copies(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # near copies of one text, some of them far from each other
        w = list(base)
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(20):  # a chain: neighbours are close, ends are not
        rows.append((1000 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 120))))
    rows += [(2000 + i, "tiny text") for i in range(5)] + [(3000, ""), (3001, None), (3002, "Tiny TEXT"), (3003, "one")]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]).assign(sig=1, n=2, doc=3))
    assert rows_of(near_duplicates(df, k=4)) == brute(rows, 4)


def test_empty_table_null_and_repeated_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    t = "a b c d e f g h"
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (None, "z y x"), (None, "z y x")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(df).collect())
    assert got == [("4", 4, "4", True)] * 2 + [("None", 1, "None", True)] * 2 + [("None", 4, "4", False)]


def test_posterior_bound():
    assert least_matches(0.8, 16, 1e-7) <= least_matches(0.8, 128, 1e-7) < 0.8 * 128
    assert least_matches(0.8, 128, 0.5) > least_matches(0.8, 128, 1e-7)


def test_sets_that_lose_shingles_at_32_bits_are_not_dropped():
    import numpy as np
    import pyarrow as pa

    from tsfolds.llm import minhash

    sig = np.arange(96, dtype=np.uint32)
    member = lambda doc: {"doc": doc, "component": doc, "n": 100, "sig": sig.tobytes(), "low": np.arange(80, dtype=np.uint32).tobytes()}
    key = int(minhash._band_keys(sig[None, :], 24, 4).view(np.int64)[0, 0])
    batch = pa.RecordBatch.from_pylist([{"key": key, "same": True, "p": [member(1), member(2)], "q": [member(1), member(2)]}])
    out = list(minhash._compared(24, 4, 80, 1e-7)([batch]))
    assert out[0].to_pylist() == [{"a": 1, "b": 2}]
