import math

import numpy as np

from conftest import SF001
from tsfolds.llm import queries as Q
from tsfolds.llm.vectors import Index, kmeans, near_duplicates


def brute(rows, cosine):
    """rows: (vec_id, vector, label), ids distinct."""
    good = {}
    for i, v, label in rows:
        ok = v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok:
            x = np.array(v, np.float32).astype(float)
            good[i] = (label, x)
    links = {i: set() for i, _, _ in rows}
    ids = sorted(good)
    width = max((len(x) for _, x in good.values()), default=0)
    unit = {i: np.pad(x, (0, width - len(x))) / np.sqrt((x / np.abs(x).max()) @ (x / np.abs(x).max())) / np.abs(x).max() for i, (_, x) in good.items()}
    for a in ids:
        for b in ids:
            if a < b and good[a][0] == good[b][0] and unit[a] @ unit[b] >= cosine:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    want = brute(rows, 0.98)
    assert got(Q.op2_embedding_dedup(spark, SF001)) == want


def test_groups_over_many_lists_and_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] * (0.1 + i % 3) + rng.normal(size=16) * 0.12).tolist(), int(i % 2)) for i in range(700)]
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(40)]  # copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cls", "2 as own", "3 as list")
    want = brute(rows, 0.98)
    assert got(near_duplicates(df, sample=300, lists=20, block=16)) == want
    assert sum(x[0] for x in want.values()) > 1000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1)]
    rows += [(8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0], 1), (12, [-0.0, 1.0], 1), (13, [0.0, 1.0], 1), (14, [1e-38, 0.0], 1), (15, [3e38, 3e37], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got(near_duplicates(df)) == brute(rows, 0.98)
    assert got(near_duplicates(df.limit(0))) == {}
    assert got(near_duplicates(df.where("vec_id = 5"))) == {5: (0, 5, True)}
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (2, [1.0, 0.0], 1)], df.schema)
    rows = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_duplicates(df).collect())
    assert rows == [("2", 2, "2", True), ("2", 2, "2", True), ("None", 0, "None", True), ("None", 2, "2", False)]


def test_probes_and_coded_distances_lose_no_neighbour():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.02
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    index, r = Index(x, 25), 0.3
    nx, ny = index.near(x), index.near(y)
    probe_x, probe_y = ({(int(a), int(b)) for a, b in zip(*index.probes(u, n, r))} for u, n in ((x, nx), (y, ny)))
    codes, err = index.encode(y, ny)
    for i in range(400):
        if np.linalg.norm(x[i] - y[i]) <= r:
            assert (i, int(ny[i])) in probe_x or (i, int(nx[i])) in probe_y
            d = index.distances(x[i : i + 1], int(ny[i]), codes[i : i + 1])[0, 0]
            assert d - err[i] <= np.linalg.norm(x[i] - y[i]) + 1e-9
    assert len(kmeans(np.zeros((5, 3)), 4)) == 1
