"""Embedding near-dedup: inverted lists with product-quantised residuals and exact rerank.

1. Equal vectors of one label are one class; one row of each class goes on.
2. Coarse centroids and the residuals' subspace codebooks are fitted by k-means on the driver, on a
   bounded sample (``SAMPLE`` classes, a parameter).  Every class is indexed: its list, its codes, and the
   distance between its residual and the coded one.
3. Probes.  With unit vectors, cosine >= c means distance <= r = sqrt(2 - 2c).  A neighbour of q lies in
   list j only if q is within r of the boundary between j and q's own list, so q probes exactly the
   lists for which that holds: no neighbour is left out by probing.  Each unordered pair of lists is
   visited once.
4. Blocks of queries meet blocks of a list (equi-join on label and list, blocks of at most ``BLOCK``
   rows, so a label or list with a third of all rows is spread).  Table lookups give the asymmetric
   distances; a pair goes on unless that distance less the coding error is over r, and survivors are
   reranked by the exact cosine in double precision.
5. A block pair returns counts and, as links, a spanning forest of what it found, so a large group of
   near copies never becomes a table of all its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfolds.llm import text as tx
from tsfolds.llm.graph import components, copies_join
from tsfolds.session import cut

SAMPLE = 8192
LISTS = 1024
SUBSPACES = 8
CODES = 32
BLOCK = 512
NAMELESS = 1 << 62  # nodes from here on stand for vectors without vec_id


def _matrix(col: pa.Array) -> np.ndarray:
    rows = col.to_pylist()
    return np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), -1) if rows else np.zeros((0, 1), "<f4")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids (at most ``k``) by Lloyd's method; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    c = np.unique(x, axis=0)
    c = c[rng.permutation(len(c))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Coarse centroids and subspace codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES):
        self.coarse = kmeans(sample, lists)
        square = (self.coarse**2).sum(axis=1)
        self.apart = np.sqrt(np.maximum(0, square[:, None] + square - 2 * self.coarse @ self.coarse.T))
        rest = sample - self.coarse[self.near(sample)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.books = [kmeans(rest[:, c], codes, rounds=8) for c in self.cuts]

    def near(self, u: np.ndarray) -> np.ndarray:
        return np.argmin((self.coarse**2).sum(axis=1) - 2 * u @ self.coarse.T, axis=1)

    def encode(self, u: np.ndarray, near: np.ndarray):
        """(codes, distance of each residual from its coded form)."""
        rest = u - self.coarse[near]
        codes = np.empty((len(u), len(self.cuts)), np.uint8)
        err = np.zeros(len(u))
        for s, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            d = (rest[:, c] ** 2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * rest[:, c] @ book.T
            codes[:, s] = d.argmin(axis=1)
            err += np.maximum(0, ((rest[:, c] - book[codes[:, s]]) ** 2).sum(axis=1))
        return codes, np.sqrt(err)

    def probes(self, u: np.ndarray, near: np.ndarray, r: float):
        """(row, list) for every list on whose side of the boundary a vector within ``r`` may lie."""
        d = (self.coarse**2).sum(axis=1) - 2 * u @ self.coarse.T
        own = d[np.arange(len(u)), near][:, None]
        return np.nonzero((d - own <= 2 * r * self.apart[near] + 1e-6) & (np.arange(len(self.coarse)) >= near[:, None]))

    def distances(self, u: np.ndarray, j: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded vectors of list ``j``, by table lookups."""
        rest = u - self.coarse[j]
        d = np.zeros((len(u), len(codes)))
        for s, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = (rest[:, c] ** 2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * rest[:, c] @ book.T
            d += table[:, codes[:, s]]
        return np.sqrt(np.maximum(0, d))


_CODED = "cls long, label long, copies long, vec binary, own int, codes binary, err double"
_QUERY = "label long, list int, own int, cls long, copies long, vec binary"


def _coded(index: Index):
    def run(it):
        for b in it:
            u = _unit(_matrix(b.column(3)))
            near = index.near(u)
            codes, err = index.encode(u, near)
            cols = [*b.columns, pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err)]
            yield pa.RecordBatch.from_arrays(cols, ["cls", "label", "copies", "vec", "own", "codes", "err"])

    return run


def _queries(index: Index, r: float):
    def run(it):
        for b in it:
            for a in range(0, b.num_rows, 512):
                s = b.slice(a, 512)
                near = np.asarray(s.column(2))
                row, probe = index.probes(_unit(_matrix(s.column(4))), near, r)
                take = pa.array(row)
                cls, label, own, copies, vec = (c.take(take) for c in s.columns)
                yield pa.RecordBatch.from_arrays([label, pa.array(probe, pa.int32()), own, cls, copies, vec], ["label", "list", "own", "cls", "copies", "vec"])

    return run


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Least node reachable in the graph of links x - y over nodes 0..n-1."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _meet(index: Index, cosine: float, r: float):
    def run(it):
        for b in it:
            for i in range(b.num_rows):
                row = {f.name: b.column(k)[i].as_py() for k, f in enumerate(b.schema)}
                q, x = row["q"], row["x"]
                j = row["list"]
                qid, xid = np.array([v["cls"] for v in q]), np.array([v["cls"] for v in x])
                qn, xn = np.array([v["copies"] for v in q]), np.array([v["copies"] for v in x])
                own = np.array([v["own"] for v in q])
                qu, xu = (_unit(np.frombuffer(b"".join(v["vec"] for v in side), "<f4").reshape(len(side), -1)) for side in (q, x))
                codes = np.frombuffer(b"".join(v["codes"] for v in x), np.uint8).reshape(len(x), -1)
                err = np.array([v["err"] for v in x])
                near = index.distances(qu, j, codes) - err <= r + 1e-6
                a, c = np.nonzero(near)
                keep = np.ones(len(a), bool)
                for lo in range(0, len(a), 65536):
                    part = slice(lo, lo + 65536)
                    keep[part] = (qu[a[part]] * xu[c[part]]).sum(axis=1) >= cosine
                a, c = a[keep], c[keep]
                other = qid[a] != xid[c]
                a, c = a[other], c[other]
                if not len(a):
                    continue
                n = np.zeros(len(q) + len(x), np.int64)
                np.add.at(n, a, xn[c])
                far = own[a] != j  # the pair of lists is visited once: count for both sides
                np.add.at(n, len(q) + c[far], qn[a[far]])
                root = _forest(a, len(q) + c, len(n))
                ids = np.concatenate([qid, xid])
                hit = np.unique(np.concatenate([a, len(q) + c]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[root[hit]]), pa.array(n[hit])], ["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, sample: int = SAMPLE, lists: int = LISTS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links (other rows with the same
    label and cosine >= ``cosine``), component_id (least vec_id reachable over links, itself included), kept
    (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label,
    link with nothing.  Vectors of different length are compared as if padded with zeros.  Rows that share
    a vec_id are expected to be copies; each counts as a row.  Rows without vec_id link as others do but do
    not name a component (component_id is null where no row of it has an id, and then kept is true).
    """
    kind = vectors.schema["vec_id"].dataType
    vec = F.col("embedding").cast("array<float>")
    plain = vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vec, lambda v: v != 0)
    usable = F.coalesce(plain & F.col("label").isNotNull(), F.lit(False))
    node = F.coalesce(F.col("vec_id").cast("long"), F.xxhash64(vec, "label").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS)))
    base = vectors.select(node.alias("node"), F.col("label").cast("long").alias("label"), F.when(usable, vec).alias("vec"))
    width = base.agg(F.max(F.size("vec"))).first()[0] or 0
    known = lambda c: F.when(c < NAMELESS, c).cast(kind)
    if width > 0:
        padded = F.concat("vec", F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(width) - F.size("vec"))))
        padded = F.transform(padded, lambda v: v + F.lit(0.0).cast("float"))  # -0.0 becomes 0.0
        base = cut(base.withColumn("vec", padded))
        classes = cut(base.where("vec is not null").groupBy("label", "vec").agg(F.min("node").alias("cls"), F.count("*").alias("copies")))
        total = classes.count()
        rows = classes.orderBy(F.xxhash64("vec"), "cls").select("vec").limit(sample).collect()
        index = Index(_unit(np.array([r.vec for r in rows])), max(1, min(lists, math.isqrt(total), len(rows) // 8)))
        r = math.sqrt(max(0.0, 2 - 2 * cosine))
        coded = cut(classes.select("cls", "label", "copies", "vec").transform(tx.arrow, _bytes, "cls long, label long, copies long, vec binary").transform(tx.arrow, _coded(index), _CODED))
        dealt = lambda df, by: df.withColumn("block", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / block)))
        x = coded.withColumnRenamed("own", "list")
        x = dealt(x.join(x.groupBy("label", "list").agg(F.count("*").alias("size")), ["label", "list"]), "list")
        x = x.groupBy("label", "list", "block").agg(F.collect_list(F.struct("cls", "copies", "vec", "codes", "err")).alias("x")).drop("block")
        q = coded.select("cls", "label", "own", "copies", "vec").transform(tx.arrow, _queries(index, r), _QUERY)
        sizes = q.groupBy("label", "list").agg(F.count("*").alias("size"))
        q = dealt(q.join(sizes, ["label", "list"]), "list")
        q = q.groupBy("label", "list", "block").agg(F.collect_list(F.struct("cls", "copies", "vec", "own")).alias("q")).drop("block")
        found = cut(q.join(x, ["label", "list"]).select("list", "q", "x").transform(tx.arrow, _meet(index, cosine, r), "a long, b long, n long"))
        counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
        groups = components(found.where("a <> b").select("a", "b"))
        of = copies_join(base, classes.where("copies > 1"), ["label", "vec"], "node")
        of = of.select("node", F.coalesce("cls", "node").alias("cls"), "copies")
        of = of.join(counts, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        n_links = F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
        of = of.select("node", n_links.cast("long").alias("n_links"), F.coalesce("component", "cls").alias("component"))
    else:
        of = base.select("node", F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component"))
    out = of.select(known(F.col("node")).alias("vec_id"), "n_links", known(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def _bytes(it):
    for b in it:
        v = b.column(3)
        x = v.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(b.num_rows, -1)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], ["cls", "label", "copies", "vec"])
