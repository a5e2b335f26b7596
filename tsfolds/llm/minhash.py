"""MinHash near-dedup with sequential Bayesian verification.

1. Documents with equal shingle sets are one class; one row of each class goes on.
2. ``bands`` x ``rows`` min-hashes per class.  A bucket holds the classes that agree in one band.
   At similarity 0.8 the 24 bands of 4 rows miss a pair with probability 3e-6.
3. Candidates.  First each class of a bucket is compared with two hubs of the bucket (the least class,
   and the one with the least hash), which joins most of a bucket.  Then buckets that still hold several
   components are compared block by block inside tasks, only pairs of different components, each
   pair in its first common bucket; no table of all pairs of a group is made, and no pair that could
   change the result is left out.  This goes by rounds over the bands (``ROUNDS``): after each, components are joined,
   and buckets of the later bands that hold one component by then drop out.
4. Verification.  Signatures are compared batch by batch; after each batch a pair is dropped once the
   posterior probability of a similarity over the threshold is below ``miss``.  Survivors are verified
   exactly on their full shingle sets.
"""

from __future__ import annotations

import contextlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfolds.llm import text as tx
from tsfolds.llm.graph import components, copies_join
from tsfolds.session import cut

BANDS, ROWS = 24, 4
BATCH = 16  # hashes compared between two looks at the posterior
MISS = 1e-7
BLOCK = 128  # members of a bucket compared at once
ROUNDS = (6, BANDS)  # bands looked at before each joining of components
NAMELESS = 1 << 62  # nodes from here on stand for texts without doc_id

_SIGNED = "doc long, n long, sa long, sb long, sig binary"


def _shingles(texts: pa.Array, k: int):
    """Distinct shingle hashes of lower-cased texts, by document: (document of each, hash), sorted by both."""
    w = tx.split(texts, lower=True)
    h = w.hashes()
    grams = tx.windows_hash(h, k)
    inside = w.doc[: len(grams)] == w.doc[k - 1 :] if len(grams) else np.zeros(0, bool)
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < k))
    whole = tx.ranges_hash(h, w.first[short], w.first[short + 1], "word")
    doc = np.concatenate([w.doc[: len(grams)][inside], short])
    val = np.concatenate([grams[inside], whole])
    order = np.lexsort((val, doc))
    doc, val = doc[order], val[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (val[1:] != val[:-1])
    return doc[new], val[new]


def _signatures(k: int, n_hashes: int):
    def run(it):
        rng = np.random.default_rng(20)
        mul = rng.integers(0, 1 << 63, n_hashes, dtype=np.int64).view(tx.U) * tx.U(2) + tx.U(1)
        xor = rng.integers(0, 1 << 63, n_hashes, dtype=np.int64).view(tx.U)
        for batch in it:
            for s in tx.slices(batch, "text"):
                doc, val = _shingles(s.column(s.schema.get_field_index("text")), k)
                n = np.bincount(doc, minlength=s.num_rows)
                at = np.flatnonzero(n)
                first = np.concatenate([[0], np.cumsum(n)])[:-1][at]
                sig = np.zeros((s.num_rows, n_hashes), np.uint32)
                sums = np.zeros((2, s.num_rows), tx.U)
                if len(at):
                    for j in range(n_hashes):
                        sig[at, j] = np.minimum.reduceat((val ^ xor[j]) * mul[j], first) >> tx.U(32)
                    sums[0, at] = np.add.reduceat(tx.mix(val), first)
                    sums[1, at] = np.add.reduceat(tx.mix(val ^ xor[0]), first)
                yield pa.RecordBatch.from_arrays(
                    [
                        s.column(s.schema.get_field_index("doc")),
                        pa.array(n, pa.int64()),
                        pa.array(tx.signed(sums[0])),
                        pa.array(tx.signed(sums[1])),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    ["doc", "n", "sa", "sb", "sig"],
                )

    return run


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    if not len(col):
        return np.zeros((0, width), np.uint32)
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(len(col), width)


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket key of each band (signatures x bands)."""
    parts = sig.reshape(len(sig), bands, rows).astype(tx.U) * tx.U(0x9E3779B97F4A7C15)
    key = np.broadcast_to(tx.mix(np.arange(bands, dtype=tx.U)), (len(sig), bands))
    for j in range(rows):
        key = tx.mix(key + parts[:, :, j])
    return key


def _bands(bands: int, rows: int):
    def run(it):
        for b in it:
            key = _band_keys(_matrix(b.column(2), bands * rows), bands, rows).ravel()
            rep = lambda c: pa.array(np.repeat(np.asarray(c), bands))
            band = pa.array(np.tile(np.arange(bands, dtype=np.int32), b.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(key)), band, rep(b.column(0)), rep(b.column(1))], ["key", "band", "doc", "n"])

    return run


def least_matches(threshold: float, n: int, miss: float) -> int:
    """Fewest matches among ``n`` hashes at which P(similarity >= threshold) is at least ``miss``
    (uniform prior: the posterior is a Beta distribution, its tail a binomial sum)."""
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def _pruned(x, y, i, j, looks):
    """The pairs (row i of x, row j of y) that pass every look at the posterior."""
    got, start = np.zeros(len(i), int), 0
    for end, need in looks:
        got = got + (x[i, start:end] == y[j, start:end]).sum(axis=1)
        keep = got >= need
        i, j, got, start = i[keep], j[keep], got[keep], end
    return i, j


def _looks(width: int, percent: int, miss: float):
    ends = [*range(BATCH, width, BATCH), width]
    return [(n, least_matches(percent / 100, n, miss)) for n in ends]


def _survivors(width: int, percent: int, miss: float):
    looks = _looks(width, percent, miss)

    def run(it):
        for b in it:
            at = np.arange(b.num_rows)
            left, _ = _pruned(_matrix(b.column(2), width), _matrix(b.column(3), width), at, at, looks)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(left)), b.column(1).take(pa.array(left))], ["a", "b"])

    return run


def _compared(bands: int, rows: int, percent: int, miss: float):
    """Two blocks of members of one bucket: the pairs of different components that may be links.  A pair
    counts in its first common bucket only.  Shingles are cut to 32 bits here, which can only add
    pairs: what a set lost by shingles that fall together counts as common."""
    looks = _looks(bands * rows, percent, miss)

    def side(members):
        column = lambda f: np.array([m[f] for m in members])
        sig = np.frombuffer(b"".join(m["sig"] for m in members), np.uint32).reshape(len(members), -1)
        return column("doc"), column("component"), column("n"), sig, _band_keys(sig, bands, rows), [m["low"] for m in members]

    def run(it):
        for b in it:
            out_a, out_b = [], []
            for r in range(b.num_rows):
                key, same = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                x_doc, x_in, x_n, x_sig, x_key, x_sets = x = side(b.column(2)[r].as_py())
                y_doc, y_in, y_n, y_sig, y_key, y_sets = x if same else side(b.column(3)[r].as_py())
                ok = x_in[:, None] != y_in
                ok &= np.minimum(x_n[:, None], y_n) * 100 >= np.maximum(x_n[:, None], y_n) * percent
                if same:
                    ok = np.triu(ok, 1)
                i, j = np.nonzero(ok)
                first = (x_key[i] == y_key[j]).argmax(axis=1)
                here = x_key[i, first] == np.int64(key).view(tx.U)
                i, j = _pruned(x_sig, y_sig, i[here], j[here], looks)
                sets = {}
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    for at, members in ((("x", p), x_sets), (("y", q), y_sets)):
                        if at not in sets:
                            sets[at] = np.frombuffer(members[at[1]], np.uint32)
                    u, v = sets["x", p], sets["y", q]
                    both = len(np.intersect1d(u, v, assume_unique=True)) + min(x_n[p] - len(u), y_n[q] - len(v))
                    if both * 100 >= (x_n[p] + y_n[q] - both) * percent:
                        out_a.append(min(x_doc[p], y_doc[q]))
                        out_b.append(max(x_doc[p], y_doc[q]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _sets(k: int):
    """Shingle sets of compressed texts."""

    def run(it):
        for batch in tx.unpacked(it):
            for s in tx.slices(batch, "text"):
                doc, val = _shingles(s.column(s.schema.get_field_index("text")), k)
                ends = np.cumsum(np.bincount(doc, minlength=s.num_rows))
                val = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(tx.signed(val)))
                yield pa.RecordBatch.from_arrays([s.column(s.schema.get_field_index("doc")), val], ["doc", "shingles"])

    return run


def _low(it):
    """Sets cut to 32 bits, packed."""
    for b in it:
        out = [np.unique((x.values.to_numpy().view(tx.U) >> tx.U(32)).astype(np.uint32)).tobytes() for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc", "low"])


def _likely(pairs: DataFrame, reps: DataFrame, percent: int, miss: float, width: int) -> DataFrame:
    """The pairs (a, b) whose signatures pass every look at the posterior."""
    side = lambda c: reps.select(F.col("doc").alias(c), F.col("sig").alias(f"{c}_sig"))
    seen = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_sig", "b_sig")
    return seen.transform(tx.arrow, _survivors(width, percent, miss), "a long, b long")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets hold 100 * intersection >= percent * union."""
    side = lambda c: sets.select(F.col("doc").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    full = full.select("a", "b", both.alias("both"), (F.size("a_set") + F.size("b_set") - both).alias("either"))
    return full.where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")


@contextlib.contextmanager
def _small_batches(spark, size: str = "8m"):
    """Arrow batches of at most ``size`` while the body runs: a row here holds two blocks of members."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _between(buckets: DataFrame, found: DataFrame, reps: DataFrame, sets: DataFrame, bands: int, rows: int, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket (key, doc, n) and may be links."""
    named = buckets.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
    rest = cut(named.join(mixed.where("lo < hi").select("key", "size"), "key"))
    needed = sets.join(rest.select("doc").distinct(), "doc", "left_semi").transform(tx.arrow, _low, "doc long, low binary")
    full = reps.select("doc", "n", "sig").join(needed, "doc")
    block = F.pmod(F.xxhash64("doc"), F.ceil(F.col("size") / BLOCK))
    # dealt by bucket once, for the blocks and for their meeting
    members = rest.join(full, ["doc", "n"]).repartition("key").groupBy("key", block.alias("block"))
    members = members.agg(F.collect_list(F.struct("doc", "component", "n", "sig", "low")).alias("members"))
    x, y = members.alias("x"), members.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")))
    pairs = pairs.select("x.key", (F.col("x.block") == F.col("y.block")).alias("same"), F.col("x.members").alias("p"), F.col("y.members").alias("q"))
    return pairs.transform(tx.arrow, _compared(bands, rows, percent, miss), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable over links
    of similarity >= percent / 100, itself included) and kept (doc_id = component_id).

    Shingles are runs of ``k`` words of the text lower-cased in A-Z; a shorter text is one shingle.
    Null or wordless texts have none and link with nothing.  Rows that share a doc_id are expected
    to be copies; if their texts differ, each row goes by its own text.  Rows without doc_id link as
    others do, but do not name a component: component_id is null where no row of it has an id, and
    then kept is true.  Ids are below 2**62.  Other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType
    node = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS)))
    base = docs.select(F.col("text").cast("string").alias("text"), node.alias("doc"))
    width = bands * rows
    signed = cut(base.transform(tx.arrow, _signatures(k, width), _SIGNED))
    full = signed.where("n > 0")
    classes = full.groupBy("sa", "sb", "n").agg(F.min("doc").alias("cls"), F.count("*").alias("copies"))
    same = ["doc", "sa", "sb", "n"]
    reps = full.join(classes.withColumnRenamed("cls", "doc"), same, "left_semi").dropDuplicates(same)
    reps = cut(reps.select("doc", "n", "sig"))
    keyed = reps.transform(tx.arrow, _bands(bands, rows), "key long, band int, doc long, n long")
    hubs = keyed.groupBy("key").agg(
        F.min(F.struct("doc", "n")).alias("hub"),
        F.min(F.struct(F.xxhash64("doc", "key").alias("h"), "doc", "n")).alias("hub2"),
        F.count("*").alias("size"),
    ).where("size > 1")
    # open: the two hubs do not meet all members of the bucket
    is_open = (F.col("size") > 3) | ((F.col("size") == 3) & (F.col("hub.doc") == F.col("hub2.doc")))
    buckets = cut(keyed.join(hubs, "key").select("key", "band", is_open.alias("open"), "doc", "n", "hub", F.struct("hub2.doc", "hub2.n").alias("hub2")))
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    star = buckets.select("doc", "n", F.explode(F.array("hub", "hub2")).alias("x"))
    star = star.where((F.col("doc") != F.col("x.doc")) & fits(F.col("n"), F.col("x.n")))
    tried = star.select(F.least("doc", "x.doc").alias("a"), F.greatest("doc", "x.doc").alias("b")).distinct()
    likely = cut(_likely(tried, reps, percent, miss, width))
    # the texts are shuffled once: for the sets of all documents that are compared exactly
    ids = likely.select(F.explode(F.array("a", "b")).alias("doc")).unionByName(buckets.where("open").select("doc")).distinct()
    packed = base.select("doc", "text").transform(tx.arrow, tx.packed, "doc long, text binary")
    sets = cut(packed.join(ids, "doc", "left_semi").transform(tx.arrow, _sets(k), "doc long, shingles array<long>"))
    found = components(_exact(likely, sets, percent))
    # the rest: buckets that still hold several components, compared block by block
    last = 0
    for end in sorted({min(r, bands) for r in ROUNDS} | {bands}):
        some = buckets.where(F.col("open") & F.col("band").between(last, end - 1)).select("key", "doc", "n")
        last = end
        with _small_batches(docs.sparkSession):
            more = cut(_exact(_between(some, found, reps, sets, bands, rows, percent, miss), sets, percent))
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    several = classes.where("copies > 1")
    of = copies_join(signed.select("doc", "n", "sa", "sb"), several, ["sa", "sb", "n"], "doc")
    of = of.select("doc", "n", F.coalesce("cls", "doc").alias("cls"))
    of = of.join(found.withColumnRenamed("node", "cls"), "cls", "left")
    component = F.coalesce("component", "cls")
    known = lambda c: F.when(c < NAMELESS, c).cast(kind)
    out = of.select(known(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), known(component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
