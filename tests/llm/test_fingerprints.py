import hashlib
import random
import struct

import xxhash
from pyspark.sql import functions as F

from conftest import SF001
from tsfolds.llm import fingerprints as fp
from tsfolds.llm import queries as Q


def edited(rows):
    """(doc_id, text) with distinct ids: the edited text by id."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(rows):
        t, other = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        out[d] = t[: len(t) - k] + other[:k]
    return out


def test_query(spark):
    got = {r.doc_id: r for r in Q.op3_multiset_fingerprint(spark, SF001).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    want = edited(rows)
    assert len(got) == len(rows)
    prints = {}
    for d, t in rows:
        r = got[d]
        assert r.n_chars == len(t or "") and r.edited_sha256 == hashlib.sha256(want[d].encode()).hexdigest()
        assert prints.setdefault(r.fingerprint, t) == t and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(prints) == len({t for _, t in rows})
    assert sum(r.near_edited > r.near_next for r in got.values()) >= 0.9 * len(rows)
    near = [r.near_edited for r in got.values() if r.n_chars > 500]
    assert 0.55 < sum(near) / len(near) < 0.8


def lanes(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return {r.i: r.v for r in fp.with_fingerprint(df, "text", "v").collect()}


def test_order_insertion_and_deletion(spark):
    rnd = random.Random(1)
    lines = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(rnd.randrange(0, 30))) for _ in range(40)]
    mixed = rnd.sample(lines, 40)
    v = lanes(spark, ["\n".join(lines), "\n".join(mixed), "\n".join(lines[:30]), "\n".join(lines[30:]), "\n".join(lines[1:]), None, ""])
    assert v[0] == v[1] and v[0] != v[4] and v[5] == v[6] == [0] * len(v[0])
    df = spark.createDataFrame([(v[2], v[3], v[0])], "a array<long>, b array<long>, c array<long>")
    r = df.select(fp.insert(F.col("a"), F.col("b")).alias("sum"), fp.delete(F.col("c"), F.col("b")).alias("left")).first()
    assert r["sum"] == v[0] and r["left"] == v[2]


def test_likeness_follows_shared_paragraphs(spark):
    rnd = random.Random(2)
    lines = [f"{rnd.random()} {rnd.random()}"[:30] for _ in range(400)]
    for shared in (0, 100, 200, 300, 400):
        v = lanes(spark, ["\n".join(lines[:200] + lines[200:400]), "\n".join(lines[:shared] + [f"x{i} {rnd.random()}" for i in range(400 - shared)])])
        df = spark.createDataFrame([(v[0], v[1])], "a array<long>, b array<long>")
        near = df.select(fp.likeness(F.col("a"), F.col("b"))).first()[0]
        assert abs(near - shared / 400) < 0.3


def test_odd_rows(spark):
    rows = [(3, "abcdef"), (1, ""), (2, None), (9, "é" * 7), (7, "xyz" * 1000)]
    schema = "doc_id long, text string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as d", "2 as h", "3 as lanes")
    got = {r.doc_id: r for r in fp.edited_fingerprints(df).collect()}
    want = edited(rows)
    assert {d: r.edited_sha256 for d, r in got.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
    assert fp.edited_fingerprints(df.limit(0)).collect() == []
    one = fp.edited_fingerprints(spark.createDataFrame([(5, "abcdef")], schema)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    df = spark.createDataFrame([(5, "aaa"), (5, "aaa"), (None, "bbb"), (None, "ccc")], schema)
    assert sorted((str(r.doc_id), r.n_chars) for r in fp.edited_fingerprints(df).collect()) == [("5", 3), ("5", 3), ("None", 3), ("None", 3)]


def brute(text):
    """The lanes of a text by their definition, hashed outside Spark."""

    def chain(*parts, seed=42):
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed=seed)
        return seed

    def sums(parts, i, mask):
        total = 0
        for p in parts:
            p = p.encode()
            x, y = chain(p), chain(p, struct.pack("<i", 7))
            total += chain(struct.pack("<Q", x), struct.pack("<Q", y), struct.pack("<i", i)) & mask
        return total % 2**60

    paragraphs = [p for p in (text or "").split("\n") if p]
    blocks = [p[k : k + fp.WIDTH] for p in paragraphs for k in range(0, len(p), fp.WIDTH)]
    exact = [sums(paragraphs, i, 2**60 - 1) for i in range(fp.EXACT)]
    return [len(paragraphs) * 2**30 + len(blocks), *exact, *[sums(blocks, fp.EXACT + i, 1 + 2**30) for i in range(fp.SKETCH)]]


def test_lanes_and_likeness_against_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(25).collect()]
    texts += [None, "", "\n\n", "a", "é\n" * 40, "\r\n x \n", "ab" * 700]
    got = lanes(spark, texts)
    want = [brute(t) for t in texts]
    assert [got[i] for i in range(len(texts))] == want

    def likeness(a, b):
        signs = lambda v: [2 * ((c >> s) % 2**30) - v[0] % 2**30 for c in v[1 + fp.EXACT :] for s in (0, 30)]
        x, y = signs(a), signs(b)
        dot = lambda p, q: sum(s * t for s, t in zip(p, q, strict=True))
        down = dot(x, x) + dot(y, y)
        return 1.0 if a == b else max(0.0, min(1.0, 2 * dot(x, y) / down if down else 0.0))

    pairs = [(i, j, want[i], want[j]) for i in range(0, len(texts), 3) for j in range(len(texts))]
    df = spark.createDataFrame(pairs, "i long, j long, a array<long>, b array<long>")
    for r in df.select("i", "j", fp.likeness(F.col("a"), F.col("b")).alias("l")).collect():
        assert abs(r.l - likeness(want[r.i], want[r.j])) < 1e-12


def test_paragraphs_not_blocks_decide_equality(spark):
    w = fp.WIDTH
    one, two, turned = "x" * w + "tail", "x" * w + "\n" + "tail", "tail\n" + "x" * w
    split, moved = "x" * w + "y" * w + "\n" + "z" * w, "x" * w + "\n" + "y" * w + "z" * w
    v = lanes(spark, [one, two, turned, split, moved, "a\na\nb", "a\nb\nb", "a\n\nb\na"])
    assert v[0] != v[1] and v[1] == v[2] and v[3] != v[4] and v[5] != v[6] and v[5] == v[7]
