"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is the multiset of its paragraphs (its lines, without empty ones).  Every paragraph is hashed to a wide vector
of lanes of 60 bits, and the fingerprint is the sum of the vectors modulo 2**60 per lane:

* lane 0 counts paragraphs (upper 30 bits) and blocks (lower 30 bits),
* ``EXACT`` lanes add a full 60-bit hash of the whole paragraph: equal multisets of paragraphs have equal sums, others do not,
* ``SKETCH`` lanes are two 30-bit counters each, to which every block of a paragraph (its next ``WIDTH`` characters at most)
  adds a random bit each.  Counter minus half the count is a random-sign sum, and such sums of two texts are as
  correlated as the texts are alike.  A text has fewer than 2**30 blocks, so counters don't run over.

Sums do not depend on the order of paragraphs.  ``insert`` and ``delete`` give the fingerprint of a text with
paragraphs added or taken out, without the rest of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsfolds.session import cut

WIDTH = 32
EXACT = 5
SKETCH = 36
MASK = (1 << 60) - 1
BITS = 1 | 1 << 30
COUNTER = (1 << 30) - 1
NO_ID = -(1 << 63)


def _hashed(parts: Column) -> Column:
    """Two hashes of every part of a text."""
    return F.transform(parts, lambda p: F.struct(F.xxhash64(p).alias("x"), F.xxhash64(p, F.lit(7)).alias("y")))


def _paragraphs(text: Column) -> Column:
    return _hashed(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != ""))


def _blocks(text: Column) -> Column:
    return _hashed(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^\n]{{1,{WIDTH}}}"), F.lit(0)))


def _lanes(paragraphs: Column, blocks: Column) -> Column:
    def lane(parts: Column, i: int, mask: int) -> Column:
        def add(total, p):
            return (total + F.xxhash64(p["x"], p["y"], F.lit(i)).bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(MASK))

        return F.aggregate(parts, F.lit(0).cast("long"), add)

    counts = F.shiftleft(F.size(paragraphs).cast("long"), 30) + F.size(blocks).cast("long")
    exact = [lane(paragraphs, i, MASK) for i in range(EXACT)]
    return F.array(counts, *exact, *[lane(blocks, EXACT + i, BITS) for i in range(SKETCH)])


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the lanes of column ``text`` as column ``name``.  Null and empty texts have no paragraphs: all lanes are 0."""
    hashed = df.withColumns({"_paragraphs": _paragraphs(F.col(text)), "_blocks": _blocks(F.col(text))})
    return hashed.withColumn(name, _lanes(F.col("_paragraphs"), F.col("_blocks"))).drop("_paragraphs", "_blocks")


def insert(lanes: Column, more: Column) -> Column:
    """Lanes of both texts' paragraphs together."""
    return F.zip_with(lanes, more, lambda a, b: (a + b).bitwiseAND(F.lit(MASK)))


def delete(lanes: Column, less: Column) -> Column:
    """Lanes without the paragraphs of the second text."""
    return F.zip_with(lanes, less, lambda a, b: (a - b).bitwiseAND(F.lit(MASK)))


def as_text(lanes: Column) -> Column:
    """Lanes as one string of 15 hexadecimal digits each."""
    return F.array_join(F.transform(lanes, lambda v: F.lower(F.lpad(F.hex(v), 15, "0"))), "")


def _signs(lanes: Column) -> Column:
    """The sketch's random-sign sums."""
    packed = F.slice(lanes, 2 + EXACT, SKETCH)
    counters = F.flatten(F.transform(packed, lambda v: F.array(*[F.shiftright(v, 30 * i).bitwiseAND(F.lit(COUNTER)) for i in range(2)])))
    n = lanes[0].bitwiseAND(F.lit(COUNTER))
    return F.transform(counters, lambda c: (2 * c - n).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints alone: 1 if they are equal, else 2 ab / (aa + bb) of the sketches, not below 0."""
    x, y = _signs(a), _signs(b)
    value = F.try_divide(2 * _dot(x, y), _dot(x, x) + _dot(y, y))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0)))))


def _next_rows(keys: DataFrame) -> DataFrame:
    """(d, h, d2, h2): for every row of ``keys`` the one before it by (d, h); for the first, the last.

    Rows are dealt by range and looked at inside a range; only one row of each range meets the others."""
    dealt = cut(keys.repartitionByRange("d", "h").withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part").orderBy("d", "h")
    row = F.struct("d", "h")
    inner = dealt.withColumn("before", F.lag(row).over(here))
    ends = dealt.groupBy("part").agg(F.max(row).alias("end"))
    every = Window.orderBy("part")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("end").over(every), F.max("end").over(whole)).alias("end"))
    inner = inner.join(F.broadcast(ends), "part")  # one row for each partition
    before = F.coalesce("before", "end")
    return inner.select("d", "h", before["d"].alias("d2"), before["h"].alias("h2"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document's, by descending doc_id (after the last, the first).  Null texts count as empty.
    Rows without doc_id come last; rows that share a doc_id are ordered by a hash of the text, and
    rows equal in both are one document in that order.  One document alone is its own next.
    """
    kind = docs.schema["doc_id"].dataType
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"),
        F.xxhash64("text").alias("h"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = _next_rows(base.select("d", "h").distinct())
    full = with_fingerprint(base, "text", "lanes").repartition("d", "h")
    need = base.select("d", "h", F.expr("length(text) div 3").alias("need")).dropDuplicates(["d", "h"])
    wanted = order.join(need, ["d", "h"]).select(F.col("d2").alias("d"), F.col("h2").alias("h"), F.struct("d", "h").alias("to"), "need")
    given = full.join(wanted, ["d", "h"]).select("to.d", "to.h", F.substring("text", F.lit(1), F.col("need").cast("int")).alias("tail"), F.col("lanes").alias("next_lanes"))
    given = given.dropDuplicates(["d", "h"])
    both = full.join(given, ["d", "h"])
    n = F.length("text")
    kept = F.substring("text", F.lit(1), (n - F.expr("length(text) div 3")).cast("int"))
    both = both.withColumn("edited", F.concat(kept, "tail"))
    both = with_fingerprint(both, "edited", "edited_lanes")
    return both.select(
        F.when(F.col("d") != NO_ID, F.col("d")).cast(kind).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
