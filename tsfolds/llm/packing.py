"""Best-fit packing of tokenised documents by exact-complement hashing.

Pieces are described by their length alone until the very end, so the plan is made on a histogram
with at most ``size`` rows.  Lengths are served from the longest down.  For a piece that leaves a gap,
the tables of single, pair and triple length sums give a combination that fills the gap exactly; it
is consumed as often as the counts allow.  What has no exact complement is packed best-fit: the longest
length that still fits, again and again.  Each step uses up a length or a group, so the plan
has few more rows than there are lengths.

Pieces then take their places by rank: a piece's rank among the pieces of its length, counted over
hash blocks (no global window), points into the plan's ranges.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsfolds.llm import text as tx
from tsfolds.session import cut

SIZE = 1024
END = 2  # id that closes each document
VOCABULARY = "byte_bpe_50k.json"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Anything but plain Latin text: what libraries might class differently, and special tokens.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u024f]|<\\|")


_ENCODERS: dict[str, object] = {}  # one per worker process


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the others are shifted to 256 and up in their order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoder(path: str):
    """Texts to ids, as bytes, for a byte-level vocabulary file.  Latin texts are encoded by a faster library from
    the same vocabulary and split pattern; texts with other characters, or with a special token, by
    the file's own library."""
    if path in _ENCODERS:
        return _ENCODERS[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
    import public_tokenizers
    import tiktoken

    byte_of = _byte_of()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if all(c in byte_of for c in piece)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = []  # loaded where a text asks for it: both libraries together take memory

    def encode(texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        slow = []
        for t in texts:
            if t and _OTHER.search(t):
                slow.append((len(out), t))
                out.append(b"")
            else:
                out.append(array("I", fast.encode_ordinary(t) if t else ()).tobytes())
        if slow and not own:
            from tokenizers import Tokenizer

            own.append(Tokenizer.from_file(path))
        for i, t in slow:
            out[i] = array("I", own[0].encode(t, add_special_tokens=False).ids).tobytes()
        return out

    _ENCODERS[path] = encode
    return encode


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all of ``size``, but for the first."""
    first = n % size or size
    if n <= size:
        return [(0, n)]
    return [(0, first), *((s, size) for s in range(first, n, size))]


def _pieces(path: str, size: int, end: int):
    def run(it):
        encode, close = _encoder(path), end.to_bytes(4, "little")
        for batch in it:
            for s in tx.slices(batch, "text"):
                ids = encode(s.column(s.schema.get_field_index("text")).to_pylist())
                out: list[tuple] = []
                for i, x in enumerate(ids):
                    x += close
                    for k, (a, n) in enumerate(cuts(len(x) // 4, size)):
                        out.append((i, k, a, n, zlib.crc32(x[4 * a : 4 * (a + n)])))
                row, piece, start, length, crc = zip(*out, strict=True)
                doc = s.column(s.schema.get_field_index("doc_id")).take(pa.array(row))
                cols = [doc, pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] for a histogram of lengths."""
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: list[int]) -> None:
        need: dict[int, int] = {}
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        times = min(int(left[n]) // c for n, c in need.items())
        for n, c in need.items():
            left[n] -= c * times
        out.append((tuple(lengths), times))

    def fits(lengths: list[int]) -> bool:
        return all(left[n] >= lengths.count(n) for n in set(lengths))

    def complement(gap: int, own: int) -> list[int] | None:
        """Single, pair or triple of lengths with the sum ``gap``; longer parts first."""
        left[own] -= 1
        try:
            if left[gap] > 0:
                return [gap]
            there = left > 0
            a = np.arange(gap - 1, (gap - 1) // 2, -1)  # a >= b >= 1
            for x in a[there[a] & there[gap - a]]:
                if fits([int(x), int(gap - x)]):
                    return [int(x), int(gap - x)]
            for x in np.flatnonzero(there[1 : gap - 1])[::-1] + 1:
                rest = gap - x
                if 3 * x < gap:
                    break
                b = np.arange(min(x, rest - 1), (rest - 1) // 2, -1)
                for y in b[there[b] & there[rest - b]]:
                    if fits([int(x), int(y), int(rest - y)]):
                        return [int(x), int(y), int(rest - y)]
            return None
        finally:
            left[own] += 1

    for n in range(size, 0, -1):
        while left[n] > 0:
            if n == size:
                use([n])
                continue
            parts = complement(size - n, n)
            if parts is not None:
                use([n, *parts])
                continue
            # best fit: the longest length that still fits, as far as any does
            lengths, gap = [n], size - n
            left[n] -= 1
            taken = [n]
            while True:
                at = np.flatnonzero(left[1 : gap + 1] > 0)
                if not len(at):
                    break
                x = int(at[-1]) + 1
                lengths.append(x)
                taken.append(x)
                left[x] -= 1
                gap -= x
            for x in taken:
                left[x] += 1
            use(lengths)
    return out


def _places(rows: list[tuple[int, int, int, int, int]]):
    """rows: (length, first rank, ranks, first sequence, offset), sorted by length and rank."""
    table = np.array(rows, np.int64).reshape(-1, 5)

    def run(it):
        for b in it:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "rank"))
            at = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                lo, hi = np.searchsorted(table[:, 0], [n, n + 1])
                mine = length == n
                at[mine] = lo + np.searchsorted(table[lo:hi, 1], rank[mine], side="right") - 1
            row = table[at]
            keep = [c for c in b.schema.names if c != "rank"]
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            cols += [pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text and ``end``; only one longer than ``size`` is cut, into pieces of
    ``size`` (the first may be shorter).  Null texts count as empty (one id).  Rows that share a doc_id
    or have none are packed each by itself.  Other columns are not looked at.  An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(base.transform(tx.arrow, _pieces(path, size, end), _PIECES))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    rows, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for lengths, times in plan({n: c for n, c in counts.items() if n < size}, size):
        offset = 0
        for n in lengths:
            rows.append((n, taken[n], times, sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    # full pieces need no rank; the others are ranked in about as many blocks as a block has pieces
    short = pieces.where(F.col("length") < size)
    blocks = 1 + math.isqrt(sum(n for length, n in counts.items() if length < size))
    held = short.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    per = held.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")
    per = per.select("length", "block", before.alias("before"))
    local = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = held.withColumn("place", F.row_number().over(local) - 1).join(per, ["length", "block"])
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*own, (F.col("before") + F.col("place")).alias("rank"))
    placed = ranked.transform(tx.arrow, _places(sorted(rows)), _PIECES + ", sequence_id long, offset long")
    full = pieces.where(F.col("length") == size).select(*own, (F.monotonically_increasing_id() + sequence).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
