"""Word hashing over Arrow text columns, vectorised with numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; no word crosses a
document.  A null text counts as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19  # text handled at once in a task (one longer document is handled alone)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASES = {"byte": 0xD1342543DE82EF95, "word": 0xAF251AF3B0F025B5, "word2": 0xF1357AEA2E62A9C5}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (_BASES[base], pow(_BASES[base], -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        got = _POWERS[base] = (out[0], out[1])
    return got


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: str) -> np.ndarray:
    """Polynomial hash of ``values[starts:ends]`` for each range, from one running sum."""
    pw, inv = _powers(base, len(values) + 1)
    c = np.zeros(len(values) + 1, U)
    np.cumsum(values * pw[: len(values)], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(U))


def windows_hash(words: np.ndarray, k: int, base: str = "word") -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (also across documents: the caller masks)."""
    n = max(0, len(words) - k + 1)
    s = np.arange(n)
    return ranges_hash(words, s, s + k, base)


@dataclass
class Words:
    data: np.ndarray  # bytes of all documents
    off: np.ndarray  # byte offsets of documents, one more than documents
    starts: np.ndarray  # byte range of each word
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word, one more than documents
    doc: np.ndarray  # document of each word

    def hashes(self) -> np.ndarray:
        return ranges_hash(_BYTE[self.data], self.starts, self.ends, "byte")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    if len(texts) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def split(texts: pa.Array, lower: bool = False) -> Words:
    data, off = buffers(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = ~_SPACE[data]
    new = np.zeros(n + 1, bool)
    new[off] = True
    before = np.ones(n, bool)
    before[1:] = ~word[:-1]
    starts = np.flatnonzero(word & (before | new[:-1]))
    after = np.ones(n, bool)
    after[:-1] = ~word[1:]
    ends = np.flatnonzero(word & (after | new[1:])) + 1
    first = np.searchsorted(starts, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(data, off, starts, ends, first, doc)


def runs(off: np.ndarray, limit: int):
    """(from, to) of runs of rows, ``off`` long in all, that hold at most ``limit`` each (or one row)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1), n)
        yield i, j
        i = j


def slices(batch: pa.RecordBatch, col: str, limit: int = SLICE_BYTES):
    """Cut a batch so that each part holds at most ``limit`` bytes of ``col`` (or one row)."""
    _, off = buffers(batch.column(batch.schema.get_field_index(col)))
    for i, j in runs(off, limit):
        yield batch.slice(i, j - i)


def packed(it):
    """Compress the column ``text`` of batches: half the bytes on the way through a shuffle."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    for b in it:
        at = b.schema.get_field_index("text")
        out = [squeeze.compress(t.encode()) if t is not None else None for t in b.column(at).to_pylist()]
        cols = [c if i != at else pa.array(out, pa.binary()) for i, c in enumerate(b.columns)]
        yield pa.RecordBatch.from_arrays(cols, b.schema.names)


def unpacked(it, rows: int = 512):
    """Batches with their compressed ``text`` as text again."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for batch in it:
        at = batch.schema.get_field_index("text")
        for a in range(0, batch.num_rows, rows):
            b = batch.slice(a, rows)
            out = [expand.decompress(t).decode() if t is not None else None for t in b.column(at).to_pylist()]
            cols = [c if i != at else pa.array(out, pa.string()) for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)


def with_type(schema, column: str, kind: str):
    """``schema`` with another type for one column."""
    from pyspark.sql.types import DataType, StructField, StructType

    return StructType([StructField(f.name, DataType.fromDDL(kind)) if f.name == column else f for f in schema.fields])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def extended(schema, **columns: str):
    """``schema`` with more columns (the given schema stays as it is)."""
    from pyspark.sql.types import DataType, StructType

    out = StructType(list(schema.fields))
    for name, kind in columns.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out


def arrow(df, fn, schema):
    """``df.mapInArrow(fn, schema)`` with this package shipped to the workers."""
    from tsfolds.session import ship

    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
