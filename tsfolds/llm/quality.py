"""Document quality from a linear-chain CRF over lines.

Every line is good or bad.  A line's features are shape ratios of its own bytes and words and those of
the lines before and after it.  The CRF is trained on the driver from a bounded sample of labelled
documents (``SAMPLE``, a parameter): lines take their document's label, and in two more rounds the lines of bad
documents are relabelled by the model itself, so that clean lines of bad documents count as good.
A document's score is the mean of its lines' forward-backward marginals, weighted by line length and
set to a probability by a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfolds.llm import crf
from tsfolds.llm import text as tx

SAMPLE = 3000  # most labelled documents that the model is fitted on
THRESHOLD = 0.7

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@^~=<>_\\+", b"!?", b"|", b".,;:", b"\"'()[]{}-/", b" "]
N_BASE = 16


def _line_table(texts: pa.Array):
    """(features, bytes of each line, offsets of documents in lines).  A document has at least one line."""
    w = tx.split(texts)
    data, off = w.data, w.off
    n = len(data)
    breaks = np.flatnonzero(data == 0x0A)
    docs = len(off) - 1
    # a line starts at each document's start and after each break inside it
    inside = breaks[(breaks + 1 <= n)]
    owner = np.searchsorted(off, inside, side="right") - 1
    starts = np.concatenate([off[:-1], inside + 1])
    ends_doc = np.concatenate([np.arange(docs), owner])
    order = np.lexsort((starts, ends_doc))
    starts, doc = starts[order], ends_doc[order]
    last = np.ones(len(starts), bool)
    last[:-1] = doc[1:] != doc[:-1]
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[last] = off[1:][doc[last]]
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))])
    length = ends - starts
    size = np.maximum(length, 1)
    ratio = []
    for members in _CLASSES:
        is_in = np.zeros(256, bool)
        is_in[list(members)] = True
        c = np.zeros(n + 1, np.int32)
        np.cumsum(is_in[data], out=c[1:], dtype=np.int32)
        ratio.append((c[ends] - c[starts]) / size)
    h = w.hashes()
    a, b = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    words = b - a
    many = np.maximum(words, 1)
    again = np.zeros(len(h) + 2, np.int32)  # again[i]: words before the i-th that equal the one before them
    again[2 : len(h) + 1] = np.cumsum(h[1:] == h[:-1])
    repeats = np.where(words > 1, again[np.maximum(b, 1)] - again[np.minimum(a + 1, len(h))], 0)
    line_of = np.repeat(np.arange(len(starts)), words)
    o = np.lexsort((h, line_of)) if len(h) else np.zeros(0, int)
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (h[o][1:] != h[o][:-1]) | (line_of[o][1:] != line_of[o][:-1])
    distinct = np.bincount(line_of[o][new], minlength=len(starts))
    whole = tx.ranges_hash(h, a, b, "word") + doc.astype(tx.U) * tx.U(0x9E3779B97F4A7C15)
    _, inv, cnt = np.unique(whole, return_inverse=True, return_counts=True)
    upper, lower = ratio[0], ratio[1]
    x = np.stack(
        [
            np.ones(len(starts)),
            np.log1p(words) / 4,
            upper / np.maximum(upper + lower, 1e-9) * (upper + lower > 0),
            *[np.minimum(1, r * s) for r, s in zip(ratio[2:], (2, 4, 8, 12, 4, 4, 2), strict=True)],
            repeats / many,
            distinct / many,
            (w.ends[np.minimum(b, len(w.ends)) - 1] - w.starts[np.minimum(a, max(0, len(w.starts) - 1))]) / many / 10 * (words > 0)
            if len(h)
            else np.zeros(len(starts)),
            np.where(words > 0, cnt[inv] > 1, False).astype(float),
            (words == 0).astype(float),
            np.minimum(words, 5) / 5,
        ],
        axis=1,
    )
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        before[1:] = x[:-1]
        after[:-1] = x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after], axis=1), length, first


def _mean(p: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of ``p`` over each document, weighted by length + 1."""
    c = np.concatenate([[0], np.cumsum(p * (length + 1))])
    w = np.concatenate([[0], np.cumsum(length + 1)])
    return (c[first[1:]] - c[first[:-1]]) / (w[first[1:]] - w[first[:-1]])


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(1) = 1 / (1 + exp(-(slope * m + shift))), by Newton steps with a ridge."""
    x = np.stack([m, np.ones(len(m))], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 0.05])
        b = b + np.linalg.solve(h, x.T @ (y - p) - 0.05 * b)
    return float(b[0]), float(b[1])


def train(rows: list[tuple[str | None, int]]):
    """(model, slope, shift) from (text, quality) rows; without rows every document scores 0.5."""
    if not rows:
        return None
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string())], ["text"])
    parts = [_line_table(s.column(0)) for s in tx.slices(batch, "text", 1 << 18)]  # small slices: the driver's memory is small
    x, length = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    label = np.array([q for _, q in rows])
    line = np.repeat(label, np.diff(first))
    y, model = line.copy(), None
    for turn in range(3):
        model = crf.fit(x, y, first, 2, start=model, rounds=120 if turn == 0 else 50)
        p = crf.forward_backward(x @ model.weights, first, model.trans)[0][:, 1]
        y = np.where(line == 1, 1, (p > 0.5).astype(int))
        worst = np.array([a + int(np.argmin(p[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)])
        y[worst[label == 0]] = 0  # a bad document has a bad line
    return (model, *_logistic(_mean(p, length, first), label))


def _scores(fitted, keep: list[str]):
    def run(it):
        for batch in it:
            for s in tx.slices(batch, "text"):
                if fitted is None:
                    score = np.full(s.num_rows, 0.5)
                else:
                    model, slope, shift = fitted
                    x, length, first = _line_table(s.column(s.schema.get_field_index("text")))
                    p = crf.forward_backward(x @ model.weights, first, model.trans)[0][:, 1]
                    score = 1 / (1 + np.exp(-(slope * _mean(p, length, first) + shift)))
                yield pa.RecordBatch.from_arrays([*[s.column(s.schema.get_field_index(c)) for c in keep], pa.array(score)], [*keep, "score"])

    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Train on at most ``sample`` labelled documents: those with the least hashes of doc_id among the rows
    that are not held out.  Labels other than 0 and 1, and texts without a label, are left out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    return train([(r.text, int(r.quality)) for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.text or ""))])


def classify(docs: DataFrame, fitted, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1, higher: likelier good) and ``predicted`` (1 if
    score >= threshold, else 0).  Null and empty texts are one empty line.  Columns of these names are
    replaced.  Every row is scored by itself, so ties and repeated rows score alike."""
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    df = docs.select(*own).withColumn("text", F.col("text").cast("string"))
    out = df.transform(tx.arrow, _scores(fitted, own), tx.extended(df.schema, score="double"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
