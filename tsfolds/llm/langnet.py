"""Language identification by a byte convolutional network.

A text is cut into windows of ``WINDOW`` bytes.  Every byte has a vector; filters of several widths slide over
the window, each filter's largest value is kept, and a softmax over these gives the languages' probabilities.
A document's answer weighs its windows' log-probabilities by their bytes; all windows count.

The network is trained in numpy on the driver from a bounded sample (``SAMPLE`` windows, balanced over the languages).
For prediction the byte vectors are multiplied into the filters once: a filter's response is then a sum of table
rows looked up by byte pairs, and a block of windows is a few lookups, sums and one maximum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfolds.llm import text as tx
from tsfolds.llm.quality import held_out

WINDOW = 256  # bytes of a window
SAMPLE = 6000  # most training windows, over all languages
PER_TEXT = 2  # most training windows of one text
WIDTHS = (2, 3, 4)
FILTERS, DIM = 8, 8  # filters of each width, numbers of a byte's vector
ROUNDS, BATCH, RATE = 12, 64, 0.01
BLOCK = 128  # windows predicted at once
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    filters: list[np.ndarray]  # by width: responses by place and byte (width x 256 x FILTERS)
    shift: np.ndarray
    weights: np.ndarray  # pooled responses x languages
    bias: np.ndarray


def windows(data: np.ndarray, off: np.ndarray, size: int = WINDOW):
    """(windows, document of each, bytes of each): whole texts cut into windows, the last one filled with zeros."""
    length = np.diff(off)
    n = -(-length // size)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((int(first[-1]), size), np.uint8)
    flat = out.reshape(-1)
    for a, b, at in zip(off[:-1].tolist(), off[1:].tolist(), (first[:-1] * size).tolist(), strict=True):
        flat[at : at + b - a] = data[a:b]
    doc = np.repeat(np.arange(len(length)), n)
    filled = np.minimum(size, length[doc] - (np.arange(len(doc)) - first[doc]) * size)
    return out, doc, filled


# --------------------------------------------------------------------------- training


def _respond(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Responses (windows x places x filters) of the filters in ``table`` (width x 256 x filters)."""
    width = len(table)
    places = x.shape[1] - width + 1
    out = table[0][x[:, :places]]
    for k in range(1, width):
        out += table[k][x[:, k : k + places]]
    return out


def train(texts: list[bytes], labels: list[str], rounds: int = ROUNDS, seed: int = 7, widths=WIDTHS, filters: int = FILTERS, dim: int = DIM) -> Network | None:
    """Fit the network on windows and their languages by Adam over the softmax's cross-entropy, each language
    weighing alike.  No windows give None."""
    if not texts:
        return None
    langs = sorted(set(labels))
    y = np.searchsorted(langs, labels)
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for i, t in enumerate(texts):
        x[i, : len(t)] = np.frombuffer(t[:WINDOW], np.uint8)
    weight = (len(y) / len(langs) / np.bincount(y, minlength=len(langs)))[y].astype(np.float32)
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale=1.0: (rng.standard_normal(shape) * scale).astype(np.float32)
    pooled = len(widths) * filters
    par = {"byte": normal(256, dim, scale=0.5), "shift": np.zeros(pooled, np.float32), "out": normal(pooled, len(langs), scale=pooled**-0.5), "bias": np.zeros(len(langs), np.float32)}
    par |= {w: normal(w, dim, filters, scale=(w * dim) ** -0.5) for w in widths}
    moment = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in par.items()}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            rows = order[a : a + BATCH]
            xb, n = x[rows], len(rows)
            grad, peaks, tops = {}, [], []
            for w in widths:
                response = _respond(xb, par["byte"] @ par[w])
                peak = response.argmax(axis=1)
                peaks.append(peak)
                tops.append(np.take_along_axis(response, peak[:, None, :], axis=1)[:, 0])
            z = np.concatenate(tops, axis=1) + par["shift"]
            hidden = np.maximum(z, 0)
            score = hidden @ par["out"] + par["bias"]
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[rows]] -= 1
            p *= weight[rows, None] / n
            grad["out"], grad["bias"] = hidden.T @ p, p.sum(axis=0)
            back = (p @ par["out"].T) * (z > 0)
            grad["shift"] = back.sum(axis=0)
            grad["byte"] = np.zeros_like(par["byte"])
            for i, w in enumerate(widths):
                part = back[:, i * filters : (i + 1) * filters]
                grad[w] = np.zeros_like(par[w])
                for k in range(w):
                    # only the place of the maximum passes a gradient on
                    at = np.take_along_axis(xb, peaks[i] + k, axis=1).astype(np.int64) * filters + np.arange(filters)
                    table = np.bincount(at.ravel(), part.ravel(), 256 * filters).reshape(256, filters).astype(np.float32)
                    grad["byte"] += table @ par[w][k].T
                    grad[w][k] = par["byte"].T @ table
            step += 1
            for key, g in grad.items():
                m, v = moment[key]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                par[key] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(langs, [par["byte"] @ par[w] for w in widths], par["shift"], par["out"], par["bias"])


def _training_windows(per_text: int):
    """Windows of a text at even distances, the first at its beginning."""

    def run(it):
        for batch in it:
            out = {"lang": [], "window": []}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                n = min(per_text, -(-len(data) // WINDOW))
                for i in range(n):
                    at = max(0, len(data) - WINDOW) * i // max(1, n - 1)
                    out["lang"].append(lang)
                    out["window"].append(data[at : at + WINDOW])
            yield pa.RecordBatch.from_pydict({"lang": pa.array(out["lang"], pa.string()), "window": pa.array(out["window"], pa.binary())})

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, per_text: int = PER_TEXT, **settings) -> Network | None:
    """Train on texts with a language that are not held out and hold a letter: at most about ``sample`` windows of
    256 bytes, an equal share for each language, the texts chosen by a hash of doc_id and text."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in known.where("text is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    quota = sample / per_text / len(sizes)
    # texts whose hash lies under their language's share
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int((1 << 30) * min(1.0, quota / n)))])
    chosen = known.where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")]) & F.col("text").rlike(r"\p{L}"))
    rows = chosen.select("lang", "text").transform(tx.arrow, _training_windows(per_text), "lang string, window binary").collect()
    rows = sorted((bytes(r.window), r.lang) for r in rows)
    return train([w for w, _ in rows], [lang for _, lang in rows], **settings)


# --------------------------------------------------------------------------- prediction


class _Lookup:
    """The network's filters as tables by byte pairs: a filter of width w is the sum of w // 2 pair rows and,
    where w is odd, of one byte row."""

    def __init__(self, net: Network):
        self.net = net
        self.pairs = [[np.ascontiguousarray((t[k][:, None] + t[k + 1][None]).reshape(1 << 16, -1)) for k in range(0, len(t) - 1, 2)] for t in net.filters]

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities (windows x languages).  Places lie on the first axis, so that the maximum runs along rows."""
        net, t = self.net, np.ascontiguousarray(x.T).astype(np.intp)
        pair = (t[:-1] << 8) + t[1:]
        size, tops = len(t), []
        for table, by_pair in zip(net.filters, self.pairs, strict=True):
            width = len(table)
            places = size - width + 1
            out = by_pair[0].take(pair[:places], axis=0)
            for k, rows in enumerate(by_pair[1:], 1):
                out += rows.take(pair[2 * k : 2 * k + places], axis=0)
            if width % 2:
                out += table[-1].take(t[width - 1 : width - 1 + places], axis=0)
            tops.append(out.max(axis=0))
        score = np.maximum(np.concatenate(tops, axis=1) + net.shift, 0) @ net.weights + net.bias
        score = score.astype(np.float64)
        score -= score.max(axis=1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=1, keepdims=True))


def _predicted(net: Network | None, keep: list[str]):
    def run(it):
        lookup = _Lookup(net) if net is not None else None
        for batch in it:
            for s in tx.slices(batch, "text"):
                n = s.num_rows
                lang, score = [UNKNOWN] * n, np.zeros(n)
                if lookup is not None and n:
                    x, doc, filled = windows(*tx.buffers(s.column(s.schema.get_field_index("text"))))
                    total = np.zeros((n, len(net.langs)))
                    for a in range(0, len(x), BLOCK):
                        part = slice(a, a + BLOCK)
                        np.add.at(total, doc[part], lookup.logs(x[part]) * filled[part, None])
                    total /= np.maximum(1, np.bincount(doc, filled, n))[:, None]
                    p = np.exp(total - total.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    letters = s.column(s.schema.get_field_index("_letters")).to_numpy(zero_copy_only=False)
                    best = p.argmax(axis=1)
                    lang = [net.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, p.max(axis=1), 0.0)
                cols = [s.column(s.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` (a language of the network) and ``score``, its probability.

    Texts that are null or hold no letter, and all texts where there is no network, get ``und`` with score
    0.  Every row is judged by its own text alone, read whole, so repeated rows get the same answer; of equal
    probabilities the first language in code-point order is taken.  Columns of these names are replaced.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "_letters")]
    df = docs.select(*own).withColumn("text", F.col("text").cast("string"))
    schema = tx.extended(df.schema, lang_pred="string", score="double")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    return df.select("*", letters).transform(tx.arrow, _predicted(net, own), schema)
