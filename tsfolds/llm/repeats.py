"""Substring dedup: words covered by a window of words that also starts elsewhere.

Method: prefix-partitioned suffix trees, cut off at the window's depth.

0. A row's node is its doc_id and a hash of its text (two hashes of the text where it has no doc_id).
   Equal texts are one document: all words of theirs that fill a window go, the node with the least
   id stands for them all, and its leaves need no marks.
1. Pruning.  Equal windows hold equal least-hash ``GRAM``-word runs at equal places
   (minimizers), so only windows whose minimizer occurs twice in the corpus can repeat.
   About one word in twelve is such an anchor; only anchors are shuffled.
2. The remaining suffixes are partitioned by a variable-length prefix (it ends at the
   first word with a hash in one of eight classes, after ``PREFIX`` words at least, and at
   the window's depth at most).  Sorting a partition by (prefix, hash of the whole window)
   puts the leaves of each tree node beside each other; a node of the window's depth with
   two leaves or more is a repeat, and all its leaves are marked.
3. Marks return to their documents.

Both exchanges combine first: what repeats inside a task's slice of text is marked there
and sends one leaf on, so a passage held by a third of all documents does not meet in one
task, and sorted runs are streamed, never gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfolds.llm import text as tx
from tsfolds.llm.graph import copies_join

GRAM = 12
PREFIX = 4
SINGLE, LEAF, MARKED = 0, 1, 2  # alone in its slice; stands for leaves marked in its slice; marked

_ROWS = "k int, a long, b int, doc long, h long, pos long, kind byte"
_NODE = ["doc", "h"]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (the leftmost of equal ones) in each run of ``width`` values."""
    v, p, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        right = v[step:] < v[:-step]
        p = np.where(right, p[step:], p[:-step])
        v = np.where(right, v[step:], v[:-step])
        have += step
    return p


def _windows(w: tx.Words, window: int, gram: int):
    """Starts of windows inside one document, word hashes, hashes of grams, each window's anchor."""
    h = w.hashes()
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), h, np.zeros(0, tx.U), np.zeros(0, np.int32)
    inside = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    grams = tx.windows_hash(h, gram)
    return inside, h, grams, _least(grams, window - gram + 1)[inside]


def _half(x: np.ndarray) -> np.ndarray:
    return (tx.mix(x) >> tx.U(32)).astype(np.uint32).view(np.int32)


def _combine(k, a, b, doc, h, pos, runs: bool, whole=None):
    """Mark what repeats among these rows; one leaf of each repeat and all singles go on.
    ``runs``: marked neighbours become one row, from ``pos`` over ``k`` places.  Rows that are
    ``whole`` go without marks: they are leaves."""
    order = np.lexsort((b, a))
    k, a, b, doc, h, pos = k[order], a[order], b[order], doc[order], h[order], pos[order]
    whole = np.zeros(len(a), bool) if whole is None else whole[order]
    same = np.zeros(len(a) + 1, bool)
    same[1:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twin, one = same[:-1] | same[1:], np.flatnonzero(~same[:-1])
    two = np.flatnonzero(twin & ~whole)
    if runs:
        two = two[np.lexsort((pos[two], h[two], doc[two]))]
    d, e, p = doc[two], h[two], pos[two]
    head = np.ones(len(two), bool)
    head[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1]) | (p[1:] != p[:-1] + 1) if runs else True
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, len(two))).astype(np.int32)
    d, e, p = d[at], e[at], p[at]
    spread = tx.mix(d.view(tx.U) ^ e.view(tx.U))
    rows = [(k[one], count), (a[one], tx.signed(spread)), (b[one], _half(spread)), (doc[one], d), (h[one], e), (pos[one], p)]
    cols = [np.concatenate(x) for x in rows]
    cols.append(np.concatenate([np.where(twin[one] | whole[one], LEAF, SINGLE), np.full(len(at), MARKED)]).astype(np.int8))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "a", "b", "doc", "h", "pos", "kind"])


def _nodes(batch: pa.RecordBatch, row: np.ndarray) -> list[np.ndarray]:
    """doc and h of the given rows."""
    return [np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), np.int64)[row] for c in _NODE]


def _copied(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("copied")).fill_null(False).to_numpy(zero_copy_only=False), bool)


def _anchors(window: int, gram: int):
    def run(it):
        for batch in it:
            for s in tx.slices(batch, "text"):
                w = tx.split(s.column(s.schema.get_field_index("text")))
                _, _, grams, at = _windows(w, window, gram)
                if not len(at):
                    continue
                pick = np.zeros(len(grams), bool)
                pick[at] = True
                at = np.flatnonzero(pick)
                h = tx.signed(grams[at])
                yield _combine(_half(grams[at]), h, np.zeros(len(h), np.int32), *_nodes(s, w.doc[at]), h, False)

    return run


def _prefix(h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Hash of the variable-length prefix of the suffix at each start."""
    stop = np.flatnonzero((h >> tx.U(61)) == 0) + 1
    i = np.searchsorted(stop, starts + PREFIX)
    end = np.append(stop, 1 << 62)[i]
    return _half(tx.ranges_hash(h, starts, np.minimum(end, starts + window), "word2"))


def _suffixes(window: int, gram: int):
    def run(it):
        for batch in it:
            for s in tx.slices(batch, "text"):
                w = tx.split(s.column(s.schema.get_field_index("text")))
                starts, h, grams, at = _windows(w, window, gram)
                known = s.column(s.schema.get_field_index("found")).flatten().to_numpy(zero_copy_only=False)
                if not len(at) or not len(known):
                    continue
                starts = starts[np.isin(grams[at], known.astype(np.int64).view(tx.U))]
                a = tx.signed(tx.ranges_hash(h, starts, starts + window, "word"))
                b = _half(tx.ranges_hash(tx.mix(h + tx.U(1)), starts, starts + window, "word2"))
                doc = w.doc[starts]
                yield _combine(_prefix(h, starts, window), a, b, *_nodes(s, doc), starts - w.first[doc], True, _copied(s)[doc])

    return run


def _marks(it):
    """Rows sorted by (k, a, b): pass on the marked ones, and the singles of nodes with two leaves or more."""
    last = None  # the last leaf so far: its node, kind, document, place, and whether it had a twin
    for batch in it:
        if not batch.num_rows:
            continue
        k, a, b, doc, h, pos, kind = (np.asarray(c) for c in batch.columns)
        leaf = kind != MARKED
        out = [np.stack([doc[~leaf], h[~leaf], pos[~leaf], k[~leaf].astype(np.int64)])]
        k, a, b, doc, h, pos, kind = (x[leaf] for x in (k, a, b, doc, h, pos, kind))
        if len(a):
            same = np.zeros(len(a) + 1, bool)
            same[1:-1] = (k[1:] == k[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            if last is not None and last[0] == (k[0], a[0], b[0]):
                same[0] = True
                if not last[3] and last[1] == SINGLE:
                    out.append(np.array([[*last[2], 1]], np.int64).T)
            twin = (same[:-1] | same[1:]) & (kind == SINGLE)
            out.append(np.stack([doc[twin], h[twin], pos[twin], np.ones(twin.sum(), np.int64)]))
            last = ((k[-1], a[-1], b[-1]), kind[-1], (doc[-1], h[-1], pos[-1]), bool(same[-2]))
        doc, h, pos, n = np.concatenate(out, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h), pa.array(pos), pa.array(n.astype(np.int32))], ["doc", "h", "pos", "n"])


def _repeated(rows: DataFrame) -> DataFrame:
    """(doc, pos, n) of all rows whose node occurs twice; nodes are dealt by ``k`` and streamed in order."""
    return rows.repartition(F.when(F.col("kind") == MARKED, F.col("b")).otherwise(F.col("k"))).sortWithinPartitions("k", "a", "b").transform(tx.arrow, _marks, "doc long, h long, pos long, n int")


def _apply(window: int):
    def run(it):
        for batch in it:
            for s in tx.slices(batch, "text"):
                get = lambda c, s=s: s.column(s.schema.get_field_index(c))
                w = tx.split(get("text"))
                found, whole = get("found"), _copied(s)
                cover = np.zeros(len(w.starts) + window + 1, np.int32)
                lens = np.diff(np.asarray(found.offsets)) if len(found) else np.zeros(0, int)
                doc = np.repeat(np.arange(len(found)), np.where(np.asarray(found.is_valid()), lens, 0))
                runs = found.flatten()
                start = w.first[doc] + runs.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                end = np.minimum(start + runs.field(1).to_numpy(zero_copy_only=False) + window - 1, w.first[doc + 1])
                fits = end - start >= window
                np.add.at(cover, start[fits], 1)
                np.add.at(cover, end[fits], -1)
                every = np.flatnonzero(whole & (np.diff(w.first) >= window))
                np.add.at(cover, w.first[every], 1)
                np.add.at(cover, w.first[every + 1], -1)
                gone = np.cumsum(cover)[: len(w.starts)] > 0
                n_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
                raw = w.data.tobytes()
                texts = []
                for i in range(s.num_rows):
                    words = raw[w.off[i] : w.off[i + 1]].split()
                    if n_gone[i]:
                        keep = ~gone[w.first[i] : w.first[i + 1]]
                        words = [x for x, k in zip(words, keep, strict=True) if k]
                    texts.append(b" ".join(words).decode("utf-8", "replace"))
                cols = [get("text"), get("rest"), pa.array(np.diff(w.first), pa.int64()), pa.array(n_gone, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["text", "rest", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = GRAM) -> DataFrame:
    """All columns of ``docs`` and ``n_words``, ``n_removed``, ``kept_text``: the words of the text without those
    that lie in a run of ``window`` words which also starts elsewhere (same document included), joined by
    one space.  Columns of these names are replaced.

    Nulls and empty texts: no words, an empty ``kept_text``.  Texts shorter than the window keep all
    words.  Each row goes by its own text and counts as an occurrence, also where rows share a ``doc_id``
    or have none.  Other columns pass through.
    """
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    others = [c for c in own if c != "text"]
    text = F.col("text").cast("string")
    # without doc_id: bits of a second hash and the length
    nameless = F.shiftleft(F.hash(text).cast("long"), 31).bitwiseXOR(F.coalesce(F.length(text), F.lit(0)).cast("long"))
    node = [F.coalesce(F.col("doc_id").cast("long"), nameless).alias("doc"), F.xxhash64(text).alias("h")]
    base = docs.select(*node, text.alias("text"), F.struct(*others).alias("rest"))
    same = ["h", "h2", "size"]
    keys = base.select("doc", "h", F.hash("text").alias("h2"), F.length("text").alias("size"))
    groups = keys.groupBy(*same).agg(F.min("doc").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    copied = copies_join(keys, groups, same, "doc").where("copies is not null")
    copied = copied.groupBy(*_NODE).agg(F.max(F.col("doc") == F.col("least")).alias("stands"), F.lit(True).alias("copied"))
    # node, text and rest go to Python together each time, so that one exchange of the texts serves all three
    rows = base.join(copied, _NODE, "left")
    rep = rows.where(F.coalesce("stands", F.lit(True))).select(*_NODE, "text", "rest", "copied")
    anchors = _repeated(rep.transform(tx.arrow, _anchors(window, gram), _ROWS))
    known = anchors.groupBy(*_NODE).agg(F.collect_set("pos").alias("found"))
    suffixes = rep.join(known, _NODE).select(*_NODE, "text", "rest", "copied", "found").transform(tx.arrow, _suffixes(window, gram), _ROWS)
    marks = _repeated(suffixes).groupBy(*_NODE).agg(F.collect_list(F.struct("pos", "n")).alias("found"))
    out = rows.join(marks, _NODE, "left").select(*_NODE, "text", "rest", "copied", "found")
    schema = tx.extended(base.select("text", "rest").schema, n_words="long", n_removed="long", kept_text="string")
    out = out.transform(tx.arrow, _apply(window), schema)
    named = {"text": F.col("text"), **{c: F.col("rest").getField(c).alias(c) for c in others}}
    return out.select(*(named[c] for c in own), "n_words", "n_removed", "kept_text")
