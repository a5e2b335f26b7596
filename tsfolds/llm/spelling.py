"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

1. Words are runs of Latin letters, counted over all texts (a document counts its own words first, a task
   those of its documents, then Spark).
2. A word is the vector of its letter counts.  One replaced letter takes one from a count and adds one
   to another (L1 distance 2), one inserted letter adds one (distance 1).  So the words near a word lie in the trees of
   its own length and of the next one, in boxes reached by at most one step down and one step up.
3. The top of a length's k-d tree comes from a bounded sample of words (``SAMPLE``); its leaves are
   the cells that words and searches are dealt to.  A word is stored in one cell and searched for in all cells
   that its box query reaches, each with the steps already taken.  A cell grows the rest of its tree while the
   searches run down it, and compares letters in order only in the leaves.
4. A replacement is searched from the word with the smaller of the two letters, an insertion from the
   shorter word: each pair is met once.

A cell's size depends on the sample only through the balance of the tree; every word is indexed and every box that can
hold a near word is searched, so no pair is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfolds.llm import text as tx
from tsfolds.session import cut

MIN_LENGTH, MIN_COUNT = 5, 3
SAMPLE = 100_000  # words that the tops of the trees are grown from
CELL = 8192  # words of a cell
LEAF = 16  # words of a leaf inside a cell
FREE, NEVER = -1, -2  # a step not yet taken, a step that must not be taken
HELD = 1 << 16  # distinct words counted in a task before they are handed on
BLOCK = 1 << 21  # letters compared at once

_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")  # U+00C0 to U+00FF are the bytes C3 80 to C3 BF
_DIM = np.zeros(256, np.int64)
_DIM[ord("a") : ord("z") + 1] = np.arange(26)
_DIM[0xC0:0x100] = np.arange(26, 90)
DIMS = 90

_PARTIAL = "word string, n long, n_near long, near_n long, near string"


# --------------------------------------------------------------------------- words


def _counted(min_length: int, typo_every: int | None):
    """(word, n) of the texts of a task; with ``typo_every`` some runs lose a letter first (see ``words``)."""

    def out(seen):
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    def run(it):
        seen: Counter = Counter()
        for batch in it:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in Counter(_RUN.findall(text.encode().lower())).items():
                    if len(w) < min_length:
                        continue
                    if typo_every is not None:
                        h = zlib.crc32(w, prefix)
                        if h % typo_every == 0:
                            letters = w.decode()
                            at = h % len(letters)
                            w = (letters[:at] + letters[at + 1 :]).encode()
                    if len(w) - w.count(b"\xc3") >= min_length:
                        seen[w] += n
                if len(seen) > HELD:
                    yield out(seen)
                    seen.clear()
        yield out(seen)

    return run


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int | None = None) -> DataFrame:
    """(word, n): runs ``[A-Za-z\\u00C0-\\u00FF]+`` of the texts, lower-cased in A-Z, of at least ``min_length`` letters and
    ``min_count`` occurrences over all documents.

    ``typo_every`` plants errors for tests and measurements: with h = crc32 of ``<doc_id>:<run>``, a run whose h it
    divides loses its letter h % length.  Null and empty texts have no words; a null doc_id counts as an
    empty string; repeated rows count again; texts are read whole; other columns are not looked at.
    """
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = base.transform(tx.arrow, _counted(min_length, typo_every), "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --------------------------------------------------------------------------- trees


def _letters(spelt: list[bytes], length: int) -> np.ndarray:
    """Latin-1 words as rows of letters, shorter ones filled with zeros."""
    return np.frombuffer(b"".join(w.ljust(length, b"\0") for w in spelt), np.uint8).reshape(len(spelt), length)


def _counts(letters: np.ndarray) -> np.ndarray:
    """Letter counts, a row per letter and a column per word."""
    n, length = letters.shape
    kind = np.uint8 if length < 255 else np.int32
    out = np.zeros((DIMS, n), kind)
    step = max(1, BLOCK // max(length, 1))
    for a in range(0, n, step):
        part = letters[a : a + step]
        row, col = np.nonzero(part)
        hits = np.bincount(_DIM[part[row, col]] * len(part) + row, minlength=DIMS * len(part))
        out[:, a : a + step] = hits.reshape(DIMS, len(part))
    return out


def _plane(counts: np.ndarray):
    """The (letter, count) that halves these words best; None where all vectors are equal."""
    n = counts.shape[1]
    at = counts.mean(axis=1).astype(np.int64)
    over = (counts > at[:, None]).sum(axis=1)
    best = int(np.minimum(over, n - over).argmax())
    return None if over[best] in (0, n) else (best, int(at[best]))


def _sides(count: np.ndarray, d: int, t: int, up: np.ndarray, down: np.ndarray):
    """What searches do at the plane ``letter d: at most t | more``: for each side the rows that
    go there and their steps.  A step, once taken, holds for its letter."""
    value = count.astype(np.int64) + (up == d) - (down == d)
    still = (up != d) & (down != d)
    over = value > t
    lift = still & (value == t) & (up == FREE) & (down < d)
    drop = still & (value == t + 1) & (down == FREE) & ((up == FREE) | (up > d))
    low, high = np.flatnonzero(~over | drop), np.flatnonzero(over | lift)
    return (low, up[low], np.where(drop[low], d, down[low])), (high, np.where(lift[high], d, up[high]), down[high])


def _top(counts: np.ndarray, cells: float):
    """A tree of about ``cells`` leaves: nested (letter, count, low, high), leaves are numbers."""
    n, leaves = counts.shape[1], 0

    def grow(rows, want):
        nonlocal leaves
        plane = _plane(counts[:, rows]) if want > 1 and len(rows) > 1 else None
        if plane is None:
            leaves += 1
            return leaves - 1
        over = counts[plane[0], rows] > plane[1]
        parts = [rows[~over], rows[over]]
        return (*plane, *(grow(p, want * len(p) / len(rows)) for p in parts))

    return grow(np.arange(n), cells), leaves


def tops(sample: list[str], total: int, cell: int) -> tuple[dict, int]:
    """Tree tops by word length from a sample of ``total`` words, and the number of their leaves."""
    by: dict[int, list[bytes]] = {}
    for w in sample:
        by.setdefault(len(w), []).append(w.encode("latin-1"))
    trees, cells = {}, 0
    for length, some in sorted(by.items()):
        want = len(some) / len(sample) * total / cell
        if want > 1:
            tree, leaves = _top(_counts(_letters(some, length)), want)
            trees[length] = tree
            cells += leaves
        else:
            cells += 1
    return trees, cells


def _visits(tree, counts: np.ndarray, up: int, down: int):
    """(leaf, words, steps up, steps down) for each leaf that a box query reaches."""
    n = counts.shape[1]
    stack = [(tree, np.arange(n), np.full(n, up, np.int64), np.full(n, down, np.int64))]
    while stack:
        node, rows, up_, down_ = stack.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            yield node, rows, up_, down_
            continue
        d, t, *kids = node
        for kid, (keep, u, v) in zip(kids, _sides(counts[d, rows], d, t, up_, down_), strict=True):
            stack.append((kid, rows[keep], u, v))


def _dealt(trees):
    """Rows (cell, home, word, n, up, down): each word at home in its cell, and in the cells its searches reach."""

    def run(it):
        for batch in it:
            spelt = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            size = np.array([len(w) for w in spelt], np.int64)
            parts = []
            for length in np.unique(size).tolist():
                rows = np.flatnonzero(size == length)
                counts = _counts(_letters([spelt[i] for i in rows], length))
                # at home; replaced letters among words of this length; an inserted letter among those of the next
                for at, up, down in ((length, NEVER, NEVER), (length, FREE, FREE), (length + 1, FREE, NEVER)):
                    for leaf, of, u, v in _visits(trees.get(at, 0), counts, up, down):
                        parts.append((np.full(len(of), at << 32 | leaf), np.full(len(of), up == NEVER), rows[of], u, v))
            if not parts:
                continue
            cell, home, of, up, down = (np.concatenate(x) for x in zip(*parts, strict=True))
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(home), batch.column(0).take(of), batch.column(1).take(of), pa.array(up.astype(np.int16)), pa.array(down.astype(np.int16))],
                ["cell", "home", "word", "n", "up", "down"],
            )

    return run


# --------------------------------------------------------------------------- cells


def _one_edit(x: np.ndarray, y: np.ndarray, shorter: np.ndarray):
    """Pairs (row of x, row of y) one edit apart.  Rows of x marked ``shorter`` lack one letter of y's length; the
    others are replaced letter by letter, and then x holds the smaller letter."""
    length = y.shape[1]
    out_i, out_j = [], []
    step = max(1, BLOCK // max(1, len(y) * length))
    for rows, insert in ((np.flatnonzero(~shorter), False), (np.flatnonzero(shorter), True)):
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            p = x[part][:, None, :]
            if insert:
                # left of the first difference all agree; right of it, one place on, all must
                left, right = p[:, :, :-1] != y[:, :-1], p[:, :, :-1] != y[:, 1:]
                first = np.where(left.any(axis=2), left.argmax(axis=2), length - 1)
                last = np.where(right.any(axis=2), length - 2 - right[:, :, ::-1].argmax(axis=2), -1)
                i, j = np.nonzero(first > last)
            else:
                i, j = np.nonzero(((p != y).sum(axis=2) == 1) & ((p < y).sum(axis=2) == 1))
            out_i.append(part[i])
            out_j.append(j)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64),) * 2


def _pairs(home: np.ndarray, asked: np.ndarray, up: np.ndarray, down: np.ndarray, shorter: np.ndarray, leaf: int):
    """Near pairs (row of asked, row of home) of a cell: the tree grows under the searches."""
    of_home, of_asked = _counts(home), _counts(asked)
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stack = [(np.arange(len(home)), np.arange(len(asked)), up, down)]
    while stack:
        h, q, u, v = stack.pop()
        if not len(h) or not len(q):
            continue
        plane = _plane(of_home[:, h]) if len(h) > leaf else None
        if plane is None:
            i, j = _one_edit(asked[q], home[h], shorter[q])
            out_i.append(q[i])
            out_j.append(h[j])
            continue
        d, t = plane
        over = of_home[d, h] > t
        for side, (keep, u_, v_) in zip((h[~over], h[over]), _sides(of_asked[d, q], d, t, u, v), strict=True):
            stack.append((side, q[keep], u_, v_))
    return np.concatenate(out_i), np.concatenate(out_j)


def _searched(leaf: int):
    """One cell: a row for each word at home there and for each word found near one, with the number of
    near words met here and the best of them (largest n, then the least word)."""

    def run(table: pa.Table) -> pa.Table:
        at_home = table.column("home").to_numpy()
        word, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        spelt = [w.encode("latin-1") for w in word]
        h, q = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        length = table.column("cell")[0].as_py() >> 32
        home, asked = _letters([spelt[i] for i in h], length), _letters([spelt[i] for i in q], length)
        up, down = (table.column(c).to_numpy().astype(np.int64)[q] for c in ("up", "down"))
        shorter = np.array([len(spelt[i]) < length for i in q], bool)
        i, j = _pairs(home, asked, up, down, shorter, leaf)
        i, j = q[i], h[j]
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        # a word may be here twice, at home and asked for: count both under one row
        name, of = np.unique(np.array(spelt, "S") if spelt else np.zeros(0, "S1"), return_inverse=True)
        size = np.zeros(len(name), np.int64)
        size[of] = n
        stored = np.zeros(len(name), bool)
        stored[of[h]] = True
        a, b = of[a], of[b]
        order = np.lexsort((b, -size[b], a))
        a, b = a[order], b[order]
        first = np.ones(len(a), bool)
        first[1:] = a[1:] != a[:-1]
        best = np.full(len(name), -1)
        best[a[first]] = b[first]
        count = np.bincount(a, minlength=len(name))
        rows = np.flatnonzero(stored | (count > 0))
        names = [x.decode("latin-1") for x in name.tolist()]
        met = best[rows] >= 0
        return pa.table(
            {
                "word": pa.array([names[r] for r in rows], pa.string()),
                "n": pa.array(size[rows]),
                "n_near": pa.array(count[rows].astype(np.int64)),
                "near_n": pa.array(size[best[rows]], mask=~met),
                "near": pa.array([names[b] if b >= 0 else None for b in best[rows]], pa.string()),
            }
        )

    return run


def variants(counted: DataFrame, factor: int = 2, cell: int = CELL, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``counted`` (word, n; distinct words of Latin letters).

    Two words are near if one code point inserted, deleted or replaced turns one into the other; ``n_near``
    counts them.  A word's form is its near word of largest n (ties: the least in code-point order) if that n is at
    least ``factor`` times its own, else null; root follows the forms to the last one (the word itself if it has none).
    No words give no rows.  All words of equal letter counts share a leaf, however many: they are compared in
    blocks.
    """
    counted = cut(counted.select("word", F.col("n").cast("long").alias("n")))
    total = counted.count()
    share = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(total, 1)))
    trees, cells = tops(sorted(r.word for r in counted.where(share).select("word").collect()), total, cell)
    dealt = counted.transform(tx.arrow, _dealt(trees), "cell long, home boolean, word string, n long, up short, down short")
    # as many partitions as cells, so that cells, small in bytes and dear in time, are not put together
    met = dealt.repartition(max(1, cells), "cell").groupBy("cell").applyInArrow(_searched(leaf), _PARTIAL)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), "near"))).alias("best")
    word = met.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    known = -F.col("best.m") >= factor * F.col("n")
    word = cut(word.select("word", "n", "n_near", F.when(known, F.col("best.near")).alias("form"), F.when(known, -F.col("best.m")).alias("form_n")))
    return _rooted(word).select("word", "form", "root", "n", "n_near", "form_n")


def _rooted(word: DataFrame) -> DataFrame:
    """``word`` with ``root``, the end of each chain of forms, by pointer doubling: n at least doubles along
    a chain, so chains are short and end."""
    to = word.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        to = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return word.join(to, "word", "left").withColumn("root", F.coalesce("root", "word"))
