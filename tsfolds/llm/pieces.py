"""SentencePiece encoding and decoding as a relational lattice.

1. A text becomes words: spaces turn into the piece mark, and since no piece holds a mark after another
   character, a word (marks and what follows them) is encoded by itself.  Words are counted over the
   corpus, grouped by word.
2. Lattice: the places of a batch of words walk a trie of the pieces together (the vocabulary goes to
   every task: its size does not grow with the data); an edge is a piece in a word.
3. Fold, for all words of a batch together.  For a unigram model it is Viterbi over positions.  A byte-pair
   model's own encoding is not a best path of piece scores, so there neighbours merge along the edges, each
   word its best first, as the model defines.
4. Ids return to the texts: the most frequent words (at most ``HOT``) are encoded once for the corpus and go
   to the tasks as a dictionary of bounded size; all others are encoded by lattice and fold once for the
   texts of a slice, where they stand, so that no row for a word of a text is shuffled.

Characters without a piece become byte pieces.  Decoding inverts encoding exactly for
models with the identity normaliser.
"""

from __future__ import annotations

import re
import sys
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfolds.llm import text as tx
from tsfolds.session import ensure_checkpoint_dir

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
HOT = 200_000  # words in the dictionary that goes to all tasks, at most; none of over ``LONG`` characters
LONG = 48  # characters; longer words are merged by a heap in Python: the fold takes a turn a merge
SLICE_BYTES = 1 << 20  # text of which the words are made distinct and encoded at once
SLICE_IDS = 1 << 18  # ids decoded at once
PLACES = 1 << 17  # characters of words that are folded at once (one longer word is folded alone)
NEVER = np.iinfo(np.int32).max
SINGLE = 1 << 30  # numbers of characters without a piece start here
UNKNOWN = -100.0  # score of a character without a piece in a unigram model


@dataclass
class Vocabulary:
    kind: int
    rows: list[tuple[str, int, float]]  # (piece, id, score) of ordinary pieces
    bytes_: list[int]  # ids of the 256 byte pieces
    texts: list[bytes]  # what each id decodes to

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.rows), default=1)


def read_vocabulary(path: str) -> Vocabulary:
    """Read a model file.  Models that normalise, or hold user-defined pieces or pieces with a mark or line
    feed after another character, are refused: their words are not independent."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix:
        raise ValueError("only models with the identity normaliser and a dummy prefix")
    rows, byte_ids, texts = [], {}, []
    for i, p in enumerate(m.pieces):
        texts.append(b"")
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = i
            texts[i] = bytes([int(p.piece[3:5], 16)])
        elif p.type == 1:
            rows.append((p.piece, i, p.score))
            texts[i] = p.piece.replace(MARK, " ").encode()
        elif p.type not in (2, 3):
            raise ValueError(f"piece type {p.type}")
    if len(byte_ids) != 256 or any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", p, re.S) for p, _, _ in rows):
        raise ValueError("pieces cross words, or byte pieces are missing")
    return Vocabulary(m.trainer_spec.model_type, rows, [byte_ids[b] for b in range(256)], texts)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


_WORDS = f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n"


def _escaped(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))).otherwise("")


class _Lattice:
    """The vocabulary as sorted arrays: a trie of its pieces.

    Symbols are numbers: a piece by its place in ``vocabulary.rows``, a character without a piece by ``SINGLE`` and its code point."""

    def __init__(self, vocabulary: Vocabulary):
        pieces = [p for p, _, _ in vocabulary.rows]
        self.kind, self.longest = vocabulary.kind, vocabulary.longest
        self.ids = np.array([i for _, i, _ in vocabulary.rows], np.int64)
        self.scores = np.array([x for _, _, x in vocabulary.rows], float)
        # pieces of equal scores have one rank; the last, found by -1, is that of no piece
        self.rank = np.append(np.unique(-self.scores, return_inverse=True)[1], NEVER).astype(np.int32)
        nodes, ends = {"": 0}, {}
        for i, p in enumerate(pieces):
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
            ends[nodes[p]] = i
        self.ends = np.full(len(nodes), -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        steps = sorted(((nodes[p[:-1]] << 21) | ord(p[-1]), k) for p, k in nodes.items() if p)
        self.step_keys, self.step_to = (np.array(x, np.int64) for x in zip(*steps, strict=True))
        self.root = np.full(sys.maxunicode + 1, -1, np.int32)  # the first step, by character
        self.root[self.step_keys[self.step_keys >> 21 == 0]] = self.step_to[self.step_keys >> 21 == 0]
        self.bytes_ = np.array(vocabulary.bytes_, np.int64)

    @staticmethod
    def _look(keys, to, wanted):
        """The value of each wanted key, -1 where there is none."""
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, to[at], -1)

    def edges(self, code: np.ndarray, left: np.ndarray):
        """(from, to, piece) of every piece in the words: ``code`` are their characters one after the other, ``left`` counts
        those from a place to its word's end.  All places walk the trie together and stop where no piece goes on."""
        at, node = np.arange(len(code)), self.root[code].astype(np.int64)
        for k in range(1, self.longest + 1):
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                return
            piece = self.ends[node]
            yield at[piece >= 0], at[piece >= 0] + k, piece[piece >= 0]
            on = left[at] > k
            at, node = at[on], node[on]
            node = self._look(self.step_keys, self.step_to, (node << 21) | code[at + k])

    def fold(self, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, word) of each word's encoding, in order."""
        word = np.repeat(np.arange(len(size)), size)
        start = np.cumsum(size) - size
        left = (start + size)[word] - np.arange(len(code))
        if self.kind != UNIGRAM:
            return self._merges(code, size, word, start, left)
        sym = SINGLE + code
        for s, e, piece in self.edges(code, left):
            one = e - s == 1
            sym[s[one]] = piece[one]
        return self._viterbi(code, size, word, start, sym)

    def _merges(self, code, size, word, start, left):
        """Every word merges its neighbours of the best score, the leftmost of equal ones, until none makes a piece.  Two
        neighbours make a piece if an edge spans both.  Words of one length take their turns together, and words without
        a merge are done."""
        edge = np.full((len(code), self.longest + 1), -1, np.int32)  # the piece by its place and its length
        for s, e, piece in self.edges(code, left):
            edge[s, e - s] = piece

        def rank(place, length):
            return self.rank[edge[place, np.where(length <= self.longest, length, 0)]]

        first = np.ones(len(code), bool)  # places where a symbol starts
        for n in np.unique(size[size > 1]).tolist():
            at = start[size == n]
            # column n stands behind the word's end, and before its start
            after = np.tile(np.minimum(np.arange(1, n + 2, dtype=np.int32), n), (len(at), 1))
            before = np.tile(np.array([n, *range(n)], np.int32), (len(at), 1))
            best = np.full((len(at), n + 1), NEVER, np.int32)  # rank of what a symbol and the next one make
            best[:, : n - 1] = rank(at[:, None] + np.arange(n - 1), np.int64(2))
            while True:
                s = best.argmin(1)
                going = np.take_along_axis(best, s[:, None], 1)[:, 0] < NEVER
                if not going.any():
                    break
                if not going.all():
                    at, after, before, best, s = at[going], after[going], before[going], best[going], s[going]
                row = np.arange(len(at))
                gone = after[row, s]
                end = after[row, gone]
                first[at + gone] = False
                best[row, gone] = NEVER
                after[row, s] = end
                before[row, end] = s
                best[row, s] = rank(at + s, np.where(end < n, after[row, end] - s, 0))
                prior = before[row, s]
                inside = prior < n
                best[row, prior] = rank(at + np.where(inside, prior, 0), np.where(inside, end - prior, 0))
        s = np.flatnonzero(first)
        sym = edge[s, np.minimum(np.diff(np.append(s, len(code))), self.longest)].astype(np.int64)
        return np.where(sym >= 0, sym, SINGLE + code[s]), word[s]

    def _viterbi(self, code, size, word, start, sym):
        """The path of the greatest sum of scores through each word's edges (ties: the last piece that starts later)."""
        n = len(code)
        s, e, p = (np.concatenate(x) for x in zip((np.empty(0, int),) * 3, *self.edges(code, (start + size)[word] - np.arange(n)), strict=True))
        alone = np.flatnonzero(sym >= SINGLE)
        s, e, p = np.concatenate([s, alone]), np.concatenate([e, alone + 1]), np.concatenate([p, sym[alone]])
        score = np.full(len(p), UNKNOWN)
        score[p < SINGLE] = self.scores[p[p < SINGLE]]
        best, back, last = np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, np.int64)
        reach = e - start[word[s]]
        reached = np.zeros(n + 1)  # the best sum to the place, by its last character
        for k in range(1, int(size.max(initial=0)) + 1):
            x = np.flatnonzero(reach == k)
            into = np.where(s[x] == start[word[s[x]]], 0.0, reached[s[x] - 1]) + score[x]
            by = np.lexsort((s[x], into, e[x]))
            x, into = x[by], into[by]
            top = np.ones(len(x), bool)
            top[:-1] = e[x][1:] != e[x][:-1]
            at = e[x[top]] - 1
            reached[at], back[at], last[at] = into[top], s[x[top]], p[x[top]]
        found, at = [], (start + size - 1)[size > 0]
        while len(at):
            found.append((back[at], last[at]))
            at = back[at][back[at] > start[word[at]]] - 1
        if not found:
            return sym[:0], word[:0]
        at, p = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(at)
        return p[by], word[at[by]]

    def packed(self, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has; a character without a piece gives its bytes' ids."""
        sym, word = self.fold(code, size)
        known = sym < SINGLE
        width, ids = np.ones(len(sym), np.int64), np.empty(len(sym), np.int64)
        ids[known] = self.ids[sym[known]]
        raw = [chr(c).encode() for c in (sym[~known] - SINGLE).tolist()]
        width[~known] = [len(b) for b in raw]
        flat = np.repeat(ids, width)
        flat[np.repeat(~known, width)] = self.bytes_[np.frombuffer(b"".join(raw), np.uint8)]
        return flat.astype("<i4"), np.bincount(word, width, len(size)).astype(np.int64)

    def encoded(self, words: list[str]) -> list[bytes]:
        """Packed ids of words."""
        flat, n = self.packed(_codes("".join(words)).astype(np.int64), np.array([len(w) for w in words], np.int64))
        body, cuts = flat.tobytes(), np.append(0, np.cumsum(n)) * 4
        return [body[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _long_word(vocabulary: Vocabulary):
    """Ids of a long word: merges by a heap (byte pairs), or Viterbi over a table (unigram)."""
    import heapq

    score = {p: (i, s) for p, i, s in vocabulary.rows}

    def pieces(word: str) -> list[str]:
        n = len(word)
        if vocabulary.kind == UNIGRAM:
            best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
            for e in range(1, n + 1):
                for s in range(max(0, e - vocabulary.longest), e):
                    v = score[word[s:e]][1] if word[s:e] in score else UNKNOWN if e - s == 1 else None
                    if v is not None and best[s] + v >= best[e]:
                        best[e], back[e] = best[s] + v, s
            out, e = [], n
            while e:
                out.append(word[back[e] : e])
                e = back[e]
            return out[::-1]
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(s):
            m = end[s]
            if m < n and word[s : end[m]] in score:
                heapq.heappush(heap, (-score[word[s : end[m]]][1], s, end[m]))

        for s in range(n):
            offer(s)
        gone = [False] * n
        while heap:
            _, s, e = heapq.heappop(heap)
            if gone[s] or end[s] >= e or end[s] >= n or end[end[s]] != e:
                continue
            gone[end[s]] = True
            end[s] = e
            if e < n:
                before[e] = s
                offer(s)
            if before[s] >= 0:
                offer(before[s])
        out, s = [], 0
        while s < n:
            out.append(word[s : end[s]])
            s = end[s]
        return out

    def run(word: str) -> list[int]:
        out: list[int] = []
        for p in pieces(word):
            out += [score[p][0]] if p in score else [vocabulary.bytes_[b] for b in p.encode()]
        return out

    return run


class _Coder:
    """Encodes words in a task: by lattice and fold, long words one by one."""

    def __init__(self, vocabulary: Vocabulary, long: int):
        self.lattice, self.ids, self.long = _Lattice(vocabulary), _long_word(vocabulary), long

    def encoded(self, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has; ``code`` are the words' characters."""
        if not len(size):
            return np.empty(0, "<i4"), size
        start, flats, counts = np.append(0, np.cumsum(size)), [], []
        # runs of words: each long one by itself, the others until they hold about ``PLACES`` characters
        alone = size > self.long
        run = np.cumsum(alone | np.append(False, alone[:-1]))
        cut = np.flatnonzero(np.diff(run, prepend=-1) | np.diff(start[:-1] // PLACES, prepend=-1))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(size)], strict=True):
            part = code[start[i] : start[j]]
            if alone[i]:
                flat = np.array(self.ids(part.astype("<u4").tobytes().decode("utf-32-le")), "<i4")
                n = np.array([len(flat)])
            else:
                flat, n = self.lattice.packed(part.astype(np.int64), size[i:j])
            flats.append(flat)
            counts.append(n)
        return np.concatenate(flats), np.concatenate(counts)


def _coded(vocabulary: Vocabulary, long: int):
    """Ids packed."""

    def run(it):
        coder = _Coder(vocabulary, long)
        for b in it:
            words = b.column(0).to_pylist()
            flat, n = coder.encoded(_codes("".join(words)), np.array([len(w) for w in words], np.int64))
            ids = _binary(flat, np.append(0, np.cumsum(n))).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids], ["word", "n", "ids"])

    return run


_CODED = "word string, n long, ids binary"


def encode_words(words: DataFrame, vocabulary: Vocabulary, long: int = LONG) -> DataFrame:
    """(word, n, ids as little-endian 32-bit integers) for distinct words (word, n), as they are partitioned."""
    return words.select("word", F.col("n").cast("long").alias("n")).transform(tx.arrow, _coded(vocabulary, long), _CODED)


def _binary(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """Runs of 32-bit values (code points, ids) as Arrow binary; ``start`` also holds the end of the last."""
    off = pa.py_buffer(np.ascontiguousarray(start, np.int64) * 4)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start) - 1, [None, off, pa.py_buffer(np.ascontiguousarray(values))])


def _text_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts as ``_WORDS`` sees them, where words start (and the end), and the texts' first words (and the end)."""
    own = [MARK + t if t else "" for t in texts]
    code = _codes("".join(own)).copy()
    code[code == ord(" ")] = ord(MARK)
    off = np.append(0, np.cumsum([len(t) for t in own])).astype(np.int64)
    mark, line = code == ord(MARK), code == ord("\n")
    new = line | mark
    new[1:] &= line[1:] | ~mark[:-1]
    new[1:] |= line[:-1]
    new[off[:-1][off[:-1] < len(code)]] = True
    start = np.append(np.flatnonzero(new), len(code))
    return code, start, np.searchsorted(start, off)


def _assembled(vocabulary: Vocabulary, hot: pa.Table):
    """Batches with the ids of each text; ``hot`` are words (by their code points) and their packed ids."""

    def run(it):
        coder = _Coder(vocabulary, LONG)
        known, packed = (hot.column(c).combine_chunks() for c in ("word", "ids"))
        for batch in it:
            for b in tx.slices(batch, "text", SLICE_BYTES):
                code, start, text = _text_words(b.column(b.schema.get_field_index("text")).to_pylist())
                words = _binary(code, start).dictionary_encode()
                which = words.indices.to_numpy()
                of = pc.fill_null(pc.index_in(words.dictionary, value_set=known), -1).to_numpy()
                rare = words.dictionary.filter(pa.array(of < 0))
                letters = np.frombuffer(b"".join(rare.to_pylist()), "<u4")
                flat, n = coder.encoded(letters, pc.binary_length(rare).to_numpy() // 4)
                # the dictionary's ids, then the others', each word's at its places in the texts
                of = np.where(of >= 0, of, len(known) + np.cumsum(of < 0) - 1)
                ids = pa.concat_arrays([packed, _binary(flat, np.append(0, np.cumsum(n)))]).take(pa.array(of[which]))
                end = np.append(0, np.cumsum(pc.binary_length(ids).to_numpy() // 4))
                flat = np.frombuffer(ids.buffers()[2] or b"", "<i4")[: end[-1]]
                ids = pa.ListArray.from_arrays(pa.array(end[text], pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])
                pa.default_memory_pool().release_unused()  # the worker waits for the next step with what it does not give back

    return run


def _dictionary(texts: DataFrame, vocabulary: Vocabulary, hot: int) -> pa.Table:
    """(word as code points, ids) of the most frequent words of ``text``: at most ``hot``, none long."""
    words = F.regexp_extract_all(_escaped(F.col("text")), F.lit(_WORDS), F.lit(0))
    counts = texts.select(F.explode(words).alias("word")).where(F.length("word") <= LONG).groupBy("word").agg(F.count("*").alias("n"))
    # a written table in the shared folder: read for the least count and for the words; one that comes once shares nothing
    path = f"{ensure_checkpoint_dir(texts.sparkSession)}/words-{uuid.uuid4().hex}"
    counts.where("n > 1").write.parquet(path)
    counts = texts.sparkSession.read.parquet(path)
    least, left = 1, hot
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():  # rows: distinct counts
        left -= r["count"]
        if left < 0:
            least = r["n"] + 1
            break
    table = encode_words(counts.where(F.col("n") >= least), vocabulary).select("word", "ids").toArrow()  # at most ``hot`` rows
    own = table.column(0).to_pylist()
    word = _binary(_codes("".join(own)), np.append(0, np.cumsum([len(w) for w in own])))
    return pa.table({"word": word, "ids": table.column(1).cast(pa.large_binary())})


def encode(docs: DataFrame, vocabulary: Vocabulary, hot: int = HOT) -> DataFrame:
    """All columns of ``docs`` and ``ids``, the ids of each whole text (a column of that name is replaced).

    Null and empty texts have no ids.  Equal texts have equal ids; rows that share a doc_id or have none are
    encoded like others.
    """
    docs = docs.select(*(F.col(c).cast("string").alias(c) if c == "text" else c for c in docs.columns if c != "ids"))
    common = _dictionary(docs.select("text"), vocabulary, hot)
    return docs.transform(tx.arrow, _assembled(vocabulary, common), tx.extended(docs.schema, ids="array<int>"))


def decode(df: DataFrame, vocabulary: Vocabulary, name: str = "decoded") -> DataFrame:
    """``df`` with the text of its column ``ids`` as ``name``.  Null ids give null, no ids an empty text; byte
    pieces that are not valid UTF-8 together give replacement characters."""
    own = [c for c in df.columns if c != name]
    size = np.array([len(t) for t in vocabulary.texts], np.int64)
    raw, start = np.frombuffer(b"".join(vocabulary.texts), np.uint8), np.cumsum(size) - size

    def text(ids) -> pa.Array:
        """Texts of id lists: their pieces' bytes one after the other."""
        flat = ids.flatten().to_numpy()
        end = np.append(0, np.cumsum(size[flat]))
        data = raw[np.repeat(start[flat] - end[:-1], size[flat]) + np.arange(end[-1])].tobytes()
        cut = end[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()))].tolist()
        out = []
        for lo, hi, known in zip(cut[:-1], cut[1:], ids.is_valid().to_pylist(), strict=True):
            t = data[lo:hi].decode("utf-8", "replace") if known else None
            out.append(t[1:] if t and t[0] == " " else t)  # the dummy prefix
        return pa.array(out, pa.string())

    def run(it):
        for batch in it:
            ids = batch.column(batch.schema.get_field_index("ids"))
            before = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()))
            for i, j in tx.runs(before, SLICE_IDS):
                b = batch.slice(i, j - i)
                out = text(b.column(b.schema.get_field_index("ids")))
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in own], out], [*own, name])
                pa.default_memory_pool().release_unused()

    df = df.select(*own)
    return df.transform(tx.arrow, run, tx.extended(df.schema, **{name: "string"}))
