import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from conftest import SF001
from tsfolds.llm import packing
from tsfolds.llm import queries as Q

PATH = public_tokenizers.path(packing.VOCABULARY)


def check(rows, texts, size):
    """Pieces against the plain tokenizer, places without gaps; returns the number of sequences."""
    tok = Tokenizer.from_file(PATH)
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == texts.keys()
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
        assert sum(p.length for p in pieces) == len(ids)
        assert all(p.length == size for p in pieces[1:]) and (len(pieces) == 1 or len(ids) > size)
        for p in pieces:
            part = np.array(ids[p.start : p.start + p.length], "<u4")
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
    for places in seq.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(seq)


def test_query(spark):
    rows = Q.op9_best_fit_packing(spark, SF001).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    n = check(rows, texts, 1024)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_odd_texts(spark):
    texts = ["", None, " ", "  a", "a  b", "a \n b", "a\n b", "a \nb", "tail ", "tail\n", "\n\n", "it's we'll <|endoftext|> x", "a <|endoftext|> b", "é ü x  y", "x\t\ty \t z", "12 345,6 7!", "word " * 700]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank", "3 as block")
    check(packing.pack(df, PATH, size=64).collect(), dict(rows), 64)


def test_empty_table_null_and_repeated_ids(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = packing.pack(df, PATH).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 3)] * 2 + [("None", 3)] * 2
    assert len({(r.sequence_id, r.offset) for r in got}) == 4


def best_fit(hist, size):
    """Sequences that best-fit decreasing takes, item by item."""
    gaps, n = defaultdict(int), 0
    for length in sorted(hist, reverse=True):
        for _ in range(hist[length]):
            gap = min((g for g in gaps if g >= length and gaps[g]), default=None)
            if gap is None:
                n, gap = n + 1, size
            else:
                gaps[gap] -= 1
            gaps[gap - length] += 1
    return n


def test_plan_serves_each_length_and_fills(spark):
    rnd = random.Random(2)
    for hist in ({}, {5: 3}, {100: 1}, {60: 7, 40: 9, 20: 3, 33: 30, 34: 30}, {rnd.randrange(1, 101): rnd.randrange(1, 500) for _ in range(60)}):
        used = defaultdict(int)
        sequences = 0
        for lengths, times in packing.plan(hist, 100):
            assert sum(lengths) <= 100 and times > 0
            sequences += times
            for n in lengths:
                used[n] += times
        assert used == hist
        assert sequences <= 1.005 * best_fit(hist, 100) + 1


def test_fast_and_own_library_agree():
    tok, encode = Tokenizer.from_file(PATH), packing._encoder(PATH)
    rnd = random.Random(9)
    letters = "abcXYZ'\n\r\t   .,!?019&%#*|-_<>éèñüßÖªº²½¿÷" + "".join(map(chr, range(0xA1, 0x250, 7)))
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 80))) for _ in range(3000)]
    texts += ["we'll they're I'm it's 'd 've", "a\u00a0b \u2003 c", "\x1c\x85 x", "日本語 text", "x <|endoftext|> y", "<|", "𝒳 ٣ ⅷ"]
    for t, got in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t
