import hashlib
import itertools
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from conftest import SF001
from tsfolds.llm import pieces
from tsfolds.llm import queries as Q

PATH = public_tokenizers.path(pieces.VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_query_against_the_library(spark, library):
    got = {r.doc_id: r for r in Q.op8_sentencepiece(spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text)
        r = got[d.doc_id]
        assert r.n_ids == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.round_trip


def test_odd_texts_rare_words_and_long_words(spark, vocabulary, library):
    rnd = random.Random(6)
    texts = ["", None, " ", "   ", "a", " a  b   c ", "x\ny\n\n z\t", "日本語 テスト 𝒳😀", "\x00\x01", "naïve café", "ab" * 300, "the" * 40, "a" * 500]
    texts += ["".join(rnd.choice("abcdeth in▁é\n"[:11]) for _ in range(60)) for _ in range(40)]
    texts += [" ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(1, 20))) for _ in range(30)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "twice"), (0, "twice"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as d", "2 as rest", "'x' as word")
    for hot in (0, 5, 10**6):
        got = pieces.decode(pieces.encode(df, vocabulary, hot=hot), vocabulary).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows)
        for r in got:
            assert r.ids == (library.encode(r.text) if r.text else []) and r.decoded == (r.text or "").replace(pieces.MARK, " ") and r.rest == 2
    assert pieces.encode(df.limit(0), vocabulary).collect() == []


def test_viterbi_fold_of_a_unigram_table(spark):
    rnd = random.Random(8)
    table = {w: -rnd.random() * 10 for n in (1, 2, 3) for w in map("".join, itertools.product("ab", repeat=n)) if rnd.random() < 0.8 or n == 1}
    rows = [(p, 300 + i, s) for i, (p, s) in enumerate(table.items())]
    vocabulary = pieces.Vocabulary(pieces.UNIGRAM, rows, list(range(256)), [])
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9))) for _ in range(60)] + ["aéb"]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string").withColumn("n", F.lit(1))

    def best(word):
        found = []
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
            parts = [word[a:b] for a, b in zip(at, at[1:])]
            if all(p in table or len(p) == 1 for p in parts):
                found.append((sum(table.get(p, pieces.UNKNOWN) for p in parts), parts))
        return max(found)[1]

    ids = dict((p, i) for p, i, _ in rows)
    for long in (48, 3):
        for r in pieces.encode_words(df, vocabulary, long=long).collect():
            want = [i for p in best(r.word) for i in ([ids[p]] if p in ids else p.encode())]
            assert [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)] == want


def test_lattice_fold_equals_merging_one_by_one():
    rnd = random.Random(9)
    for kind in (pieces.BPE, pieces.UNIGRAM):
        for turn in range(30):
            table = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 6))) for _ in range(40)] + ["a", "b"][: turn % 3]
            rows = [(p, 300 + i, -float(rnd.randrange(8) if kind == pieces.BPE else rnd.random())) for i, p in enumerate(dict.fromkeys(table))]
            vocabulary = pieces.Vocabulary(kind, rows, list(range(256)), [])
            words = ["".join(rnd.choice("abcé😀"[: 3 + 2 * (turn % 2)]) for _ in range(rnd.randrange(1, 30))) for _ in range(50)]
            ids = pieces._long_word(vocabulary)
            assert pieces._Lattice(vocabulary).encoded(words) == [b"".join(i.to_bytes(4, "little") for i in ids(w)) for w in words]
    assert pieces._Lattice(vocabulary).encoded([]) == []


def test_no_row_is_a_substring(spark, vocabulary):
    words = spark.createDataFrame([("▁lattice", 3)], "word string, n long")
    plan = pieces.encode_words(words, vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_no_row_of_a_word_goes_to_its_text(spark, vocabulary):
    """Texts are not shuffled, nor rows for the words in them: words without a place in the dictionary are encoded where they stand."""
    df = spark.createDataFrame([(1, "some words, some rare"), (2, None)], "doc_id long, text string")
    for hot in (0, 10):
        plan = pieces.encode(df, vocabulary, hot=hot)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan and "Generate" not in plan and "Aggregate" not in plan


def test_words_of_a_slice_are_those_of_the_pattern():
    rnd = random.Random(10)
    texts = ["", None, "\n", " ", "▁", "\n\n ▁ a", "a▁▁b \n", *("".join(rnd.choice("ab ▁\né😀") for _ in range(rnd.randrange(12))) for _ in range(300))]
    code, start, first = pieces._text_words(texts)
    words = ["".join(map(chr, code[i:j])) for i, j in zip(start, start[1:])]
    want = [re.findall(pieces._WORDS, pieces.MARK + t.replace(" ", pieces.MARK)) if t else [] for t in texts]
    assert [words[i:j] for i, j in zip(first, first[1:])] == want
    assert pieces._text_words([None, ""])[2].tolist() == [0, 0, 0]


def test_slices_smaller_than_a_text_and_long_words_between(spark, vocabulary, library, monkeypatch):
    rnd = random.Random(11)
    texts = [" ".join("".join(rnd.choice("etaoin é") for _ in range(rnd.choice([3, 9, 70]))) for _ in range(20)) for _ in range(12)]
    monkeypatch.setattr(pieces, "PLACES", 64)
    coder = pieces._Coder(vocabulary, pieces.LONG)
    code, start, _ = pieces._text_words(texts)
    flat, n = coder.encoded(code, start[1:] - start[:-1])
    assert flat.tolist() == [i for t in texts for i in library.encode(t)] and n.sum() == len(flat)
    assert coder.encoded(code[:0], start[:0])[0].tolist() == []
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id string, text string")
    assert {r.doc_id: r.ids for r in pieces.encode(df, vocabulary, hot=7).collect()} == {str(i): library.encode(t) for i, t in enumerate(texts)}


def test_decode_of_null_ids_and_broken_bytes(spark, vocabulary):
    rows = [(1, None), (2, []), (3, [vocabulary.bytes_[0xC3]]), (4, [vocabulary.bytes_[0xC3], vocabulary.bytes_[0xA9]]), (5, [vocabulary.bytes_[0x20]] * 2)]
    df = spark.createDataFrame(rows, "d long, ids array<int>").coalesce(1)
    assert {r.d: r.decoded for r in pieces.decode(df, vocabulary).collect()} == {1: None, 2: "", 3: "\ufffd", 4: "é", 5: " "}
