import hashlib
import re

from conftest import SF001, SF01
from tsfolds.llm import pii
from tsfolds.llm import queries as Q


def brute(text):
    """(start, kind, end) by the plain patterns."""
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p.lstrip("0")[:5] or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m.group())]
        odd = [x * 2 - 9 if x > 4 else x * 2 for x in d[-2::-2]]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(odd)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_query_against_the_patterns(spark):
    got = {r.doc_id: r for r in Q.op5_pii_crf(spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        spans, r = brute(d.text), got[d.doc_id]
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        added = len([s for s in r.spans.split(",") if s]) - len(spans)
        assert added == 0  # the generated prose holds none beyond the patterns


ODD = [
    "a@b.c@d.e x@y a.b@c-d.ef. @x.y é.f@g.h",
    "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255 1.2.3 1.1.1.256",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 0000 0000 0000 41111111111111114111111111111111",
    "+1 (389) 555-5010 +12 3 +1-2-3-4-5-6-7-8-9 ++44 20 7946 0958. +1234567890123456",
    "",
    "0" * 5000 + "1.1.1.1 1.1.1." + "0" * 5000 + "7 and 12" + "3" * 300 + ".1.1.1 5.5.5." + "9" * 4400,
    "é" * 5 + "+1 (389) 555-5010\n+1 (389) 555-5010",
]


def test_patterns_on_odd_texts():
    for t in ODD:
        assert pii.base_spans(t) == brute(t), t


def test_the_field_adds_what_the_patterns_miss(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = pii.fit(docs)
    rows = [
        (1, "for the thing ask anna [at] mail3 [dot] example [dot] com about it"),
        (2, "call (389) 555-5010 or the 4337.1665.9846.4399 of it"),
        (3, "The plain words at the end of the line are none. In 1999 there were 42 of 2000."),
        (4, None),
        (5, ""),
        (6, "x " * 20000 + "\n" + "mail a.b@c.de now"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pii", "'k' as kind")
    got = {r.doc_id: r for r in pii.find(df, model).collect()}
    found = {i: [(x.kind, (r.text or "")[x.start : x.end], x.base) for x in r.pii] for i, r in got.items()}
    assert found[1] == [("email", "anna [at] mail3 [dot] example [dot] com", False)]
    assert found[2] == [("phone", "(389) 555-5010", False), ("card", "4337.1665.9846.4399", False)]
    assert found[3] == found[4] == found[5] == []
    assert found[6] == [("email", "a.b@c.de", True)]
    masked = {r.doc_id: r for r in pii.mask(df, model).collect()}
    assert masked[2].text == "call [phone] or the [card] of it" and masked[4].text is None
    assert pii.find(df.limit(0), model).collect() == [] and len(pii.find(df, None).collect()) == 6


def test_no_training_rows():
    assert pii.train([]) is None and pii.train(["nothing here"]) is None


def plausible(kind, s):
    """Whether a span holds what its kind must hold, read as a whole."""
    d = "".join(c for c in s if c in "0123456789")
    if kind == 0:
        t = re.sub(r"\s*[\[({<]\s*(?:at|AT)\s*[\])}>]\s*|\s+(?:at|AT)\s+", "@", s)
        t = re.sub(r"\s*[\[({<]\s*(?:dot|DOT)\s*[\])}>]\s*|\s+(?:dot|DOT)\s+", ".", t)
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) is not None
    if kind == 1:
        p = re.split(r"[.\[\]() ]+", s.strip("[]() "))
        return len(p) == 4 and all(re.fullmatch("[0-9]{1,3}", x) and int(x) <= 255 for x in p)
    if re.search(r"[^0-9().\x20-]" if kind == 2 else r"[^0-9().+/\x20-]", s):
        return False
    if kind == 2:
        return 12 <= len(d) <= 19 and pii.luhn(d)
    return 9 <= len(d) <= 15 and re.search(r"[0-9][^0-9]+[0-9]", s) is not None and s.count(".") < 3


def test_added_spans_against_trying_every_word():
    import random

    rnd = random.Random(8)
    words = ["(389)", "555-5010", "anna", "at", "dot", "mail", "[at]", "(dot)", "com", "1", "22", "333", "4337", "1.2.3.4", "(10.0.0.7)", "4111", "1111", "10.", ".7", "x@y", "-", "+1", "a/b", "é", "(1", "2)", "[dot]"]
    hits = 0
    for _ in range(20_000):
        s = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 8)))
        if re.search(r"(at|dot)\W+(at|dot)|^(at|dot)\b", s):  # a name that is itself spelt at or dot
            continue
        for k in range(4):
            starts = [0] + [i + 1 for i, c in enumerate(s) if c == " "]
            got = {0: pii._email_start, 1: pii._ip_start}.get(k, lambda x: pii._digits_start(k, x))(s)
            want = next((a for a in starts if plausible(k, s[a:])), None)
            assert got == want, (k, s)
            hits += want is not None
    assert hits > 1000


def test_long_lines_take_linear_time(spark):
    import time

    model = pii.fit(spark.read.parquet(f"{SF01}/documents.parquet"))
    for line in ("(389) 555-5010 1 2 3 ", "7", "1.1", "+1 ", "a at b dot ", "a@", " " * 50 + "(", "4111-1111 "):
        took = []
        for n in (40_000, 160_000):
            text = line * (n // len(line))
            t = time.process_time()
            base = pii.base_spans(text)
            pii._added(text, base, [(0, k, len(text)) for k in range(4)])
            found = pii._decode(model, __import__("pyarrow").array([text]))
            pii._added(text, base, found[0])
            took.append(time.process_time() - t)
        assert took[1] < 12 * max(took[0], 0.05), (line, took)


def test_a_labelled_table(spark):
    lines = [(f"write to user{i} AT host{i} DOT org now", [(9, "email", 9 + len(f"user{i} AT host{i} DOT org"))]) for i in range(40)]
    lines += [(f"the word number {i} at home", []) for i in range(40)] + [(None, None)]
    df = spark.createDataFrame(lines, "line string, spans array<struct<start:long,kind:string,end:long>>")
    model = pii.fit(df, labelled=df)
    docs = spark.createDataFrame([(1, "write to ann AT site DOT org now")], "doc_id long, text string")
    assert [(x.kind, x.start, x.end) for x in pii.find(docs, model).first().pii] == [("email", 9, 28)]
