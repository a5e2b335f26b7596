"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds spans.

The patterns find e-mail addresses, IP addresses, card and phone numbers.  The CRF labels the words of
each line as outside, or as the first or a later word of one of the four kinds.  Its features are word
shapes (digits, separators, length) of the word and its neighbours.  It is trained on the
driver from a small labelled table: at most ``SAMPLE`` documents, whose labels are the pattern spans,
together with rewritten copies of their lines in which the values take spellings that the patterns do
not know (``name [at] host [dot] tld``, a phone number without its plus sign, a card in dotted groups).  Whole
texts are decoded by Viterbi, all lines of a batch at once.  A decoded span is added if it meets no
pattern span and its content stands up to the kind's rule.  All passes over a text are linear in its length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfolds.llm import crf
from tsfolds.llm import text as tx

SAMPLE = 300  # most documents that the labels are drawn from
SAMPLE_CHARS = 1 << 16  # most characters of one of them
KINDS = ["email", "ip", "card", "phone"]

# The patterns of the four kinds.
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match never begins inside a run of digits
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _emails(text: str):
    """Leftmost matches of EMAIL, looked for at each @ only."""
    at, pos = text.find("@"), 0
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _NAME_CHARS:
            start -= 1
        m = EMAIL_HOST.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            pos = m.end()
            at = text.find("@", pos)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans, sorted; matches that fail a rule are dropped."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(_byte(p) for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and _card_ok(m.group()):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the field: states 0 outside, 1 + 2k first word of kind k, 2 + 2k later word of kind k

STATES = 1 + 2 * len(KINDS)
FORBIDDEN = np.zeros((STATES, STATES), bool)
for _k in range(len(KINDS)):
    FORBIDDEN[:, 2 + 2 * _k] = True
    FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False

BEGIN = np.where(np.arange(STATES) % 2 == 0, -50.0, 0.0)  # no line begins with a later word
BEGIN[0] = 0.0
CONTEXT = 60  # characters of a line kept on either side of a labelled example's spans

_MARKS = [b"@", b".", b"-", b"+", b"(", b")", b"[", b":=/\"'", b"$%&#*!|"]
_AT, _DOT = b"at", b"dot"


def _shapes(w: tx.Words) -> np.ndarray:
    """Sparse-like 0/1 shape features of each word (words x features)."""
    data, n = w.data, len(w.data)

    def count(member):
        c = np.zeros(n + 1, np.int32)
        np.cumsum(member[data], out=c[1:], dtype=np.int32)
        return c[w.ends] - c[w.starts]

    def bytes_of(chars):
        m = np.zeros(256, bool)
        m[list(chars)] = True
        return m

    digits = count(bytes_of(b"0123456789"))
    letters = count(bytes_of(bytes([*range(65, 91), *range(97, 123), *range(128, 256)])))
    upper = count(bytes_of(bytes(range(65, 91))))
    size = w.ends - w.starts
    cols = [np.ones(len(size), bool), digits == 0, digits > 0, (digits > 0) & (letters == 0), (digits > 0) & (letters > 0)]
    cols += [digits == d for d in (1, 2, 3, 4)] + [(digits >= 5) & (digits <= 8), (digits >= 9) & (digits <= 11), (digits >= 12) & (digits <= 19), digits > 19]
    marks = [count(bytes_of(m)) for m in _MARKS]
    cols += [m > 0 for m in marks] + [marks[1] == 3, marks[1] == 2, marks[2] >= 2, (upper == letters) & (letters > 1)]
    inner = np.minimum(w.starts + 1, max(0, n - 1))
    for s in (w.starts, inner):  # words that spell @ and the dot, bare or in brackets
        for word in (_AT, _DOT):
            hit = np.ones(len(size), bool)
            for i, ch in enumerate(word):
                hit &= data[np.minimum(s + i, max(0, n - 1))] == ch if n else False
            cols.append(hit & (size - 2 * (s is inner) == len(word)))
    return np.stack(cols, axis=1).astype(np.float32) if len(size) else np.zeros((0, len(cols)), np.float32)


def _lines(w: tx.Words) -> np.ndarray:
    """Offsets of lines in words: a line is broken at a line feed and at a document's end."""
    if not len(w.starts):
        return np.zeros(1, np.int64)
    breaks = np.concatenate([[0], np.cumsum(w.data == 0x0A)])
    new = np.ones(len(w.starts), bool)
    new[1:] = (w.doc[1:] != w.doc[:-1]) | (breaks[w.starts[1:]] != breaks[w.starts[:-1]])
    return np.append(np.flatnonzero(new), len(w.starts))


def _emission(shape: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of the states: the word's shapes, and those of the words before and after it in the line.
    Words are looked up by their distinct shape, of which there are few."""
    d = shape.shape[1]
    code = np.packbits(shape.astype(bool), axis=1).astype(np.uint8)
    code = np.ascontiguousarray(np.pad(code, ((0, 0), (0, 8 - code.shape[1])))).view(np.uint64).ravel()
    _, at, inv = np.unique(code, return_index=True, return_inverse=True)
    kinds = shape[at]
    own, before, after = (kinds @ weights[i * d : (i + 1) * d] for i in range(3))
    out = own[inv]
    if len(shape) > 1:
        linked = np.ones(len(shape) - 1, bool)
        linked[first[1:-1] - 1] = False
        out[1:] += before[inv[:-1]] * linked[:, None]
        out[:-1] += after[inv[1:]] * linked[:, None]
    out[first[:-1]] += BEGIN
    return out


def _dense(shape: np.ndarray, first: np.ndarray) -> np.ndarray:
    before, after = np.zeros_like(shape), np.zeros_like(shape)
    if len(shape) > 1:
        linked = np.ones(len(shape) - 1, bool)
        linked[first[1:-1] - 1] = False
        before[1:] = shape[:-1] * linked[:, None]
        after[:-1] = shape[1:] * linked[:, None]
    return np.concatenate([shape, before, after], axis=1).astype(np.float64)


def _respell(kind: int, value: str, turn: int) -> str:
    """The value in a spelling that the patterns do not know."""
    if kind == 0:
        name, host = value.rsplit("@", 1)
        at, dot = [("[at]", "[dot]"), ("(at)", "(dot)"), ("at", "dot")][turn % 3]
        name = re.sub(r"[.0-9]+" if turn % 2 else r"[.]+", "", name) or name
        return f"{name} {at} {host.replace('.', f' {dot} ')}"
    if kind == 1:
        return value if turn % 2 else f"({value})"
    d = _digits(value)
    if kind == 2:
        return ".".join(d[i : i + 4] for i in range(0, len(d), 4))
    d = d[-10:]
    return [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"][turn % 3]


def _labelled(texts: list[str]):
    """(line, [(start, kind, end)]) examples from the pattern spans of whole texts, as found and respelt."""
    out, turn = [], 0
    for t in texts:
        for line in t.split("\n"):
            spans = base_spans(line)
            out.append((line, spans))
            if not spans:
                continue
            for _ in range(3):
                new, got, pos = "", [], 0
                for a, k, b in spans:
                    if a < pos:
                        continue
                    new += line[pos:a]
                    value = _respell(k, line[a:b], turn)
                    got.append((len(new), k, len(new) + len(value)))
                    new, pos, turn = new + value, b, turn + 1
                out.append((new + line[pos:], got))
    return out


def _near(line: str, spans):
    """The part of an example around its spans, cut at white space."""
    a = line.rfind(" ", 0, max(0, min(s[0] for s in spans) - CONTEXT)) + 1
    b = line.find(" ", max(s[2] for s in spans) + CONTEXT)
    return line[a : b if b >= 0 else len(line)], [(x - a, k, y - a) for x, k, y in spans]


def train(texts: list[str], labelled: list[tuple[str, list[tuple[int, int, int]]]] | None = None):
    """The model of labelled lines (line, [(start, kind, end)]), by default those made from the pattern spans of
    ``texts``; None where no line holds personal data."""
    rows = _labelled(texts) if labelled is None else labelled
    hold = [r for r in rows if r[1]]
    if not hold:
        return None
    rows = [_near(*r) for r in hold] + [(r[0][: 4 * CONTEXT], []) for r in rows if not r[1]][: len(hold)]
    w = tx.split(pa.array([r[0] for r in rows], pa.string()))
    y = np.zeros(len(w.starts), int)
    for i, (line, spans) in enumerate(rows):
        at = slice(w.first[i], w.first[i + 1])
        s, e = w.starts[at] - w.off[i], w.ends[at] - w.off[i]
        for a, k, b in spans:
            a, b = len(line[:a].encode()), len(line[:b].encode())
            hit = np.flatnonzero((s < b) & (e > a)) + w.first[i]
            y[hit] = 2 + 2 * k
            y[hit[:1]] = 1 + 2 * k
    first = _lines(w)
    return crf.fit(_dense(_shapes(w), first), y, first, STATES, rounds=120, ridge=1e-5, forbidden=FORBIDDEN, begin=BEGIN)


_EDGE = "\"'`,;:.!?<>{}$%&#*|="


# fixed spellings of @ and the dot; white space is taken from its first character on, so that a long run is read once
_SPELT = [(mark, re.compile(rf"(?<!\s)\s*[\[({{<]\s*(?:{w}|{w.upper()})\s*[\])}}>]\s*|(?<!\s)\s+(?:{w}|{w.upper()})\s+")) for mark, w in (("@", "at"), (".", "dot"))]


def _email_start(s: str):
    """First word start of ``s`` from which all the rest spells one address, or None."""
    t, place = s, range(len(s))  # the text with marks for their spellings, and where its characters stood
    for mark, spelt in _SPELT:
        parts, places, pos = [], [], 0
        for m in spelt.finditer(t):
            parts += [t[pos : m.start()], mark]
            places += [*place[pos : m.start()], -1]
            pos = m.end()
        if parts:
            t, place = "".join([*parts, t[pos:]]), [*places, *place[pos:]]
    at = t.rfind("@")
    if at < 1 or not EMAIL_HOST.fullmatch(t, at + 1):
        return None
    first = at
    while first and t[first - 1] in _NAME_CHARS:
        first -= 1
    return next((i for i in place[first:at] if i == 0 or (i > 0 and s[i - 1] == " ")), None)


def _ip_start(s: str):
    """Likewise for four parts of at most 255, set apart by dots, brackets or spaces."""
    if s.rstrip("[]() ").endswith("."):
        return None
    found, parts, digits = None, 0, ""
    head = True  # whether the marks since the last digit hold no dot: they may then lead the address
    for i in range(len(s) - 1, -1, -1):
        c = s[i]
        if c in "0123456789":
            if not digits:
                parts += 1
            digits, head = c + digits, True
            if len(digits) > 3 or parts > 4:
                break
        elif c in ".[]() ":
            if digits and not _byte(digits):
                break
            digits, head = "", (head or bool(digits)) and c != "."
        else:
            break
        if (i == 0 or s[i - 1] == " ") and parts == 4 and head and (not digits or _byte(digits)):
            found = i
    return found


def _digits_start(kind: int, s: str):
    """Likewise for a card (12 to 19 digits passing Luhn) or a phone number (9 to 15 digits in several groups)."""
    card = kind == 2
    marks, least, most = (" ().-", 12, 19) if card else (" ().+/-", 9, 15)
    found, n, total, dots, groups, gap = None, 0, 0, 0, False, False
    for i in range(len(s) - 1, -1, -1):
        c = s[i]
        if c in "0123456789":
            d = int(c)
            total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
            groups, gap = groups or (gap and n > 0), False
            n += 1
            if n > most:
                break
        elif c in marks:
            gap = True
            dots += c == "."
        else:
            break
        if (i == 0 or s[i - 1] == " ") and least <= n and (total % 10 == 0 if card else groups and dots < 3):
            found = i
    return found


def _added(text: str, spans, candidates) -> list[tuple[int, int, int]]:
    """Decoded candidates (start, kind, end) that hold, cut to their edge and clear of the pattern spans.  The
    field may begin some words too early: of the word starts from which a candidate holds, the first counts."""
    out = []
    for a, k, b in candidates:
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a < b and any(x < b and y > a for x, _, y in spans):
            continue
        s = text[a:b]
        start = (_email_start if k == 0 else _ip_start if k == 1 else lambda x: _digits_start(k, x))(s)  # noqa: B023
        if start is not None:
            out.append((a + start, k, b))
    return out


def _decode(model, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Candidate spans of each text, in code points."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    w = tx.split(texts)
    if model is None or not len(w.starts):
        return found
    first = _lines(w)
    state = crf.viterbi(_emission(_shapes(w), first, model.weights), first, model.trans)
    at = np.flatnonzero(state % 2 == 1)
    if not len(at):
        return found
    line = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lead = (w.data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    for i in at:
        j = i
        while j + 1 < len(state) and line[j + 1] == line[i] and state[j + 1] == state[i] + 1:
            j += 1
        d = w.doc[i]
        base = chars[w.off[d]]
        found[d].append((int(chars[w.starts[i]] - base), int(state[i]) // 2, int(chars[w.ends[j]] - base)))
    return found


def _scan(model, keep: list[str], masked: bool = False):
    """Spans of each text as a column; or, ``masked``, no column but the texts without them."""

    def run(it):
        for batch in it:
            for s in tx.slices(batch, "text"):
                texts = s.column(s.schema.get_field_index("text"))
                candidates = _decode(model, texts)
                rows = []
                for t, c in zip(texts.to_pylist(), candidates, strict=True):
                    t = t or ""
                    base = base_spans(t)
                    rows.append([{"start": a, "kind": KINDS[k], "end": b, "base": True} for a, k, b in base])
                    more = [{"start": a, "kind": KINDS[k], "end": b, "base": False} for a, k, b in _added(t, base, c)]
                    if more:
                        rows[-1] = sorted(rows[-1] + more, key=lambda x: (x["start"], KINDS.index(x["kind"])))
                cols = [s.column(s.schema.get_field_index(c)) for c in keep]
                if masked:
                    cols[keep.index("text")] = pa.array(_masked(texts.to_pylist(), rows), pa.string())
                    yield pa.RecordBatch.from_arrays(cols, keep)
                    continue
                kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(rows, kind)], [*keep, "pii"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, labelled: DataFrame | None = None):
    """Train on at most ``sample`` different texts that hold an @ or a run of digits, those with the least hashes, and at most
    ``chars`` characters of each.  ``labelled`` (line: string, spans: array of (start, kind, end) in code points,
    kind as in ``KINDS``) is a small table of labelled lines to train on instead."""
    if labelled is not None:
        rows = labelled.select("line", "spans").where(F.col("line").isNotNull()).orderBy(F.xxhash64("line")).limit(sample * 10).collect()
        return train([], [(r.line[:chars], [(x["start"], KINDS.index(x["kind"]), x["end"]) for x in r.spans or [] if x["end"] <= chars]) for r in rows])
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("@|[0-9]{3}"))
    texts = texts.select(F.xxhash64("text").alias("h"), "text")
    # hashes first: only the chosen texts come to the driver, not every task's best ones
    least = [r.h for r in texts.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not least:
        return None
    chosen = texts.where(F.col("h") <= max(least)).groupBy("h").agg(F.substring(F.min("text"), 1, chars).alias("text"))
    return train([r.text for r in chosen.orderBy("h").collect()])


def find(docs: DataFrame, model) -> DataFrame:
    """All columns of ``docs`` and ``pii``: the spans of each whole text as (start, kind, end, base) in code
    points, end exclusive, by start, then kind as in ``KINDS``; ``base`` marks the patterns' own.  A null
    text counts as empty: no spans.  Columns named ``pii`` are replaced.  Rows are handled one by one."""
    own = [c for c in docs.columns if c != "pii"]
    df = docs.select(*own).withColumn("text", F.col("text").cast("string"))
    schema = tx.extended(df.schema, pii="array<struct<start:long,kind:string,end:long,base:boolean>>")
    return df.transform(tx.arrow, _scan(model, own), schema)


def _masked(texts, spans):
    out = []
    for t, s in zip(texts, spans, strict=True):
        if t is not None and len(s):
            parts, pos = [], 0
            for x in s:
                if x["end"] <= pos:
                    continue
                parts += [t[pos : max(pos, x["start"])], f"[{x['kind']}]"]
                pos = x["end"]
            t = "".join([*parts, t[pos:]])
        out.append(t)
    return out


def mask(docs: DataFrame, model) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in brackets (overlapping
    spans: the parts not yet replaced go too); null texts stay null, other columns stay as they are."""
    df = docs.withColumn("text", F.col("text").cast("string"))
    return df.transform(tx.arrow, _scan(model, df.columns, masked=True), df.schema)
