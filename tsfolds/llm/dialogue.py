"""Conversation structure repair by a suffix-shared automaton.

A conversation's rows, in the order of their turns, become a signature: one symbol a row for its role and its
first fault (blank, duplicate, truncated).  A repair makes the roles read ``(system?(user assistant)+)?`` by keeping,
rewriting, deleting and inserting rows; what is left to pay depends on the rest of the signature and the
grammar's state alone.

* Signatures are range-partitioned and sorted by their reverse, so that equal endings lie side by side.  Walking them in
  this order is a walk over the automaton that shares all suffixes: a node is made once for all conversations that
  end alike (and once more at a partition's border).
* A node holds, for each state of the grammar, the cost to go and the best first edit.  Costs less their least are
  one of few vectors, so nodes are minimised to a small table of (vector, symbol) transitions, each worked out once;
  a node on the walk is a table entry and a number.
* In one state different edits have different letters, and the next state follows from the letter.  So of equal costs the
  least letter gives the least audit, and the best audit suffix is a link to the next node and state.

A conversation's rows pass through one task (its text is one sequence), but as a sorted stream: what is held is
one byte a row and the audit.  Conversations of equal structure, however many, are spread over the range.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsfolds.llm import text as tx
from tsfolds.session import cut

# fixed costs and grammar
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)  # grammar states: nothing yet, or the role read last
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # role of an inserted or rewritten row
NAME = {"u": "user", "a": "assistant"}
NEVER = 1 << 40

SPACE = " \t\n\x0b\x0c\r"
FAULTS = ("", "truncated", "blank", "duplicate")
ROLES = "sua?"  # role initials; the last one stands for all others
_SYMBOL = "ABCDEFGHIJKLMNOP"  # 4 * fault + role, as a letter
_ROWS = 4096  # rows handed on at once


# --------------------------------------------------------------------------- rows


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live: faults planted by h = crc32 of ``<conv_id>:<turn>`` modulo 20 (0: the row goes,
    1: no text, 2: no ``.!?``, 3: the row twice, 4: role user).  Nulls count as one space, but for the order of turns
    and the names of conversations.  A row that goes stays as a mark (live false) of its conversation."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(h == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (h != 0).alias("live"), h.alias("_h")
    )
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_h") == 3, 2).otherwise(1)))).drop("_h", "_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with a digest of role and text, which orders the rows of one turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    live = F.coalesce(F.col("live"), F.lit(False)) if "live" in rows.columns else F.lit(True)
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, live.alias("live"))
    return base.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


def _order():
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _changes(ids: list, before) -> list[int]:
    """Places where another conversation begins."""
    return [i for i, x in enumerate(ids) if x != (ids[i - 1] if i else before)]


def _signatures(kind):
    """Sorted rows (conv_id, turn, live, symbol) to one row a conversation: conv_id, gaps, signature."""
    names = ["conv_id", "gaps", "signature"]

    def out(done):
        ids, gaps, sigs = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(gaps, pa.int64()), pa.array([s.decode() for s in sigs], pa.string())], names)

    def run(it):
        now, low, high, distinct, sig, any_, done = None, None, None, 0, bytearray(), False, []

        def closed():
            return (now, 0 if low is None else high - low + 1 - distinct, sig)

        for batch in it:
            ids, turns, live = (batch.column(i).to_pylist() for i in range(3))
            symbols = "".join(batch.column(3).to_pylist()).encode()
            new = set(_changes(ids, now if any_ else object()))
            cuts = sorted(new | {0, len(ids)})
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a in new:
                    if any_:
                        done.append(closed())
                    now, low, high, distinct, sig, any_ = ids[a], None, None, 0, bytearray(), True
                for i in range(a, b):
                    if live[i]:
                        sig.append(symbols[i])
                        t = turns[i]
                        if t is not None and t != high:  # turns come in order
                            low, high, distinct = t if low is None else low, t, distinct + 1
            if len(done) >= _ROWS:
                yield out(done)
                done = []
        if any_:
            done.append(closed())
        if done:
            yield out(done)

    return run


# --------------------------------------------------------------------------- automaton


class Automaton:
    """Cost vectors over the grammar's states and the transitions between them, each worked out once."""

    def __init__(self):
        self.costs: list[tuple] = []  # by vector: costs less their least
        self.ids: dict[tuple, int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int, str]] = {}  # (vector, symbol) -> vector, least cost, letters by state
        done = {START: (0, ""), ASSISTANT: (0, "")}
        self.end, self.end_cost, self.end_letters = self._node([done.get(s, (NEVER, "")) for s in range(4)])

    def _node(self, base):
        """Vector, least cost and letters of (cost, letter) by state, after inserted rows are weighed."""
        best = list(base)
        for _ in range(3):  # an insertion from START or SYSTEM may follow one from USER
            best = [min(base[s], (INSERT + best[NEXT[WANTED[s]][s]][0], "I")) for s in range(4)]
        least = min(c for c, _ in best)
        vector = tuple(c - least for c, _ in best)
        if vector not in self.ids:
            self.ids[vector] = len(self.costs)
            self.costs.append(vector)
        return self.ids[vector], least, [letter for _, letter in best]

    def step(self, vector: int, symbol: int):
        """The node before ``vector`` when a row of ``symbol`` (4 * fault + role) stands before its suffix."""
        got = self.steps.get((vector, symbol))
        if got is None:
            cost, fault, role = self.costs[vector], FAULTS[symbol // 4], ROLES[symbol % 4]
            base = []
            for s in range(4):
                ways = [(DELETE + cost[s], "D")]
                if fault in ("", "truncated"):
                    more = TRUNCATED if fault else 0
                    ways.append((REROLE + more + cost[NEXT[WANTED[s]][s]], "R"))
                    if s in NEXT.get(role, {}):
                        ways.append((more + cost[NEXT[role][s]], "K"))
                base.append(min(ways))
            got = self.steps[vector, symbol] = self._node(base)
        return got


def _minimal(signature: str) -> bytes:
    """Symbols as numbers from the end; rows that must go are one symbol whatever their role and fault."""
    out = np.frombuffer(signature.encode(), np.uint8)[::-1] - ord("A")
    return np.where(out >= 8, 8, out).astype(np.uint8).tobytes()


class Walk:
    """The path of one signature through the automaton, from the end; the next one keeps the ending it shares."""

    def __init__(self):
        self.nodes = Automaton()
        self.path = b""
        self.vector = array("i", [self.nodes.end])
        self.least = array("q", [self.nodes.end_cost])

    def audit(self, path: bytes) -> tuple[int, str]:
        """(cost, audit) of a reversed signature."""
        n = min(len(path), len(self.path))
        both = np.frombuffer(path, np.uint8, n) != np.frombuffer(self.path, np.uint8, n)
        same = int(both.argmax()) if both.any() else n
        del self.vector[same + 1 :], self.least[same + 1 :]
        for symbol in path[same:]:
            vector, least, _ = self.nodes.step(self.vector[-1], symbol)
            self.vector.append(vector)
            self.least.append(self.least[-1] + least)
        self.path = path
        cost = self.least[-1] + self.nodes.costs[self.vector[-1]][START]
        out, state, at = [], START, len(path)
        while True:
            symbol = path[at - 1] if at else None
            letters = self.nodes.step(self.vector[at - 1], symbol)[2] if at else self.nodes.end_letters
            letter = letters[state]
            if not letter:
                return cost, "".join(out)
            out.append(letter)
            state = _after(state, letter, ROLES[symbol % 4] if at else "")
            at -= letter != "I"


def _after(state: int, letter: str, role: str) -> int:
    """The grammar's state after an edit of a row with this role initial."""
    if letter == "D":
        return state
    return NEXT[role if letter == "K" else WANTED[state]][state]


def _audited(it):
    """Rows (..., signature, reversed) sorted by ``reversed`` with cost and audit."""
    walk, last, got = Walk(), None, None
    for batch in it:
        costs, audits = [], []
        for path in batch.column(batch.num_columns - 1).to_pylist():
            if path != last:
                last, got = path, walk.audit(_minimal(path[::-1]))
            costs.append(got[0])
            audits.append(got[1])
        cols = [*batch.columns[:-1], pa.array(costs, pa.int64()), pa.array(audits, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "cost", "audit"])


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text; ``live``, if there, marks with false rows that only
    name their conversation): conv_id, gaps, blank, duplicate, truncated, illegal, cost (long), audit and signature.

    Rows are taken by turn, nulls first; rows of one turn by role and a digest of the text, so equal ones stay side by
    side.  A row's first fault counts: blank (no text), duplicate (role and text seen earlier), truncated (no ``.!?`` at
    the end).  Nulls in role and text are one space; a null conv_id is a conversation; gaps ignore null turns.
    The audit holds the initials of the cheapest edits (Delete, Insert, Keep, Rerole; of equal costs the least in
    ASCII).  A conversation without live rows has zeros and an empty audit; no rows give none.  Other columns are not
    looked at.
    """
    keyed = _keyed(rows)
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(last == "", 2).when(last.isin(".", "!", "?"), 0).otherwise(1)
    dealt = keyed.select("conv_id", "turn", "role", "digest", "live", role.alias("at"), fault.alias("fault")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "live", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when((F.col("fault") != 2) & F.col("seen"), 3).otherwise(F.col("fault"))
    symbol = F.substring(F.lit(_SYMBOL), fault * 4 + F.col("at") + 1, F.lit(1))
    ordered = dealt.withColumn("seen", seen).withColumn("symbol", symbol).sortWithinPartitions("conv_id", *_order()).select("conv_id", "turn", "live", "symbol")
    kind = rows.schema["conv_id"].dataType
    schema = tx.extended(rows.select("conv_id").schema, gaps="long", signature="string")
    signed = cut(ordered.transform(tx.arrow, _signatures(_arrow_type(kind)), schema))
    # rows that must go are one symbol, so that endings meet
    minimal = F.translate(F.reverse("signature"), _SYMBOL[8:], _SYMBOL[8] * 8)
    by_end = signed.withColumn("reversed", minimal).repartitionByRange("reversed", F.xxhash64("conv_id")).sortWithinPartitions("reversed")
    done = by_end.transform(tx.arrow, _audited, tx.extended(signed.schema, cost="long", audit="string"))
    count = lambda fault: F.length(F.regexp_replace("signature", f"[^{_SYMBOL[4 * fault : 4 * fault + 4]}]", "")).cast("long")
    roles = F.translate("signature", _SYMBOL, ROLES * 4)
    # adjacent pairs less the legal ones; pairs may share a row, so every legal role is replaced by looking ahead
    done = done.withColumn("roles", roles)
    legal = F.length("roles") - F.length(F.regexp_replace("roles", "s(?=u)|u(?=a)|a(?=u)", ""))
    illegal = F.greatest(F.length("roles") - 1, F.lit(0)) - legal
    return done.select("conv_id", "gaps", count(2).alias("blank"), count(3).alias("duplicate"), count(1).alias("truncated"), illegal.cast("long").alias("illegal"), "cost", "audit", "signature")


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# --------------------------------------------------------------------------- repair


def _edited(kind):
    """A sorted stream of each conversation's audit and then its rows to the rows of its repair."""
    names = ["conv_id", "position", "edit", "role", "text"]

    def out(rows):
        ids, at, edit, role, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(at, pa.int64()), pa.array(edit), pa.array(role), pa.array(text)], names)

    def run(it):
        now, audit, at, state, position, rows, held = None, "", 0, START, 0, [], 0

        def emit(letter, role, text):
            nonlocal state, position
            state = _after(state, letter, role[:1])
            rows.append((now, position, letter, role, text))
            position += 1

        def inserted():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                emit("I", NAME[WANTED[state]], "")

        for batch in it:
            for conv, plan, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if plan is not None:
                    inserted()  # what follows the last row of the conversation before
                    now, audit, at, state, position = conv, plan, 0, START, 0
                    continue
                inserted()
                letter = audit[at]
                at += 1
                if letter == "K":
                    emit("K", role, text)
                elif letter == "R":
                    emit("R", NAME[WANTED[state]], text)
                held += len(text)
                if len(rows) >= _ROWS or held > tx.SLICE_BYTES:
                    if rows:
                        yield out(rows)
                    rows, held = [], 0
        inserted()
        if rows:
            yield out(rows)

    return run


def repair(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), role, text.  ``plans`` are the ``audits`` of
    the same rows.  Each partition holds whole conversations, in order; a conversation with an empty repair has no row."""
    texts = _keyed(rows).where("live").select("conv_id", F.lit(None).cast("string").alias("plan"), "turn", "role", "digest", "text")
    heads = plans.select("conv_id", F.col("audit").alias("plan"), F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("digest", "binary"), ("text", "string"))])
    both = texts.unionByName(heads).repartition("conv_id")
    ordered = both.sortWithinPartitions("conv_id", F.col("plan").isNull(), *_order()).select("conv_id", "plan", "role", "text")
    schema = tx.extended(rows.select("conv_id").schema, position="long", edit="string", role="string", text="string")
    return ordered.transform(tx.arrow, _edited(_arrow_type(rows.schema["conv_id"].dataType)), schema)


def _digests(kind):
    def run(it):
        now, sha, done = None, None, []
        for batch in it:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sha is None or conv != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if done:
                yield out(done)
                done = []
        if sha is not None:
            yield out([(now, sha.hexdigest())])

    def out(done):
        ids, sha = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sha)], ["conv_id", "sha256"])

    return run


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 of the rows ``role:text`` of each conversation, joined by line feeds.  Takes the rows of ``repair`` as
    they come (whole conversations in order), so nothing is shuffled."""
    schema = tx.extended(repaired.select("conv_id").schema, sha256="string")
    return repaired.select("conv_id", "role", "text").transform(tx.arrow, _digests(_arrow_type(repaired.schema["conv_id"].dataType)), schema)
