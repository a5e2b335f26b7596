import hashlib
import heapq
import random
import re
import zlib

from conftest import SF001, SF01
from tsfolds.llm import dialogue
from tsfolds.llm import queries as Q

WORDLESS = re.compile("[\x20\x09-\x0d]*")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        if h:
            mine.extend([(turn, role, text)] * (2 if h == 3 else 1))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


def cheapest(rows, faults):
    """Least (cost, audit) by best-first search over whole edit lists: no table of costs to go."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, made = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, made
        key = (at, roles[-1:])
        if key in seen:
            continue
        seen.add(key)
        more = []
        if at < len(rows):
            more.append((4, "D", 1, "", None))
            if faults[at] in ("", "truncated"):
                extra = 3 if faults[at] else 0
                more.append((extra, "K", 1, rows[at][1][:1] or "-", rows[at][1:]))
                more += [(3 + extra, "R", 1, r[0], (r, rows[at][2])) for r in ("user", "assistant")]
        more += [(3, "I", 0, r[0], (r, "")) for r in ("user", "assistant")]
        for c, letter, step, role, row in more:
            if re.fullmatch("(s?(ua)*u?)?", roles + role):
                heapq.heappush(heap, (cost + c, audit + letter, at + step, roles + role, made + ((row,) if row else ())))


def brute(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        faults, seen = [], set()
        for _, role, text in mine:
            if WORDLESS.fullmatch(text):
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("" if text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, made = cheapest(mine, faults)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def result(df):
    got = df.collect()
    assert df.columns == COLUMNS and len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def table_of(spark, tmp_path, rows, more=()):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *more)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return result(Q.op13_conversation_repair(spark, str(tmp_path)))


def test_query_against_brute_force(spark):
    for sf in (SF001, SF01):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        want = brute(rows)
        assert result(Q.op13_conversation_repair(spark, sf)) == want
        assert {c for x in want.values() for c in x[6]} == set("DIKR")


def test_random_conversations(spark, tmp_path):
    rnd = random.Random(11)
    rows = []
    for conv in range(400):
        turn = 0
        for _ in range(rnd.randrange(1, 9)):
            turn += rnd.choice([1, 1, 1, 2, 5])
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", ""])
            rows.append((conv, turn, role, rnd.choice(["Yes.", "No!", "what", "so?  \n", " \t", "", "a.b", "One. "])))
    rnd.shuffle(rows)
    assert table_of(spark, tmp_path, rows) == brute(rows)


def test_odd_rows(spark, tmp_path):
    gone = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 == 0 for t in (0,)))
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "A."), (1, None, "user", "A."), (1, 2, "assistant", None), (gone, 0, "user", "x")]
    rows += [(5000, t, ("user", "assistant")[t % 2], f"{t}. " + "word " * 2000 + "!") for t in range(3000)]
    rows += [(6000 + i, t, r, "Same.") for i in range(300) for t, r in enumerate(["system", "user", "assistant"])]
    got = table_of(spark, tmp_path, rows, ["'p' as plan", "1 as live_", "'x' as signature", "2 as position", "'d' as digest"])
    assert got == brute(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark, tmp_path):
    assert table_of(spark, tmp_path, []) == {}


def test_nodes_are_shared_and_few():
    walk = dialogue.Walk()
    rnd = random.Random(2)
    sigs = sorted("".join(rnd.choice("ABCDEFGHIM") for _ in range(60))[::-1] for _ in range(300))
    for s in sigs:
        walk.audit(dialogue._minimal(s[::-1]))
    assert len(walk.nodes.costs) < 40 and len(walk.nodes.steps) < 40 * 9
    cost, audit = walk.audit(dialogue._minimal("B" * 100_000))  # user rows only: every second one is rewritten
    assert cost == 150_000 and len(audit) == 100_000


def test_repair_gives_rows(spark):
    rows = spark.createDataFrame([(7, 1, "user", "Hi."), (7, 2, "user", "More."), (7, 3, "tool", "Yes.")], "conv_id long, turn long, role string, text string")
    plans = dialogue.audits(rows)
    got = sorted(dialogue.repair(rows, plans).collect(), key=lambda r: r.position)
    audit = plans.first().audit
    assert "".join(r.edit for r in got) == audit.replace("D", "")
    assert [r.role for r in got] == ["user", "assistant"] * (len(got) // 2)
    assert all(r.text == "" for r in got if r.edit == "I")
