"""Job trees and graphs: pointer doubling against plain loops."""

import random
from collections import deque

import pytest

from tsfolds.operators import jobs


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, parent string")


def graph(seed, n, extra):
    """A random graph in which some nodes have several parents; a few links go back and make cycles."""
    rnd = random.Random(seed)
    rows = [("n0", None)]
    for i in range(1, n):
        rows.append((f"n{i}", f"n{rnd.randrange(max(0, i - 6), i)}"))
    rows += [(f"n{rnd.randrange(1, n)}", f"n{rnd.randrange(n)}") for _ in range(extra)]
    return rows


def bfs(rows, root):
    level, todo = {root: 0}, deque([root])
    while todo:
        x = todo.popleft()
        for name, parent in rows:
            if parent == x and name not in level:
                level[name] = level[x] + 1
                todo.append(name)
    return {(n, p, level[n]) for n, p in rows if p in level and n in level and n != root and level[n] == level[p] + 1}


def peel(rows):
    deps = {}
    for n, p in rows:
        deps.setdefault(n, set())
        if p is not None:
            deps.setdefault(p, set())
            deps[n].add(p)
    level = {}
    while True:
        ready = [n for n, d in deps.items() if n not in level and all(p in level for p in d)]
        if not ready:
            return {n: (level.get(n), n not in level) for n in deps}
        level |= {n: max((level[p] + 1 for p in deps[n]), default=0) for n in ready}


@pytest.mark.parametrize("seed, n, extra", [(2, 80, 12), (3, 40, 30)])
def test_graphs_against_loops(spark, seed, n, extra):
    rows = graph(seed, n, extra)
    df = frame(spark, rows)
    assert {tuple(r) for r in jobs.descendants(df, "n0").collect()} == bfs(rows, "n0")
    assert {r.node: (r.level, r.in_cycle) for r in jobs.levels(df).collect()} == peel(rows)


class Rounds:
    """Counts the tables that a call writes."""

    def __init__(self, monkeypatch):
        self.n = 0
        stored = jobs.stored

        def counted(df):
            self.n += 1
            return stored(df)

        monkeypatch.setattr(jobs, "stored", counted)


def test_a_deep_chain_and_a_cycle_in_few_rounds(spark, monkeypatch):
    rows = [("n0", None), *[(f"n{i}", f"n{i - 1}") for i in range(1, 10_001)], *[(f"c{i}", f"c{(i + 1) % 50}") for i in range(50)], ("behind", "c3")]
    df = frame(spark, rows).cache()
    doubled, calls = jobs._doubled, []
    monkeypatch.setattr(jobs, "_doubled", lambda *a: calls.append(Rounds(monkeypatch)) or doubled(*a))
    got = {r.name: r.level for r in jobs.descendants(df, "n0").collect()}
    assert got == {f"n{i}": i for i in range(1, 10_001)}
    assert len(calls) == 1 and calls[0].n <= 20
    calls.clear()
    got = {r.node: (r.level, r.in_cycle) for r in jobs.levels(df).collect()}
    assert got == {n: (int(n[1:]), False) if n[0] == "n" else (None, True) for n, _ in rows}
    assert sum(c.n for c in calls[:1]) <= 30 and len(calls) <= 2
    assert jobs.delete_subtree(df, "n5000").count() == 5000 + 51


def euler(rows):
    kids, names = {}, {}
    for n, p in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        if n not in names:
            names[n] = p
            kids.setdefault(p, []).append(n)
    out, at = {}, 0

    def walk(n, depth):
        nonlocal at
        pre, at = at, at + 1
        for k in kids.get(n, []):
            walk(k, depth + 1)
        out[n] = (names[n], depth, pre, at - 1, at - pre)

    for n in kids.get(None, []):
        walk(n, 0)
    return out


@pytest.mark.parametrize("seed, n", [(1, 1), (2, 50), (3, 300)])
def test_tree_index_against_a_walk(spark, seed, n):
    rnd = random.Random(seed)
    rows = [(f"r{i}", None) for i in range(3)] + [(f"n{i}", f"n{rnd.randrange(i)}" if i and rnd.random() < 0.9 else f"r{rnd.randrange(3)}") for i in range(n)]
    rows += [("x1", "x2"), ("x2", "x1"), ("y", "x1"), ("lost", "nobody"), ("below", "lost")]  # cycles and a parent without a row
    want = euler(rows)
    index = jobs.tree_index(frame(spark, rows * 2)).cache()
    assert {r.name: (r.parent, r.depth, r.pre, r.post, r.size) for r in index.collect()} == want
    for root in ("r0", "n0"):
        lo, hi = want[root][2], want[root][3]
        assert {r.name for r in jobs.subtree(index, root).collect()} == {x for x, w in want.items() if lo <= w[2] <= hi}
    deepest = max(want, key=lambda x: want[x][1])
    up = sorted(jobs.ancestors(index, deepest).collect(), key=lambda r: r.depth)
    assert [r.depth for r in up] == list(range(want[deepest][1] + 1)) and up[-1].name == deepest
    assert jobs.subtree(index, "nobody").collect() == [] == jobs.ancestors(index, "lost").collect()
    paths = {r.name: (r.path, r.depth) for r in jobs.paths(frame(spark, rows)).collect()}
    assert {x: p[1] for x, p in paths.items()} == {x: w[1] for x, w in want.items()}
    assert all(p.split("/")[-1] == x for x, (p, _) in paths.items())


def test_many_siblings_and_empty_tables(spark):
    rows = [("top", None), *[(f"k{i:05d}", "top") for i in range(5000)]]
    got = {r.name: (r.pre, r.post) for r in jobs.tree_index(frame(spark, rows)).collect()}
    assert got == {"top": (0, 5000)} | {f"k{i:05d}": (i + 1, i + 1) for i in range(5000)}
    none = frame(spark, [])
    assert jobs.tree_index(none).collect() == jobs.paths(none).collect() == jobs.levels(none).collect() == jobs.descendants(none, "a").collect() == []


def test_rounds_send_no_table_through_the_driver(spark, monkeypatch):
    """Small written tables would be broadcast, a table a round; the nodes are dealt out instead."""
    plans = []

    def noted(df, real=jobs.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(jobs, "stored", noted)
    rows = [("n0", None), *[(f"n{i}", f"n{i - 1}") for i in range(1, 20)], ("m", "n3"), ("n9", "n2")]
    df = frame(spark, rows)
    for out in (jobs.tree_index(df), jobs.levels(df), jobs.descendants(df, "n0"), jobs.delete_subtree(df, "n5")):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("Join" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
