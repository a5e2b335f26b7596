"""Feature graph: named DataFrame -> DataFrame steps with
dependencies, composed lazily into one plan.

``add(name, fn, deps, **kwargs)`` registers a node; ``fn`` receives the
outputs of ``deps`` (in order) plus ``kwargs`` and returns a DataFrame.
``build(name)`` resolves the dependencies depth-first and returns the lazy
DataFrame of the node — nothing runs until an action, and Catalyst sees the
whole graph as one query.  Missing dependencies and cycles raise.

``build_all`` returns every node.  There a node that several others read, or that stands on
a long chain of nodes, is written once and read back from there, so that no
source is scanned twice and no plan grows without end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from tsfolds.session import stored


class GraphError(ValueError):
    pass


class FeatureGraph:
    def __init__(self) -> None:
        self._nodes: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], dict]] = {}

    def add(self, name: str, fn: Callable[..., DataFrame], deps: Sequence[str] = (), **kwargs) -> FeatureGraph:
        if name in self._nodes:
            raise GraphError(f"node {name!r} already exists")
        self._nodes[name] = (fn, tuple(deps), kwargs)
        return self

    def order(self) -> list[str]:
        """Topological order of all nodes (dependencies first)."""
        done: list[str] = []
        state: dict[str, int] = {}

        def visit(n: str, path: tuple[str, ...]) -> None:
            if n not in self._nodes:
                raise GraphError(f"missing dependency {n!r} (needed by {path[-1] if path else '?'})")
            if state.get(n) == 1:
                raise GraphError("cycle: " + " -> ".join(path + (n,)))
            if state.get(n) == 2:
                return
            state[n] = 1
            for d in self._nodes[n][1]:
                visit(d, path + (n,))
            state[n] = 2
            done.append(n)

        for n in self._nodes:
            visit(n, ())
        return done

    def levels(self) -> dict[str, int]:
        """Dependency level of every node (0 = no dependencies)."""
        lv: dict[str, int] = {}
        for n in self.order():
            deps = self._nodes[n][1]
            lv[n] = 1 + max(lv[d] for d in deps) if deps else 0
        return lv

    def build(self, name: str) -> DataFrame:
        self.order()  # validates the whole graph
        memo: dict[str, DataFrame] = {}

        def get(n: str) -> DataFrame:
            if n not in memo:
                fn, deps, kw = self._nodes[n]
                memo[n] = fn(*[get(d) for d in deps], **kw)
            return memo[n]

        return get(name)

    def consumers(self, wanted: Sequence[str] | None = None) -> dict[str, int]:
        """How many readers each node has that is needed for ``wanted`` (all nodes unless given): the
        nodes that depend on it, and the caller if it is wanted."""
        order = self.order()
        wanted = list(order if wanted is None else wanted)
        unknown = [n for n in wanted if n not in self._nodes]
        if unknown:
            raise GraphError(f"no node {unknown[0]!r}")
        need, readers = set(wanted), {n: 0 for n in order}
        for n in wanted:
            readers[n] += 1
        for n in reversed(order):
            if n in need:
                for d in dict.fromkeys(self._nodes[n][1]):
                    need.add(d)
                    readers[d] += 1
        return {n: readers[n] for n in order if n in need}

    def build_all(self, wanted: Sequence[str] | None = None, share: int = 2, depth: int = 16) -> dict[str, DataFrame]:
        """The nodes ``wanted`` (all unless given).  A node with ``share`` or more readers, or with ``depth`` nodes one upon
        the other below it since the last written ones, is written to the checkpoint folder and read from there."""
        readers = self.consumers(wanted)
        built: dict[str, DataFrame] = {}
        chain: dict[str, int] = {}
        for n in readers:
            fn, deps, kw = self._nodes[n]
            df = fn(*[built[d] for d in deps], **kw)
            chain[n] = 1 + max((chain[d] for d in deps), default=0)
            if readers[n] >= share or chain[n] >= depth:
                df, chain[n] = stored(df), 0
            built[n] = df
        return {n: built[n] for n in (readers if wanted is None else wanted)}
