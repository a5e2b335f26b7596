"""Sums over the pairs of rows of a series that lie some lags apart (E12b), as streams of sorted rows.

A series may be dealt to any number of blocks.  ``block_rows`` folds the rows of each block in order, ``key_rows`` each key's
blocks.  A pair of rows is never a row, and neither a series nor a block is held whole: of either, 2 ``max_lag`` rows at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa


def halved(lag: int) -> list[int]:
    """``lag`` and its integer halves while > 2."""
    out = []
    while lag > 2:
        out.append(lag)
        lag //= 2
    return out


def _sums(x: np.ndarray, there: np.ndarray, lags: Sequence[int], start: int = 0, stop: int | None = None) -> np.ndarray:
    """For every lag, over the pairs whose later row is ``start`` or after it and whose earlier row is before ``stop``: the count and
    the sum of the squared differences, the count and the sum of the earlier values.  Missing values are left out."""
    out = np.zeros((4, len(lags)))
    for k, lag in enumerate(lags):
        lo = max(start - lag, 0)
        hi = max(min(len(x) - lag, len(x) if stop is None else stop), lo)
        first = there[lo:hi]
        both = first & there[lo + lag : hi + lag]
        with np.errstate(invalid="ignore", over="ignore"):
            d = (x[lo + lag : hi + lag] - x[lo:hi])[both]
            out[:, k] = len(d), np.sum(d * d), np.count_nonzero(first), np.sum(x[lo:hi][first])
    return out


class _Series:
    """The rows of a series so far, in order: all of them while they are fewer than 2 ``max_lag`` (the lags depend on their number),
    then the sums at the lags from ``max_lag`` down, the first and the last ``max_lag`` rows."""

    def __init__(self, max_lag: int):
        self.max_lag, self.lags = max_lag, halved(max_lag)
        self.n, self.sums, self.head = 0, None, None
        self.x, self.there = np.empty(0), np.empty(0, bool)

    def add(self, x: np.ndarray, there: np.ndarray):
        """The next rows."""
        old, m = len(self.x), self.max_lag
        self.n += len(x)
        self.x, self.there = np.concatenate([self.x, x]), np.concatenate([self.there, there])
        if self.sums is None:
            if self.n < 2 * m:
                return
            old, self.sums, self.head = 0, np.zeros((4, len(self.lags))), (self.x[:m].copy(), self.there[:m].copy())
        self.sums += _sums(self.x, self.there, self.lags, old)
        keep = max(len(self.x) - m, 0)
        self.x, self.there = self.x[keep:].copy(), self.there[keep:].copy()

    def add_block(self, n: int, x: np.ndarray, there: np.ndarray, sums: np.ndarray):
        """The next ``n`` rows, of which ``sums`` are the sums and ``x`` the first and the last ``max_lag``."""
        if self.sums is None:
            self.sums = _sums(self.x, self.there, self.lags)
        old, m = len(self.x), self.max_lag
        self.n += n
        near = np.concatenate([self.x, x[:m]]), np.concatenate([self.there, there[:m]])
        self.sums += sums + _sums(*near, self.lags, old, old)
        self.x, self.there = x[m:].copy(), there[m:].copy()

    def block(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """What ``add_block`` takes; without sums, the values that ``add`` takes."""
        if self.sums is None:
            return self.n, self.x, self.there, np.empty(0)
        return self.n, np.concatenate([self.head[0], self.x]), np.concatenate([self.head[1], self.there]), self.sums.ravel()

    def at_lags(self) -> tuple[list[int], np.ndarray]:
        """The lags of the whole series and its sums at each."""
        if self.sums is not None:
            return self.lags, self.sums
        lags = halved(self.n // 2)
        return lags, _sums(self.x, self.there, lags)


Add = Callable[[_Series, int, int], None]


def _folded(batches: Iterable[pa.RecordBatch], keys: int, max_lag: int, adder: Callable[[pa.RecordBatch], Add]) -> Iterator[tuple[list[pa.Array], list[_Series]]]:
    """The series whose rows come in order, each from a row with ``_rn`` = 1 on, with its first ``keys`` columns: those
    that end in a batch at a time."""
    key, series = None, None
    for batch in batches:
        first = np.flatnonzero(batch.column("_rn").to_numpy() == 1).tolist()
        starts, add, done = set(first), adder(batch), []
        for lo, hi in pairwise(sorted({0, *first, batch.num_rows})):
            if lo in starts:
                if series is not None:
                    done.append((key, series))
                key, series = batch.slice(lo, 1), _Series(max_lag)
            add(series, lo, hi)
        if done:
            yield _columns([k for k, _ in done], keys), [s for _, s in done]
    if series is not None:
        yield _columns([key], keys), [series]


def _columns(rows: list[pa.RecordBatch], keys: int) -> list[pa.Array]:
    return [pa.concat_arrays([r.column(k) for r in rows]) for k in range(keys)]


def _lists(parts: Sequence[np.ndarray], there: Sequence[np.ndarray] | None = None) -> pa.Array:
    mask = None if there is None else ~np.concatenate(there)
    return pa.ListArray.from_arrays(_offsets(parts), pa.array(np.concatenate(parts), pa.float64(), mask=mask))


def _offsets(parts: Sequence) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())


def _values(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return cells.to_numpy(zero_copy_only=False), cells.is_valid().to_numpy(zero_copy_only=False)


def block_rows(batches: Iterable[pa.RecordBatch], keys: Sequence[str], max_lag: int) -> Iterator[pa.RecordBatch]:
    """Rows (keys, ``_x``, ``_rn``) of blocks to a row for each block: keys, ``_n``, ``_x``, ``_sums``."""

    def adder(batch):
        x, there = _values(batch.column("_x"))
        return lambda series, lo, hi: series.add(x[lo:hi], there[lo:hi])

    for columns, found in _folded(batches, len(keys), max_lag, adder):
        n, x, there, sums = zip(*(s.block() for s in found), strict=True)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), _lists(x, there), _lists(sums)], [*keys, "_n", "_x", "_sums"])


def key_rows(batches: Iterable[pa.RecordBatch], keys: Sequence[str], max_lag: int) -> Iterator[pa.RecordBatch]:
    """Blocks (keys, ``_n``, ``_x``, ``_sums``, ``_rn``) to a row for each key: keys and, as a list of ``_lags``, the ``lag``, the mean
    ``square`` of the differences and the mean ``level`` of the earlier values (NULL where there are none)."""

    def adder(batch):
        n, cells, sums = (batch.column(c) for c in ("_n", "_x", "_sums"))
        n, at, to = n.to_numpy(), cells.offsets.to_numpy(), sums.offsets.to_numpy()
        (x, there), sums = _values(cells.values), sums.values.to_numpy()

        def add(series, lo, hi):
            for r in range(lo, hi):
                part = slice(at[r], at[r + 1])
                if to[r] == to[r + 1]:
                    series.add(x[part], there[part])
                else:
                    series.add_block(int(n[r]), x[part], there[part], sums[to[r] : to[r + 1]].reshape(4, -1))

        return add

    for columns, found in _folded(batches, len(keys), max_lag, adder):
        lags, sums = zip(*(s.at_lags() for s in found), strict=True)
        count, square, values, level = np.concatenate(sums, axis=1)
        means = [pa.array(v / np.maximum(c, 1), pa.float64(), mask=c == 0) for c, v in ((count, square), (values, level))]
        cells = pa.StructArray.from_arrays([pa.array(np.concatenate(lags), pa.int64()), *means], ["lag", "square", "level"])
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(_offsets(lags), cells)], [*keys, "_lags"])
