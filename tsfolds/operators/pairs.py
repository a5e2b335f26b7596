"""Rolling correlations of all symbol pairs by tiles.

Each symbol's series is written once as one row, and the symbols are dealt to tiles by hash: a tile is a row
too.  The tiles meet in a Cartesian product of two readings of the same shuffled tiles (``shuffle_replicate_nl``), so
what is shuffled and written grows with the rows and not with the pairs; a task reads a part of each side.  Of each
pair of tiles it takes a block of dates at a time as two small matrices and computes the windows of the symbol pairs in
numpy.  The n * n / 2 pairs of a date exist only there unless all are asked for: of the top ones a task
gives out only its own.  No step orders all symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tsfolds.operators.features import DEFAULT_B
from tsfolds.session import ship, stored

TILE = 64
TILE_ROWS = 1 << 19  # rows of a tile, about
PART_ROWS = 1 << 21  # rows of a part of the tiles: one of the pair of parts that a task reads
PARTS = 8  # parts at least, so that a small panel has tasks for the cores
DATES = 4096  # dates of a block
DIGITS = 9  # correlations are ranked as rounded to so many digits, so that equal ones tie


def rolling_tiles(df: DataFrame, col="spot", B: int = DEFAULT_B, ticker="ticker", order_by="date", *, top: int | None = None,
                  full: bool = False, tile: int = TILE, block: int | None = None) -> DataFrame:
    """(``order_by``, a, b, corr) of every pair a < b of symbols and every date on which both have a value: their
    correlation over their last B+1 common dates, NULL where either side is constant there.

    ``full`` leaves out windows of fewer than B+1 dates.  With ``top`` only the pairs of the largest absolute
    correlation of each date are returned (ties by a, b), with ``rank`` from 1; undefined ones do not rank.
    Rows without symbol, date or value (NULL or NaN) are not there; of several values of a symbol and date
    the largest counts.  A task holds the tiles of one part (``PART_ROWS``), a pair of tiles as rows, its matrices for ``block`` dates and
    the last B common rows of its pairs; a tile has at most about ``tile`` symbols and ``TILE_ROWS`` rows, but
    never less than one whole series.  The time grows with the pairs, as the job does."""
    x = df.select(F.col(ticker).cast("string").alias("s"), F.col(order_by).alias("t"), F.nanvl(F.col(col).cast("double"), F.lit(None)).alias("v"))
    x = x.dropna().repartition("s").groupBy("s", "t").agg(F.max("v").alias("v"))
    series = x.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("x")).select("s", "x.t", "x.v")
    series = stored(series)
    n, rows = series.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
    tiles = max(1, -(-n // tile), -(-rows // TILE_ROWS))
    parts = min(tiles, max(PARTS, -(-rows // PART_ROWS)))
    dates = DATES if block is None else max(1, int(block))

    def side(name):
        own = F.pmod(F.xxhash64("s"), F.lit(tiles)).cast("int").alias(name)
        dealt = series.select(own, F.struct("s", "t", "v").alias("x")).repartition(parts, name)
        return dealt.groupBy(name).agg(F.collect_list("x").alias(f"of_{name}"))

    met = side("i").hint("shuffle_replicate_nl").join(side("j"), F.col("i") <= F.col("j"))
    kind = df.schema[order_by].dataType
    schema = StructType([StructField("t", kind), StructField("a", StringType()), StructField("b", StringType()), StructField("corr", DoubleType())])

    def run(batches):
        best = _Best(top)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                i, j = (row.column(row.schema.get_field_index(c))[0].as_py() for c in "ij")
                pairs = _TilePair(i == j, i, B, full, top)
                for rows in _blocks(row, i, j, dates):
                    for found in pairs.block(rows):
                        if top is None:
                            yield found
                        else:
                            best.add(found)
        yield from best.batches()

    ship(df.sparkSession)
    out = met.select("i", "j", "of_i", "of_j").mapInArrow(run, schema)
    if top is not None:
        size = F.round(F.abs("corr"), DIGITS)
        w = Window.partitionBy("t").orderBy(size.desc(), "a", "b")
        out = out.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= top)
    return out.withColumnRenamed("t", order_by)


def _blocks(row: pa.RecordBatch, i: int, j: int, dates: int) -> Iterator[pa.Table]:
    """The rows (s, t, v, own) of a pair of tiles in date order, ``dates`` dates at a time."""
    sides = []
    for own, name in {i: "of_i", j: "of_j"}.items():
        series = row.column(row.schema.get_field_index(name)).flatten()
        s, t, v = (series.field(c) for c in "stv")
        size = t.value_lengths().to_numpy(zero_copy_only=False)
        whole = pa.array(np.repeat(np.arange(len(s)), size))
        sides.append(pa.table([s.dictionary_encode().take(whole), t.flatten(), v.flatten(), pa.array(np.full(len(whole), own, np.int32))], ["s", "t", "v", "own"]))
    rows = pa.concat_tables(sides).unify_dictionaries()
    rows = rows.take(pc.sort_indices(rows.column("t")))
    at = rows.column("t").combine_chunks().dictionary_encode()
    at = (at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at).indices.to_numpy()
    last = int(at[-1]) + 1 if len(at) else 0
    cuts = np.searchsorted(at, np.arange(0, last + dates, dates))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield rows.slice(lo, hi - lo)


class _Best:
    """The ``top`` rows of every date so far, of all pairs of tiles of a task."""

    def __init__(self, top: int | None):
        self.top, self.parts, self.kept, self.rows = top, [], 0, 0

    def add(self, found: pa.RecordBatch):
        self.parts.append(found)
        self.rows += found.num_rows
        if self.rows > max(1 << 18, 2 * self.kept):
            self._reduce()

    def _reduce(self):
        x = pa.Table.from_batches(self.parts)
        size = pa.array(-np.round(np.abs(x.column("corr").to_numpy()), DIGITS))
        x = x.take(pc.sort_indices(x.append_column("size", size), [(c, "ascending") for c in ("t", "size", "a", "b")])).combine_chunks()
        at = x.column("t").combine_chunks().dictionary_encode()
        at = (at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at).indices.to_numpy()
        place = np.arange(len(at)) - np.searchsorted(at, at)
        x = x.filter(pa.array(place < self.top))
        self.parts, self.kept, self.rows = x.to_batches(), x.num_rows, x.num_rows

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._reduce()
        for part in self.parts:
            yield from (part.slice(lo, 1 << 16) for lo in range(0, part.num_rows, 1 << 16))


class _TilePair:
    """The state of one pair of tiles: its symbols so far, and the last B common values of each of their pairs."""

    def __init__(self, same: bool, first: int, B: int, full: bool, top: int | None):
        self.same, self.first, self.B, self.full, self.top = same, first, B, full, top
        self.names: tuple[list[str], list[str]] = ([], [])
        self.tail = np.full((2, 0, 0, B), np.nan)

    def block(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """The rows of one block of dates, which come in date order."""
        rows = rows.combine_chunks()
        symbols = rows.column("s").combine_chunks().dictionary_encode()
        if isinstance(symbols, pa.ChunkedArray):
            symbols = symbols.combine_chunks()
        names, code = symbols.dictionary.to_pylist(), symbols.indices.to_numpy()
        times = rows.column("t").combine_chunks().dictionary_encode()
        if isinstance(times, pa.ChunkedArray):
            times = times.combine_chunks()
        at, dates = times.indices.to_numpy(), times.dictionary
        own, value = rows.column("own").to_numpy(), rows.column("v").to_numpy()
        left = self._matrix(0, own == self.first, names, code, at, value, len(dates))
        right = left if self.same else self._matrix(1, own != self.first, names, code, at, value, len(dates))
        if self.same:
            self.names = (self.names[0], self.names[0])
        self._grow()
        rank = {s: r for r, s in enumerate(sorted({*self.names[0], *self.names[1]}))}
        order = np.array([rank[s] for s in self.names[1]], dtype=np.int64)
        found = []
        for p, name in enumerate(self.names[0]):
            if np.isnan(left[p]).all():
                continue
            q, t, corr = self._one(p, left[p], right, np.arange(len(order)) > p if self.same else np.ones(len(order), bool))
            me, you = np.full(len(q), rank[name]), order[q]
            found.append((t, np.minimum(me, you), np.maximum(me, you), corr))
        if not found:
            return
        t, a, b, corr = (np.concatenate(c) for c in zip(*found, strict=True))
        if self.top is not None:
            t, a, b, corr = (c[~np.isnan(corr)] for c in (t, a, b, corr))
            by = np.lexsort((b, a, -np.round(np.abs(corr), DIGITS), t))
            t = t[by]
            place = np.arange(len(t)) - np.searchsorted(t, t)
            t, by = t[place < self.top], by[place < self.top]
            a, b, corr = a[by], b[by], corr[by]
        words = pa.array(sorted(rank), pa.string())
        for lo in range(0, len(t), 1 << 16):
            cut = slice(lo, lo + (1 << 16))
            cells = [dates.take(pa.array(t[cut])), words.take(pa.array(a[cut])), words.take(pa.array(b[cut])), pa.array(corr[cut], pa.float64(), mask=np.isnan(corr[cut]))]
            yield pa.RecordBatch.from_arrays(cells, ["t", "a", "b", "corr"])

    def _matrix(self, side, mine, names, code, at, value, n_dates) -> np.ndarray:
        """Symbols x dates of one tile, NaN where there is no value; new symbols are added to the tile's."""
        known = {s: i for i, s in enumerate(self.names[side])}
        place = np.full(len(names), -1)
        for c in np.unique(code[mine]):
            place[c] = known.setdefault(names[c], len(known))
        self.names[side][:] = list(known)
        out = np.full((len(known), n_dates), np.nan)
        out[place[code[mine]], at[mine]] = value[mine]
        return out

    def _grow(self):
        n, m = len(self.names[0]), len(self.names[1])
        old = self.tail
        if old.shape[1:3] != (n, m):
            self.tail = np.full((2, n, m, self.B), np.nan)
            self.tail[:, : old.shape[1], : old.shape[2]] = old

    def _one(self, p: int, mine: np.ndarray, right: np.ndarray, partners: np.ndarray):
        """(partner, date, correlation) of symbol ``p`` and its partners, at every common date of the block."""
        q = np.flatnonzero(partners)
        B, n_dates = self.B, len(mine)
        x = np.concatenate([self.tail[0, p, q], np.broadcast_to(mine, (len(q), n_dates))], axis=1)
        y = np.concatenate([self.tail[1, p, q], right[q]], axis=1)
        there = ~(np.isnan(x) | np.isnan(y))
        count = there.sum(axis=1)
        row, at = np.nonzero(there)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)  # among the common dates of the pair
        xs, ys = x[there], y[there]
        if B:
            keep = np.repeat(count, count) - place <= B
            slot = (place - np.repeat(count, count))[keep]
            for k, v in enumerate((xs, ys)):
                last = np.full((len(q), B), np.nan)
                last[row[keep], slot] = v[keep]
                self.tail[k, p, q] = last
        corr, size = _windows(row, place, count, xs, ys, B + 1)
        new = at >= B
        if self.full:
            new &= size == B + 1
        return q[row[new]], at[new] - B, corr[new]


def _windows(row, place, count, xs, ys, length: int):
    """Correlations over the last ``length`` values of each series (``count`` values each, one series after the other).

    The series are cut into chunks of ``length``; a window is the end of one chunk and the start of the next, so its sums are a
    suffix sum plus a prefix sum about the mean of the two chunks: constant work a value, and no differences of long sums."""
    if not len(row):
        return np.empty(0), np.empty(0, int)
    chunks = -(-count // length)
    first = np.cumsum(chunks) - chunks
    cell = (first[row] + place // length, place % length)
    shape = (int(chunks.sum()), length)
    start = np.zeros(shape[0], bool)
    start[first[count > 0]] = True

    def laid(v):
        out = np.zeros(shape)
        out[cell] = v
        return out

    def before(m):
        out = np.zeros(shape)
        out[1:] = m[:-1]
        out[start] = 0
        return out

    def window(now, old):
        tail = np.zeros(shape)
        tail[:, :-1] = np.cumsum(old[:, :0:-1], axis=1)[:, ::-1]
        return (np.cumsum(now, axis=1) + tail)[cell]

    w = laid(np.ones(len(row)))
    w0 = before(w)
    near = []
    for v in (xs, ys):
        m = laid(v)
        m0 = before(m)
        mean = ((m.sum(axis=1) + m0.sum(axis=1)) / (w.sum(axis=1) + w0.sum(axis=1)))[:, None]
        near.append(((m - mean) * w, (m0 - mean) * w0))
    (x, x0), (y, y0) = near
    n = window(w, w0)
    sx, sy = window(x, x0), window(y, y0)
    cov = window(x * y, x0 * y0) - sx * sy / n
    vx, vy = window(x * x, x0 * x0) - sx * sx / n, window(y * y, y0 * y0) - sy * sy / n
    # a side is constant where none of its values differs from the one before, which counts decide exactly
    steady = np.zeros(len(row), bool)
    for v in (xs, ys):
        moved = np.concatenate([[0], np.cumsum((v[1:] != v[:-1]) & (place[1:] > 0))])
        back = np.arange(len(row)) - np.minimum(place, length - 1)
        steady |= moved == moved[back]
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.clip(cov / np.sqrt(vx * vy), -1.0, 1.0)
    return np.where(steady | ~(vx > 0) | ~(vy > 0), np.nan, corr), n.astype(int)
