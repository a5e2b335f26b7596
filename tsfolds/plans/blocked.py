"""Skew-proof per-key windows.

A plain ``Window.partitionBy("ticker").orderBy("date")`` sends every row of a
ticker to one task; when one ticker holds a third of a 100 TB panel that task
never ends.  Here every per-key window is partitioned by ``(key, time block)``:

* **Trailing bounded frames** (lag n, ``rowsBetween(-h, 0)``): a *halo*, copies of
  the last ``h`` rows before the block (they may come from several earlier blocks
  when blocks are thin), is dealt to each block beside its own rows, the window is
  evaluated per block and the copies are dropped.  The halo is at most ``h`` rows
  per block, whatever the skew.
* **Unbounded running aggregates** (cumulative sum/max/min/count) are a
  block-local running aggregate plus a carry-over from all earlier blocks,
  taken from a tiny per-block table (one row per key and block) and joined
  back on ``(key, block)`` — the same keys the window was partitioned on, so
  the big side is not shuffled again.

The block width comes from the ``tsfolds.window.blockDays`` session setting
(days for date order columns, plain units for numeric ones) and, for order
columns with a time of day, from ``tsfolds.window.blockDaysTimed`` (days, also
fractions of one; 1 by default).
Results never depend on it; tests run with narrow blocks to exercise halos.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, MapType, NumericType, TimestampNTZType, TimestampType, VariantType

BLOCK_CONF = "tsfolds.window.blockDays"
TIME_BLOCK_CONF = "tsfolds.window.blockDaysTimed"
DEFAULT_BLOCK = 366
DEFAULT_TIME_BLOCK = 1.0  # days, for order columns with a time of day

_U = Window.unboundedPreceding
_F = Window.unboundedFollowing


def block_width(df: DataFrame, block: float | None = None, order: str | None = None) -> float:
    """Width of a block in days (a part of a day too, where ``order`` has a time of day) or plain units."""
    if block is not None:
        return float(block)
    timed = order is not None and isinstance(df.schema[order].dataType, (TimestampType, TimestampNTZType))
    v = df.sparkSession.conf.get(TIME_BLOCK_CONF if timed else BLOCK_CONF, None)
    return float(v) if v else float(DEFAULT_TIME_BLOCK if timed else DEFAULT_BLOCK)


def block_expr(df: DataFrame, order: str, width: float) -> Column:
    dt = df.schema[order].dataType
    c = F.col(order)
    if isinstance(dt, (TimestampType, TimestampNTZType)):
        if isinstance(dt, TimestampNTZType):
            us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
        else:
            us = F.unix_micros(c)
        return F.floor(us / F.lit(width * 86_400e6)).cast("long")
    if isinstance(dt, DateType):
        return F.floor(F.unix_date(c) / F.lit(width)).cast("long")
    if isinstance(dt, NumericType):
        return F.floor(c / F.lit(width)).cast("long")
    raise TypeError(f"cannot block on {order}: {dt}")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; keeps the left key columns."""
    if not keys:
        raise ValueError("no keys")
    r = right.withColumnsRenamed({k: "_rk_" + k for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col("_rk_" + k))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*["_rk_" + k for k in keys])


def tie_break(df: DataFrame) -> Column:
    """A hash of the row: a total order for rows that share an order value, but for equal rows."""
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    return F.xxhash64(*cols)


Build = Callable[[WindowSpec], Mapping[str, Column]]


def _apply(df: DataFrame, stages: Sequence[Build], w: WindowSpec, extra: Sequence[Column] = ()) -> tuple[DataFrame, list[str]]:
    """Add the columns of each stage in its own projection; all stages use
    the same partitioning and order, so Spark chains the Window operators on
    one exchange and one sort."""
    names: list[str] = []
    for i, st in enumerate(stages):
        cols = dict(st(w))
        df = df.select("*", *(extra if i == 0 else ()), *[c.alias(k) for k, c in cols.items()])
        names += list(cols)
    if not stages and extra:
        df = df.select("*", *extra)
    return df, names


def rolling(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    halo: int,
    build: Build | Sequence[Build],
    block: float | None = None,
    with_step: str | None = None,
    tie: str | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Add the columns ``build(w)`` to ``df``.  Rows of one order value are ordered by the
    column ``tie`` (if given) and a hash of the row.

    ``w`` is ``partitionBy(by + block).orderBy(order)``; ``build`` may use it
    with trailing frames (``lag(c, k)``, ``rowsBetween(-k, 0)``) only.
    ``build`` may also be a list of stages, each seeing the columns of the
    previous ones; ``halo`` is the total look-back of all stages in rows.
    Results equal those of ``partitionBy(by)``.  ``with_step`` names an
    optional 0-based row index per key.  ``dealt`` keeps the columns ``_blk`` and ``_tie``, by which the rows lie
    dealt and ordered, for a scan that follows (``affine``).

    Plan shape: the rows are dealt to their blocks once and read twice. The first reading finds the
    boundary rows (the first row and the last ``halo`` rows of each block); over these, numbered per key, every
    row finds the later blocks that start within ``halo`` rows of it.  It is dealt to these blocks too, beside their own
    rows, and the second reading evaluates the windows and drops the copies.  Extra copies from further back are harmless: a
    trailing frame of at most ``halo`` rows never reaches past the contiguous run of preceding rows.
    """
    by = list(by)
    stages = list(build) if isinstance(build, (list, tuple)) else [build]
    # blocks span at least 16x the halo in order units (days), so that the
    # boundary rows stay a small share of a block
    width = block_width(df, block, order)
    if block is None and not isinstance(df.schema[order].dataType, (TimestampType, TimestampNTZType)):
        width = max(width, 16.0 * halo)
    # equal order values are ordered by a hash of the row: the rows are read for the boundaries and
    # again for the blocks, and both must see one order
    x = df.withColumn("_blk", block_expr(df, order, width)).withColumn("_tie", F.struct(F.col(tie), tie_break(df)) if tie else tie_break(df))
    cols = x.columns
    keys = by + ["_blk"]
    w = Window.partitionBy(*keys).orderBy(order, "_tie")
    x = x.repartition(*keys)
    extra = []
    if with_step is not None:
        halo = max(halo, 1)  # the row before a block tells how many there are
    if halo > 0:
        back = _halo_rows(x, by, w, halo).repartition(*keys)
        x = x.withColumn("_before", F.lit(None).cast("long")).unionByName(back)
    if with_step is not None:
        upto = w.rowsBetween(_U, 0)
        own = F.count(F.when(F.col("_before").isNull(), F.lit(1))).over(upto)
        extra = [(F.coalesce(F.max("_before").over(upto), F.lit(0)) + own - 1).cast("long").alias("_step")]
    res, feats = _apply(x, stages, w, extra)
    if halo > 0:
        res = res.where(F.col("_before").isNull())
    out = [F.col(c) for c in (cols if dealt else df.columns)] + [F.col(c) for c in feats]
    return res.select(*out, *([F.col("_step").alias(with_step)] if with_step is not None else []))


def _halo_rows(x: DataFrame, by: Sequence[str], w: WindowSpec, halo: int) -> DataFrame:
    """Copies of the last ``halo`` rows before each block, with that block as ``_blk`` and their number in the key as ``_before``."""
    cols = x.columns
    ends = x.select("*", F.row_number().over(w).alias("_rn"), F.count(F.lit(1)).over(w.rowsBetween(_U, _F)).alias("_n"))
    ends = ends.where((F.col("_rn") == 1) | (F.col("_rn") > F.col("_n") - halo))
    wk = Window.partitionBy(*by).orderBy("_blk", "_rn")
    start = F.sum(F.when(F.col("_rn") == 1, F.col("_n"))).over(wk.rowsBetween(_U, 0)) - F.col("_n")
    ends = ends.select(*cols, "_rn", (start + F.col("_rn")).alias("_before"))
    later = F.collect_list(F.when(F.col("_rn") == 1, F.struct("_before", "_blk"))).over(wk.rowsBetween(1, halo))
    ends = ends.withColumn("_to", later).withColumn("_to", F.filter("_to", lambda e: e["_before"] <= F.col("_before") + halo))
    ends = ends.select(*[c for c in cols if c != "_blk"], "_before", F.explode("_to").alias("_to"))
    return ends.select(*[F.col("_to._blk").alias(c) if c == "_blk" else F.col(c) for c in cols], "_before")


def _add(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


_COMBINE = {
    "sum": _add,
    "count": _add,
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "last": lambda a, b: F.coalesce(b, a),
}
_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
_CARRY = {"sum": "sum", "count": "sum", "max": "max", "min": "min", "last": "last"}


def running(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    aggs: Mapping[str, tuple[str, Column | str]],
    block: float | None = None,
    with_step: str | None = None,
) -> DataFrame:
    """Add cumulative aggregates ``{name: (kind, column)}``, kind in
    sum/count/max/min/last (last non-NULL value), over ``partitionBy(by).orderBy(order)`` from the first
    row to the current one, computed per time block plus a carry-over.  Rows of one order value are
    ordered by a hash of the row, in the blocks and in their totals."""
    by = list(by)
    width = block_width(df, block, order)
    x = df.withColumn("_blk", block_expr(df, order, width)).withColumn("_tie", tie_break(df))
    keys = by + ["_blk"]
    w = Window.partitionBy(*keys).orderBy(order, "_tie")
    cols = {k: (F.col(c) if isinstance(c, str) else c) for k, (_, c) in aggs.items()}
    inner = {k: _AGG[kind](cols[k]).over(w.rowsBetween(_U, 0)) for k, (kind, _) in aggs.items()}
    base = x.select("*", F.row_number().over(w).alias("_rn"), *[c.alias("_in_" + k) for k, c in inner.items()])
    # per-block totals: a grouped aggregate of the input (map-side combined,
    # no sort), then carries over the small block table
    tot = []
    for k, (kind, _) in aggs.items():
        c = cols[k]
        t = F.max_by(c, F.when(c.isNotNull(), F.struct(order, "_tie"))) if kind == "last" else _AGG[kind](c)
        tot.append(t.alias("_t_" + k))
    wb = Window.partitionBy(*by).orderBy("_blk")
    blocks = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *tot).select(
        *keys,
        *[_AGG[_CARRY[kind]](F.col("_t_" + k)).over(wb.rowsBetween(_U, -1)).alias("_c_" + k) for k, (kind, _) in aggs.items()],
        F.coalesce(F.sum("_n").over(wb.rowsBetween(_U, -1)), F.lit(0)).alias("_cum"),
    )
    res = null_safe_join(base, blocks, keys)
    out = [F.col(c) for c in df.columns]
    for k, (kind, _) in aggs.items():
        out.append(_COMBINE[kind](F.col("_c_" + k), F.col("_in_" + k)).alias(k))
    if with_step is not None:
        out.append((F.col("_cum") + F.col("_rn") - 1).cast("long").alias(with_step))
    return res.select(*out)


def running_sum_peak(
    df: DataFrame, by: Sequence[str], order: str, col: str, sum_name: str, peak_name: str, block: float | None = None
) -> DataFrame:
    """Running sum of ``col`` and its running maximum (taken over the rows
    where ``col`` is not NULL) in one blocked scan.

    Per block: the block-local running sum s and its running peak p (two
    chained windows on one exchange).  Per block b on the small block table:
    C_b = sum of the earlier block totals, G_b = max over earlier blocks j
    of (C_j + peak_j).  Row values: C_b + s and greatest(G_b, C_b + p)."""
    by = list(by)
    x = df.withColumn("_blk", block_expr(df, order, block_width(df, block, order))).withColumn("_tie", tie_break(df))
    keys = by + ["_blk"]
    w = Window.partitionBy(*keys).orderBy(order, "_tie")
    c = F.col(col)
    base = x.select(
        "*",
        F.row_number().over(w).alias("_rn"),
        F.count(F.lit(1)).over(w.rowsBetween(_U, _F)).alias("_n"),
        F.sum(c).over(w.rowsBetween(_U, 0)).alias("_s"),
    ).withColumn("_p", F.max(F.when(c.isNotNull(), F.col("_s"))).over(w.rowsBetween(_U, 0)))
    wb = Window.partitionBy(*by).orderBy("_blk")
    blocks = (
        base.where(F.col("_rn") == F.col("_n"))
        .select(*keys, "_s", "_p", F.sum("_s").over(wb.rowsBetween(_U, -1)).alias("_C"))
        .select(*keys, "_C", F.max(F.coalesce(F.col("_C"), F.lit(0.0)) + F.col("_p")).over(wb.rowsBetween(_U, -1)).alias("_G"))
    )
    res = null_safe_join(base, blocks, keys)
    return res.select(
        *df.columns,
        _add(F.col("_C"), F.col("_s")).alias(sum_name),
        F.greatest(F.col("_G"), F.coalesce(F.col("_C"), F.lit(0.0)) + F.col("_p")).alias(peak_name),
    )


def running_moments(df: DataFrame, by: Sequence[str], order: str, col: str, n: str, m2: str, block: float | None = None) -> DataFrame:
    """Add the count and the sum of squared deviations of ``col`` over the rows from a key's first to the
    current one.  Blocks keep (count, mean, M2); the earlier blocks' are merged around a reference
    mean and then merged with the block's own, so that no large squares cancel."""
    by = list(by)
    x = df.withColumn("_blk", block_expr(df, order, block_width(df, block, order))).withColumn("_tie", tie_break(df))
    keys = by + ["_blk"]
    w = Window.partitionBy(*keys).orderBy(order, "_tie").rowsBetween(_U, 0)
    c = F.col(col)
    base = x.select("*", F.count(c).over(w).alias("_n1"), F.avg(c).over(w).alias("_m1"), F.var_pop(c).over(w).alias("_v1"))
    wb = Window.partitionBy(*by).orderBy("_blk")
    blocks = x.groupBy(*keys).agg(F.count(c).alias("_n"), F.avg(c).alias("_m"), F.var_pop(c).alias("_v"))
    blocks = blocks.withColumn("_r", F.first("_m", ignorenulls=True).over(wb.rowsBetween(_U, _F)))
    d = F.col("_m") - F.col("_r")
    before = wb.rowsBetween(_U, -1)
    blocks = blocks.select(
        *keys,
        "_r",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum(F.col("_n") * d).over(before).alias("_s0"),
        F.sum(F.col("_n") * (F.col("_v") + d * d)).over(before).alias("_q0"),
    )
    res = null_safe_join(base, blocks, keys)
    mean0 = F.col("_r") + F.try_divide(F.col("_s0"), F.col("_n0"))
    m20 = F.greatest(F.col("_q0") - F.try_divide(F.col("_s0") * F.col("_s0"), F.col("_n0")), F.lit(0.0))
    m21 = F.col("_n1") * F.col("_v1")
    gap = F.col("_m1") - mean0
    total = F.col("_n0") + F.col("_n1")
    both = m20 + m21 + gap * gap * F.try_divide(F.col("_n0") * F.col("_n1"), total)
    return res.select(*df.columns, total.alias(n), F.when(F.col("_n0") == 0, m21).when(F.col("_n1") == 0, m20).otherwise(both).alias(m2))


PIECE = 300.0  # a piece of a block ends before its gains' logarithms add up to more than this


def affine(df: DataFrame, by: Sequence[str], order: str, specs: Mapping[str, tuple[Column | str, Column | str, float]],
           block: float | None = None, dealt: bool = False) -> DataFrame:
    """Add recursions ``{name: (m, c, y0)}``: ``y_t = m_t * y_(t-1) + c_t`` from ``y0``, over ``partitionBy(by).orderBy(order)``.
    A NULL in m or c leaves the state as it is.

    Maps y -> m y + c compose, so a block is one map.  Inside a block the gain is a running product P and the rest
    P * sum(c / P); a block is cut into pieces at every m = 0 and where the logarithms of the gains add up to ``PIECE``, so P
    neither vanishes nor overflows, whatever the rates.  The maps of the pieces (one row each) are then composed in
    order as a sorted stream. The states that enter the pieces are dealt to the pieces' rows, which stay where they are, and each
    row applies its piece's map to its state.  ``dealt`` takes ``_blk`` and ``_tie`` as ``rolling`` left them."""
    by, names = list(by), list(specs)
    keys = [*by, "_blk"]
    x = df
    if not dealt:
        x = df.withColumn("_blk", block_expr(df, order, block_width(df, block, order))).withColumn("_tie", tie_break(df))
    w = Window.partitionBy(*keys).orderBy(order, "_tie").rowsBetween(_U, 0)
    log, zero = F.lit(0.0), F.lit(False)
    maps = {}
    for i, (m, c, _) in enumerate(specs.values()):
        m, c = ((F.col(v) if isinstance(v, str) else v).cast("double") for v in (m, c))
        there = m.isNotNull() & c.isNotNull()
        maps |= {f"_m{i}": F.when(there, m).otherwise(1.0), f"_a{i}": F.when(there, c).otherwise(0.0)}
        log = log + F.when(F.col(f"_m{i}") == 0, 0.0).otherwise(F.abs(F.ln(F.abs(F.when(F.col(f"_m{i}") != 0, F.col(f"_m{i}"))))))
        zero = zero | (F.col(f"_m{i}") == 0)
    piece = F.floor(F.sum(log).over(w) / F.lit(PIECE)) + F.count(F.when(zero, 1)).over(w)

    def local(t: DataFrame, *more) -> DataFrame:
        t = t.withColumn("_pc", piece)
        v = Window.partitionBy(*keys, "_pc").orderBy(order, "_tie").rowsBetween(_U, 0)
        gain = lambda i: F.product(F.when(F.col(f"_m{i}") == 0, 1.0).otherwise(F.col(f"_m{i}"))).over(v)
        t = t.select("*", *[gain(i).alias(f"_g{i}") for i in range(len(names))], *[f(v) for f in more])
        rest = lambda i: (F.col(f"_g{i}") * F.sum(F.col(f"_a{i}") / F.col(f"_g{i}")).over(v)).alias(f"_s{i}")
        cut_off = lambda i: F.min(F.abs(F.col(f"_m{i}"))).over(v) == 0
        t = t.select("*", *[rest(i) for i in range(len(names))], *[cut_off(i).alias(f"_z{i}") for i in range(len(names))])
        return t.withColumns({f"_g{i}": F.when(F.col(f"_z{i}"), 0.0).otherwise(F.col(f"_g{i}")) for i in range(len(names))})

    x = x.withColumns(maps)
    parts = [f"_{k}{i}" for i in range(len(names)) for k in "gs"]
    whole = lambda v: F.count(F.lit(1)).over(v.rowsBetween(_U, _F)).alias("_n")
    narrow = x.select(*dict.fromkeys([*keys, order, "_tie", *maps]))
    ends = local(narrow, whole, lambda v: F.row_number().over(v).alias("_rn")).where("_rn = _n").select(*keys, "_pc", *parts)
    entered = _composed(ends, by, parts, [float(y0) for *_, y0 in specs.values()])
    states = [f"_y{i}" for i in range(len(names))]
    entered = entered.withColumn("_state", F.lit(True)).repartition(*keys)
    res = local(x if dealt else x.repartition(*keys)).unionByName(entered, allowMissingColumns=True)
    piece_rows = Window.partitionBy(*keys, "_pc")
    res = res.withColumns({y: F.max(y).over(piece_rows) for y in states}).where(F.col("_state").isNull())
    return res.select(*[F.col(c) for c in df.columns], *[(F.col(f"_g{i}") * F.col(f"_y{i}") + F.col(f"_s{i}")).alias(n) for i, n in enumerate(names)])


def _composed(ends: DataFrame, by: list[str], parts: list[str], start: list[float]) -> DataFrame:
    """The states (``_y0``, ...) that enter the pieces: one row per piece, streamed in order through a task per key."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    keep, n = len(by), len(start)

    def run(it):
        key, state = None, list(start)
        for batch in it:
            columns = [c.to_pylist() for c in batch.columns]
            out = [[] for _ in range(n)]
            for row in zip(*columns, strict=True):
                if key is None or row[:keep] != key:
                    key, state = row[:keep], list(start)
                for i in range(n):
                    out[i].append(state[i])
                    gain, rest = row[keep + 2 + 2 * i : keep + 4 + 2 * i]
                    state[i] = gain * state[i] + rest
            yield pa.RecordBatch.from_arrays([*batch.columns[: keep + 2], *[pa.array(o, pa.float64()) for o in out]], [*batch.schema.names[: keep + 2], *[f"_y{i}" for i in range(n)]])

    dealt = ends.repartition(*by) if by else ends.repartition(1)
    ordered = dealt.select(*by, "_blk", "_pc", *parts).sortWithinPartitions(*by, "_blk", "_pc")
    schema = StructType([*ordered.schema.fields[: keep + 2], *[StructField(f"_y{i}", DoubleType()) for i in range(n)]])
    return ordered.mapInArrow(run, schema)
