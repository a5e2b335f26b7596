"""Rolling panel features.

Every operator is partitioned by ``by`` (ticker, run, pair ...) and ordered by
``order_by``; windows go through :mod:`tsfolds.plans.blocked`, so a hot key is
split into time blocks.  ``B`` is the lag buffer: a frame of B+1 rows.
Frames are row based: on a gappy ticker a B-row frame spans more dates
(``panel.densify`` first when calendar frames are wanted).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType, TimestampNTZType, TimestampType

from tsfolds.functions import corr_pop, log_lags, ols_weights, safe_div, safe_ln
from tsfolds.operators import lagged
from tsfolds.plans import blocked
from tsfolds.session import ship

DEFAULT_B = 10
# Fixed defaults of the reference's state frame before the buffer is full.
HURST_SEED = 0.5
RSI_SEED = 50.0


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


# --------------------------------------------------------------------------- B8 E17


def base_columns(df: DataFrame) -> DataFrame:
    """``capexratio = capex / equity``, ``spot = closeadj``, date as DATE."""
    out = df.withColumns({"capexratio": safe_div("capex", "equity"), "spot": F.col("closeadj")})
    if "date" in df.columns:
        out = out.withColumn("date", F.to_date("date"))
    return out


def rogers_satchell(df: DataFrame, o="open", h="high", l="low", c="close", name="intraday_vol") -> DataFrame:
    """ln(h/c) ln(h/o) + ln(l/c) ln(l/o)."""
    lh = lambda a, b: safe_ln(safe_div(a, b))
    return df.withColumn(name, lh(h, c) * lh(h, o) + lh(l, c) * lh(l, o))


# --------------------------------------------------------------------------- lag based


def release_indicator(df: DataFrame, col="revenue", by="ticker", order_by="date", name="release_indicator") -> DataFrame:
    """1 when ``col`` differs from the previous row of the key; first row
    and missing values give 1."""
    return blocked.rolling(
        df, _by(by), order_by, 1,
        lambda w: {name: F.coalesce((F.lag(col).over(w) != F.col(col)).cast("int"), F.lit(1))},
    )


def pct_change(df: DataFrame, col: str, n: int = 1, by="ticker", order_by="date", name: str | None = None) -> DataFrame:
    """``(x / x[-n] - 1) * 100``; NULL when the lagged value is 0 or missing."""
    name = name or f"{col}_pct"
    return blocked.rolling(
        df, _by(by), order_by, n,
        lambda w: {name: (safe_div(col, F.lag(col, n).over(w)) - 1) * 100},
    )


def pct_change_by_conf(df: DataFrame, conf: DataFrame, col="value", by="series_id", order_by="date", name="value") -> DataFrame:
    """E3 driven by a per-series configuration ``(series_id, pct_chg, n)``:
    series with the flag get the n-row percent change, others keep the value.
    The configuration is one row per series; the join is left to AQE."""
    ns = sorted({int(r["n"]) for r in conf.select("n").distinct().collect()})  # a handful of lags
    x = df.join(conf.select(by, "pct_chg", "n"), by, "left")  # AQE broadcasts it when small
    lagged = lambda w: {f"_lag{n}": F.lag(col, n).over(w) for n in ns}
    x = blocked.rolling(x, [by], order_by, max(ns), lagged)
    chosen = None
    for n in ns:
        chosen = (F.when(F.col("n") == n, F.col(f"_lag{n}")) if chosen is None else chosen.when(F.col("n") == n, F.col(f"_lag{n}")))
    pct = (safe_div(F.col(col), chosen) - 1) * 100
    out = x.withColumn(name, F.when(F.coalesce(F.col("pct_chg"), F.lit(False)), pct).otherwise(F.col(col)))
    return out.select(*[c for c in df.columns if c != name], name)


def log_return(df: DataFrame, col="close", by="ticker", order_by="date", name="ret", squared: str | None = None) -> DataFrame:
    """E4 (+E16): ``ln(x) - ln(x[-1])``; first row of each key NULL."""

    def build(w):
        r = safe_ln(col) - F.lag(safe_ln(col)).over(w)
        d = {name: r}
        if squared:
            d[squared] = F.pow(r, 2)
        return d

    return blocked.rolling(df, _by(by), order_by, 1, build)


def delta(df: DataFrame, cols: Sequence[str], by="ticker", order_by="date", suffix="_delta") -> DataFrame:
    """Last minus previous row per column; 0 when there is no previous row."""
    return blocked.rolling(
        df, _by(by), order_by, 1,
        lambda w: {c + suffix: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in cols},
    )


# --------------------------------------------------------------------------- frame aggregates


def moving_average(df: DataFrame, col: str, w: int, by="ticker", order_by="date", name: str | None = None) -> DataFrame:
    """Moving average in "valid" mode — only rows with a full window."""
    name = name or f"{col}_ma{w}"
    out = blocked.rolling(
        df, _by(by), order_by, w - 1,
        lambda ws: {
            name: F.avg(col).over(ws.rowsBetween(-(w - 1), 0)),
            "_cnt": F.count(F.lit(1)).over(ws.rowsBetween(-(w - 1), 0)),
        },
    )
    return out.where(F.col("_cnt") == w).drop("_cnt")


def range_distance(df: DataFrame, col="spot", B: int = DEFAULT_B, by="ticker", order_by="date") -> DataFrame:
    """Rolling max / x and x / rolling min over B+1 rows."""
    return blocked.rolling(
        df, _by(by), order_by, B,
        lambda w: {
            "dist_max": safe_div(F.max(col).over(w.rowsBetween(-B, 0)), F.col(col)),
            "dist_min": safe_div(F.col(col), F.min(col).over(w.rowsBetween(-B, 0))),
        },
    )


def _rank_in_frame(col: str, B: int, w) -> Column:
    """Share of the B+1-row frame strictly above the current value: B lag
    comparisons over the count of the frame (codegen, no array)."""
    above = None
    for j in range(1, B + 1):
        t = F.coalesce((F.lag(col, j).over(w) > F.col(col)).cast("int"), F.lit(0))
        above = t if above is None else above + t
    return above / F.count(col).over(w.rowsBetween(-B, 0))


def rolling_percentile(df: DataFrame, col="spot", B: int = DEFAULT_B, by="ticker", order_by="date", name="spot_rank") -> DataFrame:
    """Share of the B+1-row window strictly greater than the current value."""
    return blocked.rolling(df, _by(by), order_by, B, lambda w: {name: _rank_in_frame(col, B, w)})


def _rsi_stages(col: str, B: int):
    """Stage 1: first difference; stage 2: mean gain / loss over B rows."""
    dx = F.col("_dx")
    gain = F.when(dx.isNull(), F.lit(None)).when(dx > 0, dx).otherwise(F.lit(0.0))
    loss = F.when(dx.isNull(), F.lit(None)).when(dx < 0, -dx).otherwise(F.lit(0.0))
    return [
        lambda w: {"_dx": F.col(col) - F.lag(col).over(w)},
        lambda w: {"_up": F.avg(gain).over(w.rowsBetween(-(B - 1), 0)), "_dn": F.avg(loss).over(w.rowsBetween(-(B - 1), 0))},
    ]


def _rsi_value(up="_up", dn="_dn") -> Column:
    return F.when(F.col(dn) == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1.0 + safe_div(up, dn)))


def rsi(df: DataFrame, col="spot", B: int = DEFAULT_B, by="ticker", order_by="date", name="rsi",
        with_step: str | None = None) -> DataFrame:
    """RSI on the B differences of a B+1-row window:
    ``100 - 100 / (1 + mean gain / mean loss)``, 100 when there is no loss.
    Rows with fewer than B+1 rows in the window use the differences they have;
    the first row of a key (no difference) is NULL.  Two chained window
    stages on one exchange (all codegen, no arrays)."""
    x = blocked.rolling(df, _by(by), order_by, B, _rsi_stages(col, B), with_step=with_step)
    return x.withColumn(name, _rsi_value()).drop("_dx", "_up", "_dn")


def hurst_lags(B: int) -> list[int]:
    return list(range(2, B // 2))


def _hurst_stages(col: str, B: int):
    """Stage 1: lagged differences per lag; stage 2: their population std
    over the part of the B+1-row window where they exist, and the row count."""
    lags = hurst_lags(B)
    return [
        lambda w: {f"_hd{L}": F.col(col) - F.lag(col, L).over(w) for L in lags},
        lambda w: {
            **{f"_ht{L}": F.stddev_pop(f"_hd{L}").over(w.rowsBetween(-(B - L), 0)) for L in lags},
            "_hn": F.count(F.lit(1)).over(w.rowsBetween(-B, 0)),
        },
    ]


def _hurst_value(B: int) -> Column:
    lags = hurst_lags(B)
    ws = ols_weights(log_lags(lags))
    out = None
    for L, wl in zip(lags, ws):
        term = safe_ln(F.col(f"_ht{L}")) * F.lit(wl)
        out = term if out is None else out + term
    return F.when(F.col("_hn") == B + 1, out)


def _hurst_cols(B: int) -> list[str]:
    return [f"_hd{L}" for L in hurst_lags(B)] + [f"_ht{L}" for L in hurst_lags(B)] + ["_hn"]


def hurst(df: DataFrame, col="spot", B: int = DEFAULT_B, by="ticker", order_by="date", name="hurst") -> DataFrame:
    """Slope of ln std_pop(x[t] - x[t-L]) on ln L for L in [2, B/2),
    over a full B+1-row window (NULL before the window is full or when a
    std is 0).  The slope is a fixed linear combination of the ln std's
    (least squares on fixed abscissae); two chained window stages."""
    x = blocked.rolling(df, _by(by), order_by, B, _hurst_stages(col, B))
    return x.withColumn(name, _hurst_value(B)).drop(*_hurst_cols(B))


def hurst_structure(df: DataFrame, col="spot", by="ticker", order_by="date", max_lag: int = 300) -> DataFrame:
    """Structure-function Hurst exponent of a whole series per key.

    Lags start at L0 = min(n // 2, max_lag) and are halved (integer) while > 2;
    for each lag, tau_L = sqrt(mean((x[j+L] - x[j])^2) / mean(x[j])) over
    j < n - L; H = end-point slope of log10 tau on log10 L (first and last
    lag).  The rows are dealt once, to the time blocks of their keys, and folded
    there in order (``lagged``): a block of fewer than 2 max_lag rows gives its
    values, any other the sums of its pairs and its first and last max_lag values.
    Each key's blocks are folded the same way: no pair of rows is shuffled and no
    group holds a whole series."""
    by = _by(by)
    timed = isinstance(df.schema[order_by].dataType, (TimestampType, TimestampNTZType))
    width = blocked.block_width(df, order=order_by)
    block = blocked.block_expr(df, order_by, width if timed else max(width, 16.0 * max_lag))
    x = df.select(*by, order_by, col)
    w = Window.partitionBy(*by, "_blk").orderBy(order_by, blocked.tie_break(x))
    x = x.repartition(*by, block).withColumn("_blk", block)
    x = x.select(*by, "_blk", F.col(col).cast("double").alias("_x"), F.row_number().over(w).alias("_rn"))
    keys, of_block = x.schema.fields[: len(by)], x.schema.fields[: len(by) + 1]
    ship(df.sparkSession)
    blocks = StructType([*of_block, StructField("_n", LongType()), StructField("_x", ArrayType(DoubleType())), StructField("_sums", ArrayType(DoubleType()))])
    x = x.mapInArrow(partial(lagged.block_rows, keys=[*by, "_blk"], max_lag=max_lag), blocks)
    x = x.select(*by, "_n", "_x", "_sums", F.row_number().over(Window.partitionBy(*by).orderBy("_blk")).alias("_rn"))
    lag = StructType([StructField("lag", LongType()), StructField("square", DoubleType()), StructField("level", DoubleType())])
    x = x.mapInArrow(partial(lagged.key_rows, keys=by, max_lag=max_lag), StructType([*keys, StructField("_lags", ArrayType(lag))]))
    tau = F.transform("_lags", lambda r: F.struct(F.sqrt(safe_div(r["square"], r["level"])).alias("tau"), r["lag"].alias("lag")))
    x = x.withColumn("_tau", tau)
    hi, lo = F.get("_tau", F.lit(0)), F.get("_tau", F.size("_tau") - 1)
    value = safe_div(F.log10(hi["tau"]) - F.log10(lo["tau"]), F.log10(hi["lag"]) - F.log10(lo["lag"]))
    # a series too short for a lag, or without a key, keeps its row, with NULL
    known = reduce(and_, [F.col(k).isNotNull() for k in by], F.lit(True))
    return x.select(*by, F.when(known, value).alias("hurst_structure"))


def _causal_stages(spot: str, cols: Sequence[str], B: int):
    """Stage 1: the lagged rows of the frame (``_l0`` the oldest of B+1, with the spot as ``x`` and the features as ``c0``, ...)
    and its row count; stages 2 and 3: the filtered spot of each row of the frame (``_y0``, ...) and its correlations
    with the features (``_v0``, ..., 0 where undefined).  Rows before the key's first are left out.

    The filter y_j = x_j - x_{j-1} + y_{j-1} / 2 from zero state has the impulse response 1, -1/2, -1/4,
    -1/8, ..., so every y is a fixed combination of the lags."""
    row = F.struct(F.col(spot).cast("double").alias("x"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    names = [f"_y{i}" for i in range(B + 1)] + [f"_v{k}" for k in range(len(cols))]

    def lags(w):
        out = {f"_l{i}": F.lag(row, B - i).over(w) if i < B else row for i in range(B + 1)}
        return out | {"_rows": F.count(F.lit(1)).over(w.rowsBetween(-B, 0))}

    def evaluated(_):
        kind = "struct<" + ", ".join(f"{n}: double" for n in names) + ">"
        return {"_causal": F.arrow_udf(_causal_values(len(cols), B), kind)("_rows", *[f"_l{i}" for i in range(B + 1)])}

    return [lags, evaluated, lambda _: {n: F.col(f"_causal.{n}") for n in names}]


def _causal_values(n: int, B: int):
    """Filtered spot and its correlations with ``n`` features, a batch of rows at a time: as expressions of columns these
    are methods too long to be compiled."""

    def values(rows: pa.Array, *lags: pa.Array) -> pa.Array:
        there = rows.to_numpy() > np.arange(B, -1, -1)[:, None]

        def cells(name):
            found = [pc.struct_field(x, name) for x in lags]
            null = np.stack([x.is_null().to_numpy(zero_copy_only=False) for x in found]) & there
            return np.stack([pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False) for x in found]), null

        def deviations(v):
            return np.where(there, v - np.where(there, v, 0.0).sum(axis=0) / there.sum(axis=0), 0.0)

        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            x, x_null = cells("x")
            y = x.copy()
            for i in range(B + 1):
                for d in range(1, i + 1):
                    y[i] -= np.where(there[i - d], 0.5**d * x[i - d], 0.0)
            y_null = ~there | np.logical_or.accumulate(x_null)
            out = {f"_y{i}": pa.array(y[i], mask=y_null[i]) for i in range(B + 1)}
            dy = deviations(y)
            for k in range(n):
                c, c_null = cells(f"c{k}")
                dc = deviations(c)
                size = np.sqrt((dy * dy).sum(axis=0) * (dc * dc).sum(axis=0))
                most, least = np.where(there, c, -np.inf).max(axis=0), np.fmin.reduce(np.where(there, c, np.nan))
                flat = (most == least) | np.isnan(least)
                undefined = (x_null | c_null).any(axis=0) | flat | (size == 0)
                out[f"_v{k}"] = pa.array(np.where(undefined, 0.0, (dy * dc).sum(axis=0) / size))
        return pa.StructArray.from_arrays(list(out.values()), list(out))

    return values


def _causal_cols(n: int, B: int) -> list[str]:
    return ["_rows", "_causal", *[f"_{p}{i}" for p in "ly" for i in range(B + 1)], *[f"_v{k}" for k in range(n)]]


def causal_strength(df: DataFrame, spot="spot", cols: Sequence[str] = (), B: int = DEFAULT_B, by="ticker", order_by="date") -> DataFrame:
    """Filter the spot window from zero state (restarted in each window),
    then correlate it with each feature's window; undefined (a constant or missing
    value in the window) -> 0.  Lagged rows, and sums over them in batches."""
    x = blocked.rolling(df, _by(by), order_by, B, _causal_stages(spot, cols, B))
    return x.withColumns({f"causal_{c}": F.col(f"_v{k}") for k, c in enumerate(cols)}).drop(*_causal_cols(len(cols), B))


# --------------------------------------------------------------------------- recursive smoothing


def wilder_smooth(
    df: DataFrame, col: str | dict, seed: float | None = None, B: int = DEFAULT_B, by="ticker", order_by="date",
    step="step", name: str | None = None, dealt: bool = False,
) -> DataFrame:
    """``s_t = (v_t + (B-1) s_{t-1}) / B`` from ``seed``, updated only
    while ``step > B`` (``step`` is the 0-based row index of the key).  A NULL
    value is skipped: it leaves the state as it is and its own row is NULL.

    One blocked scan of the maps ``s -> (B-1)/B s + v/B`` (``blocked.affine``) for all columns.
    ``col`` may be a dict ``{name: (column, seed)}``.  ``dealt`` is that of ``blocked.affine``."""
    specs = col if isinstance(col, dict) else {name or f"{col}_smooth": (col, seed)}
    if B < 1:
        raise ValueError("B must be at least 1")
    by, own = _by(by), list(df.columns)
    update = {n: (F.col(step) > B) & F.col(c).isNotNull() for n, (c, _) in specs.items()}
    scans = {f"_y_{n}": (F.when(update[n], F.lit((B - 1.0) / B)), F.col(c) / F.lit(float(B)), sd) for n, (c, sd) in specs.items()}
    x = blocked.affine(df, by, order_by, scans, dealt=dealt)
    value = {n: F.when(F.col(step) <= B, F.lit(float(sd))).when(update[n], F.col(f"_y_{n}")).alias(n) for n, (_, sd) in specs.items()}
    return x.select(*[c for c in own if c not in specs], *value.values())


# --------------------------------------------------------------------------- tensors, pairs


def lag_tensor(df: DataFrame, cols: Sequence[str], n: int, by="ticker", order_by="date", name="obs") -> DataFrame:
    """The last ``n`` feature vectors per row (oldest first), padded at
    the front with the first vector while fewer than ``n`` exist."""

    def build(w):
        arr = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w.rowsBetween(-(n - 1), 0))  # arrays are never NULL
        pad = F.array_repeat(F.element_at(arr, 1), F.lit(n) - F.size(arr))
        return {name: F.concat(pad, arr)}

    return blocked.rolling(df, _by(by), order_by, n - 1, build)


def trailing_vector(df: DataFrame, col: str, B: int = DEFAULT_B, by="run_id", order_by="date", name="ret_window") -> DataFrame:
    """The last B values of ``col`` (zeros in front while fewer exist)."""

    def build(w):
        # wrapped, so that a NULL keeps its place in the vector
        arr = F.collect_list(F.struct(F.col(col).cast("double").alias("v"))).over(w.rowsBetween(-(B - 1), 0))["v"]
        return {name: F.concat(F.array_repeat(F.lit(0.0), F.lit(B) - F.size(arr)), arr)}

    return blocked.rolling(df, _by(by), order_by, B - 1, build)


def symbol_pairs(df: DataFrame, ticker="ticker", tiles: int = 16) -> DataFrame:
    """The upper triangle (a <= b) of a symbol universe, as an equi-join: symbols are dealt to ``tiles`` by hash, and
    each pair of tiles is a join key of its own.  Its n(n+1)/2 rows are what is asked for; a large universe gives
    its own ``pairs`` instead, or takes ``pairs.rolling_tiles``."""
    own = F.pmod(F.xxhash64("a"), F.lit(tiles))
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<long>"))
    seen = df.select(F.col(ticker).alias("a")).where(F.col(ticker).isNotNull()).distinct().select("a", own.alias("_i"))
    left = seen.select("a", "_i", every.alias("_j"))
    right = seen.select(F.col("a").alias("b"), every.alias("_i"), F.col("_i").alias("_j"))
    return left.join(right, (left["_i"] == right["_i"]) & (left["_j"] == right["_j"]) & (F.col("a") <= F.col("b"))).select("a", "b")


def pair_panel(df: DataFrame, col="spot", ticker="ticker", order_by="date", *, pairs: DataFrame) -> DataFrame:
    """(date, a, b, x_a, x_b) for every row (a, b) of ``pairs`` quoted on the date.
    Two equi-joins keyed on (ticker) and (date, ticker); no self-join on the
    date alone, so a busy date is never one group."""
    x = df.select(F.col(ticker).alias("a"), F.col(order_by).alias("date"), F.col(col).alias("x_a"))
    y = df.select(F.col(ticker).alias("b"), F.col(order_by).alias("date"), F.col(col).alias("x_b"))
    return x.join(pairs, "a").join(y, ["b", "date"]).select("date", "a", "b", "x_a", "x_b")


def rolling_corr(df: DataFrame, col="spot", B: int = DEFAULT_B, ticker="ticker", order_by="date", *, pairs: DataFrame) -> DataFrame:
    """Correlation of every row (a, b) of ``pairs`` over B+1 rows of common dates;
    NULL when either side is constant (the diagonal is 1 unless constant)."""
    p = pair_panel(df, col, ticker, order_by, pairs=pairs)
    return blocked.rolling(
        p, ["a", "b"], "date", B,
        lambda w: {"corr": corr_pop("x_a", "x_b", w.rowsBetween(-B, 0))},
    )


# --------------------------------------------------------------------------- E20


def panel_state(df: DataFrame, col="spot", B: int = DEFAULT_B, by="ticker", order_by="date", features: Sequence[str] = (),
                deltas: Sequence[str] = ()) -> DataFrame:
    """The per-ticker state frame of every date at once.

    Rolling columns use a frame of min(step+1, B+1) rows; Hurst, RSI,
    distances and causal strengths take their defaults (0.5, 50, 1, 1, 0)
    until step > B, after which Hurst and RSI are smoothed recursively (E18).
    ``features`` get a causal strength (E14), ``deltas`` their last change (E15).
    One exchange for the window family (two chained stages) and the smoothing, which
    goes on in the same blocks."""
    by = _by(by)
    hs, rs = _hurst_stages(col, B), _rsi_stages(col, B)
    cs = _causal_stages(col, features, B) if features else []

    def first(w):
        r = safe_ln(col) - F.lag(safe_ln(col)).over(w)
        d = {
            "ret": F.coalesce(r, F.lit(0.0)),
            "ret_sq": F.coalesce(F.pow(r, 2), F.lit(0.0)),
            "spot_rank": _rank_in_frame(col, B, w),
            "_full": F.count(F.lit(1)).over(w.rowsBetween(-(B + 1), -1)) == B + 1,
            "dist_max": safe_div(F.max(col).over(w.rowsBetween(-B, 0)), F.col(col)),
            "dist_min": safe_div(F.col(col), F.min(col).over(w.rowsBetween(-B, 0))),
        }
        d.update(hs[0](w))
        d.update(rs[0](w))
        d.update(cs[0](w) if features else {})
        d.update({f"{c}_delta": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in deltas})
        return d

    def second(w):
        return {**hs[1](w), **rs[1](w)}

    x = blocked.rolling(df, by, order_by, B + 1, [first, second, *cs[1:]], with_step="step", dealt=True)
    full = F.col("_full")
    x = x.withColumns(
        {
            "dist_max": F.when(full, F.col("dist_max")).otherwise(F.lit(1.0)),
            "dist_min": F.when(full, F.col("dist_min")).otherwise(F.lit(1.0)),
            "hurst_raw": _hurst_value(B),
            "rsi_raw": _rsi_value(),
            **{f"causal_{c}": F.when(full, F.col(f"_v{k}")).otherwise(F.lit(0.0)) for k, c in enumerate(features)},
        }
    ).drop(*_hurst_cols(B), "_dx", "_up", "_dn", *(_causal_cols(len(features), B) if features else []))
    x = wilder_smooth(x, {"hurst": ("hurst_raw", HURST_SEED), "rsi": ("rsi_raw", RSI_SEED)}, B=B, by=by, order_by=order_by, dealt=True)
    return x.drop("_full", "hurst_raw", "rsi_raw", "_blk", "_tie")


def state_row(state: DataFrame, deviations: DataFrame, trailing: DataFrame, run: str = "run_id", by: str = "ticker", order_by: str = "date") -> DataFrame:
    """The observation of every (run, date, ticker): the panel state (E20) of the symbols a run holds, their
    deviations from target (G4: run, date, ticker, deviation) and the run's trailing returns (E23: run, date,
    vector).  The correlations (E13) stay a table of pairs on the same dates."""
    x = state.join(deviations, [order_by, by])
    return x.join(trailing, [run, order_by], "left")
