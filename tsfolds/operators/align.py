"""Alignment of date-indexed series and the offline macro
build as one job (SURVEY 3.4).

Series are long tables ``(series_id, date, value)``; they are pivoted wide
only at the end, in a single grouped aggregate instead of N outer joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfolds.functions import safe_div
from tsfolds.operators import clean
from tsfolds.plans import blocked


def series_ids(long: DataFrame, sid: str = "series_id") -> list[str]:
    """Distinct series ids (the pivot list; one small driver-side read)."""
    return sorted(r[0] for r in long.select(sid).distinct().collect())


def merge_series(long: DataFrame, ids: Sequence[str] | None = None, sid: str = "series_id", date_col: str = "date",
                 value: str = "value") -> DataFrame:
    """Full outer merge of the series on date — one row per date that
    any series has, one column per id (NULL where a series has no value).
    Pivot with an explicit id list (no extra job to find the values).  Of several
    values of a series on a date the greatest counts."""
    ids = list(ids) if ids is not None else series_ids(long, sid)
    return long.where(F.col(sid).isin(ids)).groupBy(date_col).pivot(sid, ids).agg(F.max(value))


def merge_pairwise(frames: Sequence[DataFrame], date_col: str = "date") -> DataFrame:
    """C1, pairwise form: successive full outer joins on the date."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, date_col, "full")
    return out


def asof_forward(obs: DataFrame, releases: DataFrame, by: str = "series_id", date_col: str = "date",
                 release_col: str = "release_date", fallback: str | None = None, name: str = "release_date") -> DataFrame:
    """Forward as-of join — each observation gets the first release date
    on or after its date (same day counts).  No later release: NULL, or the
    series' last release with ``fallback="last"``.

    Observations and releases are unioned and scanned backwards in time per
    series, carrying the nearest release seen so far (a running "last
    non-NULL" in descending time, per time block plus carry-over), so no
    range join and no per-series task."""
    if fallback not in (None, "last"):
        raise ValueError("fallback must be None or 'last'")
    o = obs.withColumn("_k", F.lit(1)).withColumn("_rel", F.lit(None).cast("date"))
    r = releases.select(F.col(by), F.col(release_col).alias(date_col)).withColumn("_k", F.lit(0)).withColumn(
        "_rel", F.col(date_col)
    )
    u = o.unionByName(r, allowMissingColumns=True)
    # descending time; on the same day the release (k=0) comes first
    u = u.withColumn("_ord", -F.unix_date(F.col(date_col)).cast("long") * 2 + F.col("_k"))
    x = blocked.running(u, [by], "_ord", {"_near": ("last", "_rel")}, block=2 * blocked.block_width(u))
    x = x.where(F.col("_k") == 1)
    if fallback == "last":
        last = releases.groupBy(by).agg(F.max(release_col).alias("_last"))
        x = x.join(last, by, "left").withColumn("_near", F.coalesce("_near", "_last"))
    return x.withColumn(name, F.col("_near")).select(*obs.columns, name)


def collapse_vintages(df: DataFrame, by: Sequence[str] = ("series_id", "release_date"), date_col: str = "date",
                      value: str = "value") -> DataFrame:
    """D3: first non-NULL value per key, the earliest observation winning."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(F.min_by(value, date_col).alias(value))
    )


def daily_spine(df: DataFrame, date_col: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """C4: every calendar day from the first to the last date (per key),
    generated from the bounds (no cross join), left-joined with ``df``."""
    b = df.groupBy(*by).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    spine = b.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(date_col))
    return spine.join(df, [*by, date_col], "left")


def combine(long: DataFrame, a: str, b: str, op: str, name: str, sid: str = "series_id", date_col: str = "date",
            value: str = "value") -> DataFrame:
    """Date-aligned product or ratio of two series (full outer alignment;
    NULL where either side is missing), as a new long series ``name``."""
    x = long.where(F.col(sid) == a).select(date_col, F.col(value).alias("_a"))
    y = long.where(F.col(sid) == b).select(date_col, F.col(value).alias("_b"))
    j = x.join(y, date_col, "full")
    if op == "mul":
        val = F.col("_a") * F.col("_b")
    elif op == "div":
        val = safe_div("_a", "_b")
    else:
        raise ValueError("op must be 'mul' or 'div'")
    return j.select(F.lit(name).alias(sid), date_col, val.alias(value))


def with_crosses(long: DataFrame, crosses: Sequence[tuple[str, str, str, str]], sid: str = "series_id", date_col: str = "date",
                 value: str = "value") -> DataFrame:
    """``long`` with cross series (name, a, b, "mul" or "div") of two of its series added."""
    out = long.select(sid, date_col, value)
    for name, a, b, op in crosses:
        out = out.unionByName(combine(long, a, b, op, name, sid, date_col, value))
    return out


def macro_market(panel: DataFrame, market: DataFrame, crosses: Sequence[tuple[str, str, str, str]] = (),
                 ids: Sequence[str] | None = None) -> DataFrame:
    """The second half of the macro build: market series and their crosses merged wide, joined in
    full to the release panel on the date, then filled forward over all dates."""
    wide = merge_series(with_crosses(market, crosses), ids)
    both = panel.join(wide, "date", "full")
    return clean.ffill(both, [c for c in both.columns if c != "date"], None, "date")


def macro_build(obs: DataFrame, releases: DataFrame, conf: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """SURVEY 3.4 as one job: per-series percent change (E3), forward as-of to
    the release date (C3), first value per release (D3), one pivot (C1), a
    daily spine (C4), forward fill (E1) and dropna (B6).  ``macro_market`` adds the
    market series."""
    from tsfolds.operators.features import pct_change_by_conf

    from tsfolds.session import cut

    x = pct_change_by_conf(obs, conf, "value", "series_id", "date")
    x = asof_forward(x, releases, "series_id", "date", "release_date")
    # one row per (series, release): small; materialised so that the wide
    # half of the job starts from a short lineage
    x = cut(collapse_vintages(x.where(F.col("release_date").isNotNull())))
    wide = merge_series(x.withColumnRenamed("release_date", "date"), ids)
    cols = [c for c in wide.columns if c != "date"]
    spined = daily_spine(wide, "date")
    filled = clean.ffill(spined, cols, None, "date")
    return clean.require_all(filled)
