"""Walk-forward folds: chunking, mergeable statistics, standardisation
(SURVEY 2.F, D1, D2, B10, C9).

Chunks are contiguous runs of distinct dates.  The date -> chunk table has one
row per distinct date (bounded by the calendar) and is joined back to the
panel; statistics are computed once per chunk as (n, mean, M2) partial
aggregates and combined over chunks on a table with one row per chunk, so the
number of scans and shuffles does not grow with the number of chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType

from tsfolds.functions import safe_div
from tsfolds.plans import blocked
from tsfolds.session import stored

PRESERVE = ("open", "high", "low", "close", "closeadj")


# --------------------------------------------------------------------------- B10


def numeric_columns(df: DataFrame, preserve: Sequence[str] = PRESERVE, exclude: Sequence[str] = ("chunk",)) -> list[str]:
    """Numeric columns minus the preserved price columns (schema only,
    no job)."""
    skip = set(preserve) | set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]


# --------------------------------------------------------------------------- F1-F4, C9


def date_index(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Sorted distinct dates with their 0-based position ``date_idx``.  A DATE
    column has one row per calendar day at most, which one window numbers;
    other types are numbered per time block plus a carry-over."""
    dates = df.select(date_col).where(F.col(date_col).isNotNull()).distinct()
    if isinstance(df.schema[date_col].dataType, DateType):
        return dates.select(date_col, (F.row_number().over(Window.orderBy(date_col)) - 1).cast("long").alias("date_idx"))
    return blocked.rolling(dates, [], date_col, 0, lambda w: {}, with_step="date_idx")


def _date_table(df: DataFrame, date_col: str, size: int) -> DataFrame:
    t = date_index(df, date_col).select(date_col, F.floor(F.col("date_idx") / F.lit(size)).cast("int").alias("chunk"))
    # one row per calendar day at most: a proven bound for DATE keys
    if isinstance(df.schema[date_col].dataType, DateType):
        t = F.broadcast(t)
    return t


def by_size(df: DataFrame, size: int, date_col: str = "date") -> DataFrame:
    """cut the sorted distinct dates every ``size``; the last chunk may
    be short.  Adds ``chunk`` (C9); a row without a date has none."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    return df.join(_date_table(df, date_col, size), date_col, "left")


def n_dates(df: DataFrame, date_col: str = "date") -> int:
    return df.agg(F.count_distinct(date_col)).first()[0]


def by_number(df: DataFrame, k: int, date_col: str = "date", n: int | None = None) -> DataFrame:
    """chunk size = n_dates // k; gives ceil(n / size) chunks, which can
    be more than k."""
    n = n if n is not None else n_dates(df, date_col)
    if k <= 0 or k > n:
        raise ValueError(f"cannot cut {n} dates into {k} chunks")
    return by_size(df, n // k, date_col)


def equal(df: DataFrame, k: int, date_col: str = "date", n: int | None = None) -> DataFrame:
    """k equal folds of n // k dates; remainder dates are dropped."""
    n = n if n is not None else n_dates(df, date_col)
    if k <= 0 or k > n:
        raise ValueError(f"cannot cut {n} dates into {k} folds")
    return by_size(df, n // k, date_col).where(F.col("chunk") < k)


def count_for_length(df: DataFrame, length: int, date_col: str = "date") -> int:
    """number of folds of ``length`` dates."""
    return n_dates(df, date_col) // length


# --------------------------------------------------------------------------- D1, D2


def column_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample std of every column in one aggregate."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    return df.groupBy(*by).agg(*aggs)


def _chunk_moments(df: DataFrame, cols: Sequence[str], chunk: str) -> DataFrame:
    """Per chunk and column: count, mean and M2 (= var_pop * n).  A grouped
    aggregate with map-side partial aggregation: a hot chunk costs nothing
    extra."""
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"n_{c}"),
            F.avg(c).alias(f"m_{c}"),
            (F.var_pop(c) * F.count(c)).alias(f"q_{c}"),
        ]
    return df.where(F.col(chunk).isNotNull()).groupBy(chunk).agg(*aggs)  # rows without a chunk are part of none


def _combine(mom: DataFrame, cols: Sequence[str], chunk: str, include_self: bool, first_self: bool = False) -> DataFrame:
    """Merge the moments of all earlier chunks (``include_self``: and the
    chunk itself; ``first_self``: the first chunk takes its own), on the chunk
    table (one row per chunk).  Sums are taken around a per-column reference
    (the first chunk's mean) so that large levels do not cancel."""
    w = Window.orderBy(chunk)  # one row per chunk: a small table
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if include_self else -1)
    out = [F.col(chunk)]
    for c in cols:
        n, m, q = F.col(f"n_{c}"), F.col(f"m_{c}"), F.col(f"q_{c}")
        ref = F.first(m, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out += [ref.alias(f"_r_{c}")]
    x = mom.select("*", *out[1:], (F.row_number().over(w) == 1).alias("_first"))
    own = F.col("_first") & F.lit(first_self)
    res = [F.col(chunk)]
    for c in cols:
        n, m, q, r = F.col(f"n_{c}"), F.col(f"m_{c}"), F.col(f"q_{c}"), F.col(f"_r_{c}")
        parts = (n, F.when(n > 0, n * (m - r)), F.when(n > 0, q + n * (m - r) * (m - r)))
        N, S, Q = (F.when(own, p).otherwise(F.sum(p).over(frame)) for p in parts)
        res += [N.alias(f"_N_{c}"), S.alias(f"_S_{c}"), Q.alias(f"_Q_{c}"), r.alias(f"_R_{c}")]
    y = x.select(*res)
    fin = [F.col(chunk)]
    for c in cols:
        N, S, Q, R = (F.col(f"_{k}_{c}") for k in "NSQR")
        mean = R + safe_div(S, N)
        m2 = Q - safe_div(S * S, N)
        fin += [
            F.when(N > 0, mean).alias(f"mean_{c}"),
            F.when(N > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (N - 1))).alias(f"std_{c}"),
            N.cast("long").alias(f"n_{c}"),
        ]
    return y.select(*fin)


def prior_stats(df: DataFrame, cols: Sequence[str], chunk: str = "chunk", first: str = "self") -> DataFrame:
    """Per chunk, mean and sample std of each column over all earlier
    chunks; chunk 0 uses itself (``first="self"``, the reference's rule) or
    gets NULL (``first="null"``).  One row per chunk."""
    mom = _chunk_moments(df, cols, chunk)
    return _combine(mom, cols, chunk, include_self=False, first_self=first == "self")


def cumulative_stats(df: DataFrame, cols: Sequence[str], chunk: str = "chunk") -> DataFrame:
    """Statistics of chunks 0..k for every chunk k (the expanding train set of
    fold k)."""
    return _combine(_chunk_moments(df, cols, chunk), cols, chunk, include_self=True)


def _zscore(df: DataFrame, stats: DataFrame, cols: Sequence[str], key: str, zero_std: float | None) -> DataFrame:
    x = df.join(F.broadcast(stats), key, "left")  # one row per chunk/fold
    repl = {}
    for c in cols:
        z = safe_div(F.col(c) - F.col(f"mean_{c}"), F.col(f"std_{c}"))
        if zero_std is not None:
            z = F.when(F.col(f"std_{c}") == 0, F.lit(float(zero_std))).otherwise(z)
        repl[c] = z
    return x.withColumns(repl).select(*df.columns)


def standardize_prior(
    df: DataFrame, chunk: str = "chunk", preserve: Sequence[str] = PRESERVE, cols: Sequence[str] | None = None,
    first: str = "self", zero_std: float | None = None,
) -> DataFrame:
    """z-score every numeric column (prices preserved) of chunk k with the
    statistics of chunks < k (chunk 0: itself).  Zero std gives NULL, or
    ``zero_std``; a row without a chunk has no statistics (NULL)."""
    cols = list(cols) if cols is not None else numeric_columns(df, preserve, exclude=(chunk,))
    st = prior_stats(df, cols, chunk, first).select(chunk, *[f"{p}_{c}" for c in cols for p in ("mean", "std")])
    return _zscore(df, st, cols, chunk, zero_std)


# --------------------------------------------------------------------------- F5, F6, F8, F9


def n_chunks(df: DataFrame, chunk: str = "chunk") -> int:
    return df.agg(F.max(chunk)).first()[0] + 1


def train_test(df: DataFrame, chunk: str = "chunk", k: int | None = None, folds: Sequence[int] | None = None) -> DataFrame:
    """fold f trains on chunks <= f and tests on chunk f+1, for every
    fold 0..k-2, or for those of ``folds`` only.  Adds ``fold`` and ``role``.  The output has each row once
    per fold it belongs to (the expanding window is the operator)."""
    if folds is not None:
        wanted = sorted({int(f) for f in folds})
        if not wanted or wanted[0] < 0 or (k is not None and wanted[-1] > k - 2):
            raise ValueError(f"folds must be within 0..{'k-2' if k is None else k - 2}")
        fold = F.col(chunk).cast("int")
        # the filters on the chunk reach the scan: chunks after the last wanted fold's test chunk are not read
        tr = df.where(F.col(chunk) <= wanted[-1])
        tr = tr.withColumn("fold", F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda f: f >= fold)))
        te = df.where(F.col(chunk).isin([f + 1 for f in wanted])).withColumn("fold", fold - 1)
        return tr.withColumn("role", F.lit("train")).unionByName(te.withColumn("role", F.lit("test")))
    k = k if k is not None else n_chunks(df, chunk)
    tr = df.where(F.col(chunk) <= k - 2)
    tr = tr.withColumn("fold", F.explode(F.sequence(F.col(chunk), F.lit(k - 2)))).withColumn("role", F.lit("train"))
    te = df.where(F.col(chunk) >= 1).withColumn("fold", F.col(chunk) - 1).withColumn("role", F.lit("test"))
    return tr.unionByName(te)


def standardize_train_test(df: DataFrame, cols: Sequence[str], chunk: str = "chunk", k: int | None = None, zero_std=None,
                           folds: Sequence[int] | None = None) -> DataFrame:
    """z-score both roles of every fold (or of those of ``folds``) with the train mean / std of the
    fold (chunks <= fold), from per-chunk moments merged once."""
    if folds is not None:
        st = cumulative_stats(df.where(F.col(chunk) <= max(folds)), cols, chunk).withColumnRenamed(chunk, "fold").select(
            "fold", *[f"{p}_{c}" for c in cols for p in ("mean", "std")]
        )
        return _zscore(train_test(df, chunk, k, folds), st, cols, "fold", zero_std)
    k = k if k is not None else n_chunks(df, chunk)
    st = cumulative_stats(df, cols, chunk).withColumnRenamed(chunk, "fold").select(
        "fold", *[f"{p}_{c}" for c in cols for p in ("mean", "std")]
    )
    return _zscore(train_test(df, chunk, k), st, cols, "fold", zero_std)


def prepare(
    df: DataFrame, chunk_size: int | None = None, n_folds: int | None = None, date_col: str = "date",
    preserve: Sequence[str] = PRESERVE, path: str | None = None, jobname: str | None = None,
) -> DataFrame:
    """F8: chunk (by size or number), standardise every chunk against the
    earlier ones, and optionally write the store partitioned by
    (jobname, chunk) — one job over all chunks."""
    if (chunk_size is None) == (n_folds is None):
        raise ValueError("give exactly one of chunk_size, n_folds")
    ch = by_size(df, chunk_size, date_col) if chunk_size else by_number(df, n_folds, date_col)
    out = standardize_prior(ch, "chunk", preserve)
    if path is not None:
        from tsfolds.sources import store

        store.write_chunks(out.withColumn("jobname", F.lit(jobname or "default")), path)
    return out


def gram(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """Sufficient statistics of least squares per group: count, means and central co-moments (covariance * n) of all
    pairs of ``cols``, in one aggregate.  Rows with a missing value in any of the columns are left out."""
    whole = [F.col(c).cast("double").alias(c) for c in cols]
    x = df.where(F.col(by).isNotNull()).select(by, *whole).na.drop(subset=list(cols))
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m_{c}") for c in cols]
    aggs += [(F.covar_pop(a, b) * F.count(F.lit(1))).alias(f"q_{a}_{b}") for a, b in _pairs_of(cols)]
    return x.groupBy(by).agg(*aggs)


def _pairs_of(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i:]]


def cumulative_gram(stats: DataFrame, cols: Sequence[str], chunk: str = "chunk") -> DataFrame:
    """``gram`` statistics of chunks 0..k for every chunk k, merged on the chunk table (one row per chunk).  Sums run around the
    first chunk's means, so that large levels do not cancel."""
    w = Window.orderBy(chunk)  # one row per chunk: a small table
    frame, every = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = stats.select("*", *[(F.col(f"m_{c}") - F.first(f"m_{c}").over(every)).alias(f"_d_{c}") for c in cols], *[F.first(f"m_{c}").over(every).alias(f"_r_{c}") for c in cols])
    n = F.col("n")
    sums = {"_N": n} | {f"_S_{c}": n * F.col(f"_d_{c}") for c in cols}
    sums |= {f"_Q_{a}_{b}": F.col(f"q_{a}_{b}") + n * F.col(f"_d_{a}") * F.col(f"_d_{b}") for a, b in _pairs_of(cols)}
    x = x.select(chunk, *[F.sum(v).over(frame).alias(k) for k, v in sums.items()], *[F.col(f"_r_{c}") for c in cols])
    mean = {c: F.col(f"_S_{c}") / F.col("_N") for c in cols}
    out = [F.col("_N").alias("n")] + [(F.col(f"_r_{c}") + mean[c]).alias(f"m_{c}") for c in cols]
    out += [(F.col(f"_Q_{a}_{b}") - F.col("_N") * mean[a] * mean[b]).alias(f"q_{a}_{b}") for a, b in _pairs_of(cols)]
    return x.select(chunk, *out)


def _solved(features: Sequence[str], label: str, ridge: float):
    """Coefficients of each row's normal equations (features x features): a row per chunk."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        cols, p = [*features, label], len(features)
        for batch in it:
            get = lambda name: np.array(batch.column(batch.schema.get_field_index(name)), float)  # noqa: B023,E731
            q = np.zeros((batch.num_rows, p + 1, p + 1))
            for a, b in _pairs_of(cols):
                i, j = cols.index(a), cols.index(b)
                q[:, i, j] = q[:, j, i] = get(f"q_{a}_{b}")
            scale = np.sqrt(np.maximum(q[:, range(p), range(p)], 0))
            scale[scale == 0] = 1.0
            lhs = q[:, :p, :p] / scale[:, :, None] / scale[:, None, :] + ridge * np.eye(p)
            beta = np.stack([np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b for a, b in zip(lhs, q[:, :p, p] / scale, strict=True)]) if batch.num_rows else np.zeros((0, p))
            beta /= scale
            shift = get(f"m_{label}") - (beta * np.stack([get(f"m_{c}") for c in features], axis=1)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(beta), pa.list_(pa.float64())), pa.array(shift)], ["fold", "_beta", "_shift"])

    return run


def walk_forward_linear(df: DataFrame, features: Sequence[str], label: str, chunk: str = "chunk", prediction: str = "prediction",
                        ridge: float = 0.0) -> DataFrame:
    """F9 for least squares: the linear model of chunks 0..f scores chunk f+1, for all folds from one pass over the
    rows.  Gram statistics per chunk are merged over the chunks; only features x features systems are solved, one per chunk.
    Every row of the chunks after the first comes back with ``fold`` and ``prediction``; a missing feature, or no
    row to fit on, gives NULL.  Dependent features share their effect (least norm in units of standard deviations); ``ridge`` is added to the diagonal
    of the correlations."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    cols = [*features, label]
    stats = cumulative_gram(gram(df, cols, chunk), cols, chunk)
    kind = df.schema[chunk].dataType
    schema = StructType([StructField("fold", kind), StructField("_beta", ArrayType(DoubleType())), StructField("_shift", DoubleType())])
    model = stats.mapInArrow(_solved(features, label, ridge), schema)
    # a chunk without whole rows has no row of its own: its folds use the last one before
    spine = df.select(F.col(chunk).alias("fold")).where("fold is not null").distinct().join(model, "fold", "left")  # one row per chunk
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    spine = spine.select("fold", *[F.last(c, ignorenulls=True).over(before).alias(c) for c in ("_beta", "_shift")])
    x = df.where(F.col(chunk) >= 1).withColumn("fold", F.col(chunk) - 1).join(F.broadcast(spine), "fold", "left")
    value = F.col("_shift")
    for i, c in enumerate(features):
        value = value + F.element_at("_beta", i + 1) * F.col(c)
    return x.select(*df.columns, "fold", F.nanvl(value, F.lit(None).cast("double")).alias(prediction))


def walk_forward(df: DataFrame, estimator, features: Sequence[str], label: str, chunk: str = "chunk",
                 k: int | None = None, prediction: str = "prediction") -> DataFrame:
    """fit ``estimator`` (a pyspark.ml Estimator) on chunks <= f and score
    chunk f+1, for each fold f; the union of all scored chunks.  Folds are few
    (a driver loop of distributed fits); the data never leaves the cluster.
    Rows with a missing feature are not fitted on and get a NULL prediction.  The rows are written once to the
    checkpoint folder: each fold reads them twice, and would else compute them again from the sources."""
    from pyspark.ml.feature import VectorAssembler

    df = stored(df)
    k = k if k is not None else n_chunks(df, chunk)
    va = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    whole = F.lit(True)
    for c in features:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    x = va.transform(df).withColumn("_whole", whole)
    est = estimator.copy({estimator.featuresCol: "_features", estimator.labelCol: label, estimator.predictionCol: prediction})
    outs = []
    for f in range(k - 1):
        model = est.fit(x.where((F.col(chunk) <= f) & F.col("_whole") & F.col(label).isNotNull()))
        scored = model.transform(x.where(F.col(chunk) == f + 1)).withColumn("fold", F.lit(f))
        outs.append(scored.withColumn(prediction, F.when(F.col("_whole"), F.col(prediction))).drop("_features", "_whole"))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res
