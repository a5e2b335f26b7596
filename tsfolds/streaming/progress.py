"""Live job progress from an append-only progress log.

The reference polls every child job each 5 s and writes ETAs on every step.
Here the log is a stream of files ``(name, parent, ts, pct_complete)``:

* :func:`progress` keeps one row of state per job (its latest reading) and emits
  what a changed job adds to its parent; each micro-batch writes these sums per (parent, fold)
  as a delta (``sources.deltas``), so its work follows the jobs that changed.  Read
  together they equal the batch roll-up (D9).
* :func:`eta` keeps the previous reading of each job in
  ``applyInPandasWithState`` and emits the ETA of every new reading (D10);
  readings older than the last one seen for the job are ignored.
* :func:`eta_ordered` is D10 in event time: readings wait until the watermark has
  passed them and leave in time order; late ones go to a side output; the state of an
  idle job ends.

Checkpoints of both queries live under the session's ``spark.checkpoint.dir``
(the shared folder of the cluster), so a restarted query resumes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tsfolds.functions import safe_div
from tsfolds.session import ship
from tsfolds.sources import deltas
from tsfolds.sources.landing import checkpoint_for

LOG_SCHEMA = "name string, parent string, ts timestamp_ntz, pct_complete double"


MAX_FILES = 256  # log files of a micro-batch, unless another number is given: one job's readings of a batch are one frame


def read_log(spark: SparkSession, in_dir: str, max_files: int | None = MAX_FILES) -> DataFrame:
    r = spark.readStream.schema(LOG_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(in_dir)


def _micros(ts: str):
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def _moment(us: str):
    return F.timestamp_add("MICROSECOND", F.col(us), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


PART_SCHEMA = "parent string, fold string, done double, n_jobs long, n_counted long, steps long"
JOB_STATE = "us long, pct double, parent string"
NEVER = -(2**63)  # the time of a reading without one: before all others


def _parts_fn(timesteps: int):
    """What one job's new readings change in its parent: the part of its former latest reading goes, that of the new one comes."""

    def part(name: str, pct: float, parent: str | None, sign: int) -> tuple:
        bits = name.split(".")
        weight = {"train": float(timesteps), "validate": 1.0}.get(bits[1] if len(bits) > 1 else None)
        counts = weight is not None and pct == pct
        return (bits[0] if parent is None else parent, bits[2] if len(bits) > 2 else None,
                sign * weight * pct if counts else 0.0, sign, sign if counts else 0, timesteps)

    def rank(r):
        return r[0], r[1] == r[1], r[1] if r[1] == r[1] else 0.0, r[2] is not None, r[2] or ""

    def step(key, pdfs, state):
        old = state.get if state.exists else None
        if old is not None:
            old = (old[0], float("nan") if old[1] is None else old[1], old[2])
        last = old
        for df in pdfs:
            for row in zip(df["us"], df["pct_complete"], df["parent"].where(df["parent"].notna(), None)):
                if last is None or rank(row) > rank(last):
                    last = row
        if last is old:
            return
        state.update((int(last[0]), None if last[1] != last[1] else float(last[1]), last[2]))
        out = ([part(key[0], old[1], old[2], -1)] if old is not None else []) + [part(key[0], last[1], last[2], 1)]
        yield pd.DataFrame(out, columns=["parent", "fold", "done", "n_jobs", "n_counted", "steps"])

    return step


def _merge_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("parent", "fold").agg(
        F.sum("done").alias("done"), F.sum("n_jobs").alias("n_jobs"), F.sum("n_counted").alias("n_counted"), F.max("steps").alias("steps")
    )


def progress(spark: SparkSession, in_dir: str, out_path: str, timesteps: int, checkpoint: str | None = None,
             available_now: bool = True, max_files: int | None = MAX_FILES, every: int = 32):
    """K1: stream the log; keep each job's latest reading (of equal times the highest); every micro-batch
    writes what its changed jobs add to the weighted progress of their parents (D9) as the delta ``batch=<n>`` of
    ``out_path``, and every ``every`` batches the deltas are merged into a base and the old ones deleted.
    ``read_progress`` puts complete ones together, so readers never see a batch half written, and a repeated
    batch replaces its own folder only.  Returns the query."""
    ship(spark)
    log = read_log(spark, in_dir, max_files).select(
        "name", F.coalesce(_micros("ts"), F.lit(NEVER)).alias("us"), "pct_complete", "parent"
    ).where(F.col("name").isNotNull())
    parts = log.groupBy("name").applyInPandasWithState(_parts_fn(timesteps), PART_SCHEMA, JOB_STATE, "append", GroupStateTimeout.NoTimeout)

    def add(batch: DataFrame, n: int) -> None:
        deltas.write(_merge_parts(batch), out_path, n, _merge_parts, every)

    w = parts.writeStream.outputMode("append").foreachBatch(add).option(
        "checkpointLocation", checkpoint_for(spark, "progress", checkpoint, in_dir, out_path)
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def read_progress(spark: SparkSession, out_path: str) -> DataFrame:
    """The present (parent, folds, pct_complete) of ``progress``'s result."""
    parts = deltas.read(spark, out_path, _merge_parts, PART_SCHEMA).where("n_jobs > 0")
    g = parts.groupBy("parent").agg(
        F.sum(F.when(F.col("n_counted") > 0, F.col("done"))).alias("_done"), F.count_distinct("fold").alias("folds"), F.max("steps").alias("_steps")
    )
    return g.select("parent", "folds", safe_div(F.col("_done"), (F.col("_steps") + 1).cast("double") * F.col("folds")).alias("pct_complete"))


ETA_SCHEMA = "name string, ts timestamp_ntz, pct_complete double, delta double, eta_secs double"
ETA_STATE = "ts timestamp_ntz, pct_complete double"


def _eta_fn(key, pdfs, state):
    """One job, one micro-batch: readings in time order (equal times by value),
    each against the previous one (the first against the state), vectorised with pandas."""
    df = pd.concat(list(pdfs))
    if df.empty:
        return
    df = df.sort_values(["ts", "pct_complete"], kind="mergesort")
    if state.exists:
        last_ts, last_p = state.get
        df = df[df["ts"] >= pd.Timestamp(last_ts)]  # late readings are ignored
    else:
        last_ts, last_p = None, None
    if df.empty:
        return
    prev_ts = df["ts"].shift(1)
    prev_p = df["pct_complete"].shift(1)
    if last_ts is not None:
        prev_ts.iloc[0], prev_p.iloc[0] = pd.Timestamp(last_ts), last_p
    delta = df["pct_complete"] - prev_p
    secs = (df["ts"] - prev_ts).dt.total_seconds() / delta * (1.0 - df["pct_complete"])
    out = pd.DataFrame(
        {"name": key[0], "ts": df["ts"], "pct_complete": df["pct_complete"], "delta": delta, "eta_secs": secs.where(delta > 0)}
    )
    state.update((df["ts"].iloc[-1].to_pydatetime(), float(df["pct_complete"].iloc[-1])))
    yield out


class _EtaProcessor(StatefulProcessor):
    """The same step as ``_eta_fn`` with a ValueState (RocksDB state store)."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", ETA_STATE)

    def handleInputRows(self, key, rows, timerValues):
        class _State:  # the GroupState-like view _eta_fn expects
            def __init__(s, vs):
                s.vs = vs

            @property
            def exists(s):
                return s.vs.exists()

            @property
            def get(s):
                return tuple(s.vs.get())

            def update(s, v):
                s.vs.update(v)

        yield from _eta_fn(key, rows, _State(self.last))

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def eta_stream(log: DataFrame, engine: str = "applyInPandasWithState") -> DataFrame:
    """K2 as a streaming DataFrame (one state row per job).  ``engine`` is
    ``applyInPandasWithState`` (any state store) or
    ``transformWithStateInPandas`` (needs the RocksDB state store provider
    in ``spark.sql.streaming.stateStore.providerClass``)."""
    ship(log.sparkSession)
    g = log.select("name", "ts", "pct_complete").groupBy("name")
    if engine == "transformWithStateInPandas":
        if log.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
            raise ValueError(f"set spark.sql.streaming.stateStore.providerClass={ROCKSDB} before starting the query")
        return g.transformWithStateInPandas(_EtaProcessor(), ETA_SCHEMA, "Append", "None")
    return g.applyInPandasWithState(_eta_fn, ETA_SCHEMA, ETA_STATE, "append", GroupStateTimeout.NoTimeout)


def eta(spark: SparkSession, in_dir: str, out_path: str, checkpoint: str | None = None, available_now: bool = True,
        max_files: int | None = MAX_FILES, engine: str = "applyInPandasWithState"):
    """K2: stream the log and append the ETA of every reading to ``out_path``
    (Parquet).  Returns the query."""
    s = eta_stream(read_log(spark, in_dir, max_files), engine).withColumn(
        "eta",
        F.when(
            F.col("eta_secs").isNotNull(),
            F.timestamp_add("MICROSECOND", F.floor(F.col("eta_secs") * 1e6).cast("long"), F.col("ts")),
        ),
    )
    w = s.writeStream.outputMode("append").format("parquet").option("path", out_path).option(
        "checkpointLocation", checkpoint_for(spark, "eta", checkpoint, in_dir, out_path)
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


ORDERED_SCHEMA = "name string, us long, pct_complete double, delta double, eta_secs double, late boolean"
READING = "us long, pct double"


class _OrderedEta(StatefulProcessor):
    """Per job: the last reading that left, and those that wait for the watermark.  A timer is set for the earliest that waits,
    and for the end of the state after the last that left."""

    def __init__(self, expire_us: int) -> None:
        self.expire_us = expire_us

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", READING)
        self.waiting = handle.getListState("waiting", READING)

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        df = pd.concat(list(rows))
        in_time = df["us"].notna() & (df["us"] > passed)
        late = df[~in_time]
        if len(late):
            yield self._frame(key, late["us"].astype("Int64"), late["pct_complete"], late=True)
        df = df[in_time]
        if len(df):
            us = df["us"].astype("int64")
            self.waiting.appendList(list(zip(us.tolist(), df["pct_complete"].tolist())))
            self.handle.registerTimer(-(-int(us.min()) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] <= passed), key=lambda r: (r[0], r[1]))
        rest = [r for r in rows if r[0] > passed]
        last = tuple(self.last.get()) if self.last.exists() else None
        if due:
            df = pd.DataFrame(due, columns=["us", "pct"])
            us, pct = df["us"].shift(1), df["pct"].shift(1)
            if last is not None:
                us.iloc[0], pct.iloc[0] = last
            # after a longer pause the state had ended, whether or not its timer came in between
            delta = (df["pct"] - pct).where(df["us"] - us <= self.expire_us)
            secs = (df["us"] - us) / 1e6 / delta * (1.0 - df["pct"])
            yield self._frame(key, df["us"], df["pct"], delta, secs.where(delta > 0))
            last = due[-1]
            self.last.update(last)
            self.handle.registerTimer((last[0] + self.expire_us) // 1000 + 1)
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(-(-min(rest)[0] // 1000))
            else:
                self.waiting.clear()
        elif last is not None and not rest and last[0] + self.expire_us <= passed:
            self.last.clear()

    def _frame(self, key, us, pct, delta=None, secs=None, late=False):
        none = float("nan")
        return pd.DataFrame({"name": key[0], "us": us, "pct_complete": pct, "delta": none if delta is None else delta,
                             "eta_secs": none if secs is None else secs, "late": late})

    def close(self) -> None:
        pass


def eta_ordered(spark: SparkSession, in_dir: str, out_path: str, checkpoint: str | None = None, delay: str = "10 minutes",
                expire_secs: int = 7 * 86400, available_now: bool = True, max_files: int | None = MAX_FILES):
    """K2 in event time: append the ETA of every reading to ``out_path`` once the watermark (the latest time seen less
    ``delay``) has passed it; however the input is shuffled within that, the rows equal the batch result (D10) of the readings in
    time.  A reading that comes after the watermark, or has no time, goes to the partition ``late=true``, without an ETA.  A job's
    state ends ``expire_secs`` after its last reading; a later reading starts anew.  Readings of one time are ordered by value.
    Needs the RocksDB state store; returns the query."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass={ROCKSDB} before starting the query")
    ship(spark)
    log = read_log(spark, in_dir, max_files).select("name", "pct_complete", _micros("ts").alias("us"))
    # the operator sees the time as a number, so that Spark does not drop late rows before it
    log = log.withColumn("_event", F.timestamp_micros("us")).withWatermark("_event", delay)
    out = log.select("name", "us", "pct_complete").groupBy("name").transformWithStateInPandas(
        _OrderedEta(expire_secs * 1_000_000), ORDERED_SCHEMA, "Append", "EventTime"
    )
    out = out.select("name", _moment("us").alias("ts"), "pct_complete", "delta", "eta_secs", F.when(
        F.col("eta_secs").isNotNull(), F.timestamp_add("MICROSECOND", F.floor(F.col("eta_secs") * 1e6).cast("long"), _moment("us"))
    ).alias("eta"), "late")
    w = out.writeStream.outputMode("append").format("parquet").partitionBy("late").option("path", out_path).option(
        "checkpointLocation", checkpoint_for(spark, "eta_ordered", checkpoint, in_dir, out_path)
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def read_eta(spark: SparkSession, out_path: str, late: bool = False) -> DataFrame:
    """The rows of ``eta_ordered``'s result that came in time, or the late ones."""
    return spark.read.parquet(out_path).where(F.col("late") == str(late).lower()).drop("late")
