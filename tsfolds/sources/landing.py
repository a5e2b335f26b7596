"""Incremental landing of series files (A10) and monitor logs (A9): each run takes only the files that came since the
last one, and revised values are kept by vintage.

The file source with the available-now trigger remembers the files it has read in its checkpoint.  Every micro-batch is
a delta of the table (``deltas``): rows are upserted by (series_id, date, vintage), the row of the later batch wins.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfolds.session import ensure_checkpoint_dir
from tsfolds.sources import deltas, files
from tsfolds.sources.io import MONITOR_SCHEMA

SERIES_SCHEMA = "series_id string, date date, vintage timestamp, value double, file string, batch long"
LOG_ROWS = "r double, l long, t double, file string, batch long"
MAX_FILES = 4096  # files of a micro-batch, unless another number is given


def checkpoint_for(spark: SparkSession, name: str, checkpoint: str | None, *paths: str) -> str:
    """The given checkpoint, or one per set of folders under the shared checkpoint folder: a restart of
    the same query finds it, another query does not."""
    if checkpoint:
        return checkpoint
    shared = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    key = hashlib.sha256("\n".join(paths).encode()).hexdigest()[:16]
    return os.path.join(shared, "streams", f"{name}-{key}")


def _merge_series(rows: DataFrame) -> DataFrame:
    """One row per (series_id, date, vintage): of the latest batch; inside a batch that of the greatest file name, then
    of the greatest value."""
    key = ["series_id", "date", "vintage"]
    last = rows.groupBy(*key).agg(F.max(F.struct("batch", "file", "value")).alias("_r"))
    return last.select(*key, "_r.value", "_r.file", "_r.batch")


def land_series(spark: SparkSession, in_dir: str, table: str, checkpoint: str | None = None, vintage: str = "path",
                max_files: int | None = MAX_FILES, every: int = 32):
    """A10: upsert the series files that are new in ``in_dir`` into ``table``; returns the query (it ends by itself).

    A file holds ``date,value`` rows (other headers are an error) of the series it is named after.  Its vintage
    is the ``vintage=<time>`` folder it lies in (``vintage="path"``) and otherwise, as with ``vintage="modified"``, the
    file's time of change.  A value that is no number and a date that is none are NULL."""
    if vintage not in ("path", "modified"):
        raise ValueError("vintage must be 'path' or 'modified'")
    r = spark.readStream.option("header", True).option("recursiveFileLookup", True).option("enforceSchema", False)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    path = F.col("_metadata.file_path")
    rows = r.schema("date string, value string").csv(in_dir)
    named = F.try_to_timestamp(F.url_decode(F.regexp_extract(path, r"/vintage=([^/]+)/", 1)))
    changed = F.col("_metadata.file_modification_time")
    rows = rows.select(
        F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^([^.]+)", 1).alias("series_id"),
        F.col("date").try_cast("date").alias("date"),
        (F.coalesce(named, changed) if vintage == "path" else changed).alias("vintage"),
        F.col("value").try_cast("double").alias("value"),
        path.alias("file"),
    )

    def upsert(batch: DataFrame, n: int) -> None:
        deltas.write(_merge_series(batch.withColumn("batch", F.lit(n).cast("long"))), table, n, _merge_series, every)

    return rows.writeStream.foreachBatch(upsert).option(
        "checkpointLocation", checkpoint_for(spark, "series", checkpoint, in_dir, table)
    ).trigger(availableNow=True).start()


def vintages(spark: SparkSession, table: str) -> DataFrame:
    """All landed values: (series_id, date, vintage, value, file, batch), one row per key."""
    return deltas.read(spark, table, _merge_series, SERIES_SCHEMA)


def as_of(landed: DataFrame, when=None) -> DataFrame:
    """The value of every (series_id, date) as known at ``when`` (the last vintage up to it; all vintages if not given).
    A grouped maximum, so it is combined before the shuffle."""
    if when is not None:
        landed = landed.where(F.col("vintage") <= F.lit(when).cast("timestamp"))
    last = landed.groupBy("series_id", "date").agg(F.max(F.struct("vintage", "value")).alias("_r"))
    return last.select("series_id", "date", "_r.vintage", "_r.value")


def ledger(landed: DataFrame) -> DataFrame:
    """The files behind the rows of ``vintages`` or ``monitor_rows``: (file, batch, n_rows)."""
    return landed.groupBy("file", "batch").agg(F.count(F.lit(1)).alias("n_rows"))


def land_monitor_logs(spark: SparkSession, log_dir: str, table: str, checkpoint: str | None = None,
                      max_files: int | None = MAX_FILES):
    """Append the rows of the monitor logs that are new in ``log_dir``; returns the query (it ends by itself).  A file
    is taken once, as it is then: move logs there when they are finished."""
    r = spark.readStream.option("header", True).option("comment", "#").option("recursiveFileLookup", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    rows = r.schema(MONITOR_SCHEMA).csv(log_dir).withColumn("file", F.col("_metadata.file_path"))

    def add(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{table}/batch={n}")

    return rows.writeStream.foreachBatch(add).option(
        "checkpointLocation", checkpoint_for(spark, "monitor", checkpoint, log_dir, table)
    ).trigger(availableNow=True).start()


def monitor_rows(spark: SparkSession, table: str) -> DataFrame:
    """All landed monitor rows of complete batches: (r, l, t, file, batch)."""
    if not files.exists(spark, table):
        raise FileNotFoundError(f"no complete batch in {table}")
    return spark.read.schema(LOG_ROWS).parquet(*deltas.folders(spark, table))
