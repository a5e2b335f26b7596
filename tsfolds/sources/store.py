"""Chunk and result stores as partitioned Parquet.

The reference keeps pickled blobs keyed ``(chunk, jobname)`` in Postgres; here
a store is a Parquet folder partitioned by ``jobname`` and ``chunk``.  An
upsert is a dynamic partition overwrite (only the partitions present in the
written frame are replaced), a lookup is partition-pruned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("jobname", "chunk")


def write_chunks(df: DataFrame, path: str, parts: Sequence[str] = PARTS, order: Sequence[str] = ("date", "ticker")) -> None:
    """A5: write (upsert) chunks: rows are clustered by partition inside each
    task and ordered by ``order`` (H1: date and ticker, as far as they are there),
    and only the (jobname, chunk) partitions present are replaced.  A large
    chunk is spread over tasks of about equal size (rebalance)."""
    order = [c for c in order if c in df.columns]
    (
        df.hint("rebalance", *parts)
        .sortWithinPartitions(*parts, *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_chunk(spark: SparkSession, path: str, jobname: str, chunk: int) -> DataFrame:
    """One chunk by key (partition pruning); error if it is missing."""
    df = read_store(spark, path).where((F.col("jobname") == jobname) & (F.col("chunk") == chunk))
    if df.isEmpty():
        raise KeyError(f"no chunk {chunk} for job {jobname!r} in {path}")
    return df


def latest_version(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the highest version per key (ties broken by the
    remaining columns).  A grouped max of a struct: partial aggregation, so a
    hot key is pre-aggregated in every task instead of sorted in one."""
    rest = [c for c in df.columns if c not in keys and c != version]
    packed = F.struct(F.col(version), *[F.col(c) for c in rest])
    g = df.groupBy(*keys).agg(F.max(packed).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in [version, *rest]])


def delete_where(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Drop the rows whose key is in ``keys`` (anti-join)."""
    return df.join(keys, on, "left_anti")


def chunk_count(df: DataFrame, by: Sequence[str] = ("jobname",), chunk: str = "chunk") -> DataFrame:
    """Number of chunks per job, counted in the engine (never by fetching
    the rows)."""
    return df.groupBy(*by).agg(F.count_distinct(chunk).alias("n_chunks"))


def table_names(df: DataFrame, col: str = "table_name") -> DataFrame:
    """Distinct table names in a store."""
    return df.select(col).distinct()
