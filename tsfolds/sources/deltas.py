"""Keyed state kept as deltas: what a micro-batch changes is written as ``batch=<n>``, and now and then all up to a
batch is merged into ``base=<n>``.

A repeated batch replaces its own folder only.  Readers take the last complete base and the complete batches after it,
so they see whole batches.  When a base is written, what the base before it already covered is deleted: a reader has
the time of one more merge to end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tsfolds.sources import files


def _complete(spark: SparkSession, path: str, kind: str) -> list[int]:
    found = [int(n.split("=")[1]) for n in files.names(spark, path) if n.startswith(f"{kind}=")]
    return sorted(n for n in found if files.exists(spark, f"{path}/{kind}={n}/_SUCCESS"))


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders that make up the present state; FileNotFoundError where nothing is complete."""
    bases = _complete(spark, path, "base")
    after = [n for n in _complete(spark, path, "batch") if not bases or n > bases[-1]]
    found = [f"{path}/base={n}" for n in bases[-1:]] + [f"{path}/batch={n}" for n in after]
    if not found:
        raise FileNotFoundError(f"no complete batch in {path}")
    return found


def read(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], schema) -> DataFrame:
    """The present state: base and deltas through ``merge``, which takes rows of one schema and returns them with one row
    per key."""
    return merge(spark.read.schema(schema).parquet(*folders(spark, path)))


def write(df: DataFrame, path: str, batch: int, merge: Callable[[DataFrame], DataFrame], every: int = 32) -> None:
    """Write the delta ``df`` of micro-batch ``batch``; merge all into a base when ``every`` batches came since the last."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    bases = _complete(spark, path, "base")
    if len([n for n in _complete(spark, path, "batch") if not bases or n > bases[-1]]) < every or (bases and bases[-1] >= batch):
        return
    read(spark, path, merge, df.schema).write.mode("overwrite").parquet(f"{path}/base={batch}")
    if not bases:
        return
    for n in bases[:-1]:
        files.delete(spark, f"{path}/base={n}")
    for n in _complete(spark, path, "batch"):
        if n <= bases[-1]:
            files.delete(spark, f"{path}/batch={n}")
