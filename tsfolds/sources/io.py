"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tsfolds.operators import clean


def read_panel_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, date_col: str = "date",
                   date_fmt: str | None = None, errors: str = "raise") -> DataFrame:
    """A1: CSV panel with a header.  An explicit schema avoids the inference
    pass; without one, types are inferred.  A blank header cell (the index
    column of an exported frame) is dropped; text dates are parsed natively."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = clean.drop_blank_index(r.csv(path))
    if date_fmt is not None and date_col in df.columns:
        df = clean.parse_dates(df, date_col, date_fmt, errors)
    return df


def read_table(spark: SparkSession, name_or_path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A3: a table by catalog name, or a path in ``fmt`` (parquet, orc, csv,
    json, jdbc with ``url``/``dbtable`` and partitioning options)."""
    if fmt == "table":
        return spark.read.table(name_or_path)
    r = spark.read.format(fmt).options(**options)
    return r.load() if fmt == "jdbc" else r.load(name_or_path)


def write_table(df: DataFrame, name_or_path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by=None, **options) -> None:
    """A4: replace (or append to) a table."""
    w = df.write.mode(mode).options(**options)
    if mode == "overwrite":
        w = w.option("partitionOverwriteMode", options.get("partitionOverwriteMode", "static"))  # replace all, not some partitions
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "table":
        w.saveAsTable(name_or_path)
    else:
        w.format(fmt).save(name_or_path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


MONITOR_SCHEMA = "r double, l long, t double"


def read_monitor_logs(spark: SparkSession, log_dir: str) -> DataFrame:
    """Every monitor log under ``log_dir`` (``#{json}`` line skipped,
    then ``r,l,t``), with the file it came from and the ``t_start`` of its
    JSON header."""
    rows = (
        spark.read.option("header", True).option("comment", "#").option("recursiveFileLookup", True)
        .schema(MONITOR_SCHEMA).csv(log_dir)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    heads = (
        spark.read.option("recursiveFileLookup", True).text(log_dir)
        .where(F.col("value").startswith("#"))
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.get_json_object(F.expr("substring(value, 2)"), "$.t_start").cast("double").alias("t_start"),
        )
    )
    return rows.join(heads, "file", "left")


def read_series(spark: SparkSession, path: str, fmt: str = "csv", id_from: str = "file", errors: str = "null") -> DataFrame:
    """A10: landed series files to a long ``(series_id, date, value)`` table.
    One file per series (``id_from="file"``: the id is the file name without
    extension) holding ``date,value`` rows; or files that already carry a
    ``series_id`` column (``id_from="column"``).  A value that is no number, such
    as the usual ``.`` for a missing one, is NULL (``errors="raise"``: an error)."""
    if errors not in ("raise", "null"):
        raise ValueError("errors must be 'raise' or 'null'")
    r = spark.read.option("header", True).option("recursiveFileLookup", True)
    df = r.csv(path) if fmt == "csv" else r.format(fmt).load(path)
    if id_from == "file":
        fname = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        df = df.withColumn("series_id", F.regexp_extract(fname, r"^([^.]+)", 1))
    return df.select(
        F.col("series_id").cast("string"),
        F.to_date(F.col("date")).alias("date"),
        (F.col("value").try_cast("double") if errors == "null" else F.col("value").cast("double")).alias("value"),
    )
