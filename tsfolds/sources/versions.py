"""Results appended under a name, each with a version of its own.

A result is written to a folder of its own, then committed: the file ``_commits/<name>/<version>`` is created where
there is none.  Writers that race for a version are told apart by that step, the later one takes the next number.  A
writer that dies before its commit leaves a folder that no reader sees; ``expire`` removes it.
"""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfolds.sources import files

COMMIT_SCHEMA = "name string, version long, folder string, written double"


def _folder(path: str, name: str, kind: str) -> str:
    return f"{path}/{kind}/{quote(name, safe='')}"


def versions(spark: SparkSession, path: str, name: str) -> list[int]:
    """The committed versions of ``name``, ascending."""
    return [int(n) for n in files.names(spark, _folder(path, name, "_commits")) if n.isdigit()]


def append(df: DataFrame, path: str, name: str) -> int:
    """Write ``df`` as the next version of ``name`` and return its number (from 0).  Nothing is seen of it before all of
    it is written."""
    spark = df.sparkSession
    folder = f"{uuid.uuid4().hex}"
    df.write.parquet(f"{_folder(path, name, 'data')}/{folder}")
    done = versions(spark, path, name)
    n = done[-1] + 1 if done else 0
    while True:
        entry = {"name": name, "version": n, "folder": folder, "written": time.time()}
        if files.create_new(spark, f"{_folder(path, name, '_commits')}/{n:020d}", json.dumps(entry)):
            return n
        n += 1


def read(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """One version of ``name`` (the last committed one unless given), with its number in ``version``; KeyError if there
    is none."""
    done = versions(spark, path, name)
    if not done or (version is not None and version not in done):
        raise KeyError(f"no version {'' if version is None else version} of {name!r} in {path}")
    n = done[-1] if version is None else version
    entry = json.loads(files.read_text(spark, f"{_folder(path, name, '_commits')}/{n:020d}"))
    return spark.read.parquet(f"{_folder(path, name, 'data')}/{entry['folder']}").withColumn("version", F.lit(n).cast("long"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """All commits of all names as a table (name, version, folder, written): with ``store.latest_version`` the last of
    each name."""
    if not files.exists(spark, f"{path}/_commits"):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    # file names that begin with "_" are unfinished; a commit's name is its number
    return spark.read.schema(COMMIT_SCHEMA).option("pathGlobFilter", "[0-9]*").option("recursiveFileLookup", True).json(f"{path}/_commits")


def expire(spark: SparkSession, path: str, name: str, keep: int = 2, grace_secs: float = 86400.0) -> list[int]:
    """Remove all but the last ``keep`` versions of ``name`` (their commits first, then their folders), and folders older
    than ``grace_secs`` that were never committed; returns the versions removed.  Give a grace longer than any write
    or read takes."""
    if keep < 1:
        raise ValueError("keep at least one version")
    commit_dir, data_dir = _folder(path, name, "_commits"), _folder(path, name, "data")
    done = versions(spark, path, name)
    kept = {json.loads(files.read_text(spark, f"{commit_dir}/{n:020d}"))["folder"] for n in done[-keep:]}
    old = done[:-keep]
    gone = [json.loads(files.read_text(spark, f"{commit_dir}/{n:020d}"))["folder"] for n in old]
    for n in old:
        files.delete(spark, f"{commit_dir}/{n:020d}")
    for folder in gone:
        files.delete(spark, f"{data_dir}/{folder}")
    fs, p = files.at(spark, data_dir)
    for f in fs.listStatus(p) if fs.exists(p) else []:
        folder = f.getPath().getName()
        if folder not in kept and folder not in gone and f.getModificationTime() / 1000.0 < time.time() - grace_secs:
            files.delete(spark, f"{data_dir}/{folder}")
    return old
