"""Small file-system steps of the stores, through Hadoop's file API, so that they work on any path Spark can write."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """The file system of ``path`` and the path, as Hadoop objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none where there is no folder."""
    fs, p = at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` with its whole content, unless there is one: False then.  Of several writers one
    succeeds.  The content is written beside it and renamed without overwriting (HDFS decides that in one step); a
    local disk links it instead.  An object store needs a connector whose rename refuses an existing target."""
    fs, p = at(spark, path)
    fs.mkdirs(p.getParent())
    tmp = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(tmp.toUri().getPath(), p.toUri().getPath())
            except FileExistsError:
                return False
            return True
        rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        try:
            context.rename(tmp, p, how)
        except Exception as e:
            if "FileAlreadyExists" in str(getattr(e, "java_exception", e)):
                return False
            raise
        return True
    finally:
        if fs.exists(tmp):
            fs.delete(tmp, False)
