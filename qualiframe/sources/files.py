"""Small files by Spark's own file access, in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}

#: CSV options that write cells with the white space at their ends, and quotes doubled.
AS_IT_IS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master that names none, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="qualiframe-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


def put_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Write one file, for uploads and workbooks; returns its path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    return path


def put_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    """Make a file unless there is one; of several writers one gets True, as far as the store creates files atomically."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":  # Hadoop looks first and creates then
        local = hadoop.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "xb") as f:
                f.write(data)
        except FileExistsError:
            return False
        return True
    try:
        stream = fs.create(hadoop, False)
    except Py4JJavaError:
        if fs.exists(hadoop):
            return False
        raise
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    return True


def names_in(spark: SparkSession, path: str, older_than_s: float | None = None) -> list[str]:
    """Names in a folder, none if there is no such folder; only of what was not changed for some seconds."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    before = None if older_than_s is None else (time.time() - older_than_s) * 1000
    return [f.getPath().getName() for f in fs.listStatus(hadoop) if before is None or f.getModificationTime() <= before]


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def only_part(spark: SparkSession, path: str) -> str:
    """The single data file of a folder that Spark wrote."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().toString() for f in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)]
    (one,) = [n for n in names if n.rsplit("/", 1)[-1].startswith("part-")]
    return one


def write_one_csv(df: DataFrame, path: str, **options) -> str:
    """A table as one CSV file with a header, by one task; for files meant to be handed on."""
    df.coalesce(1).write.mode("overwrite").options(**AS_IT_IS | options).csv(path)
    return only_part(df.sparkSession, path)
