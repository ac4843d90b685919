"""Shared scratch tables: the way every operator here cuts lineage.

A table is written with Spark's own writer below ``spark.checkpoint.dir`` (the folder that a
cluster shares between its machines) and read back, so a lost executor costs a re-read, not a
recomputation.  A folder of our own is made only on a local master that names none, as in tests.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a stored (compressed) table that is sent to every executor.
BROADCAST_BYTES = 8 << 20

#: A writer looks at the size of its pages and row groups after 100 rows only, and a reader holds all rows of a
#: group, or 4096, decoded at once: with rows of megabytes that grows with what a task has. So sizes are looked at row by row.
LARGE_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.block.size": 8 << 20}

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if "dir" not in _OWN:
        own = tempfile.mkdtemp(prefix="qualiframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN["dir"] = f"file://{own}"
    return _OWN["dir"]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB to Python, unless the session has chosen a size: they are held several times over in JVM and worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, "8388608")


class Scratch:
    """The scratch tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd", large_rows: bool = False) -> DataFrame:
        """Write ``df`` once and return it as a read of that table; ``large_rows`` are of megabytes each."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(compression=codec, **LARGE_ROWS if large_rows else {}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stored_bytes(self, name: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def broadcast_if_small(self, df: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
        """``df``, the table saved as ``name``, marked for broadcast if its files are within the limit; else Spark shuffles for the join."""
        return F.broadcast(df) if self.stored_bytes(name) <= limit else df

    def drop(self, *names: str, release: bool = True) -> None:
        """Delete tables that no later step reads, and (``release``) the shuffle files that only they needed."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
        if release:
            self.release()

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps."""
        gc.collect()
        self.spark._jvm.System.gc()
