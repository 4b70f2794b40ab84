"""Tables in the shared folder: the only place that all executors and the driver see."""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset, as in tests, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.applicationId not in _LOCAL:
        _LOCAL[spark.sparkContext.applicationId] = home = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, home, True)
    return _LOCAL[spark.sparkContext.applicationId]


#: Rows of a table of small rows that one task writes, where their number is known.
ROWS_A_FILE = 25_000


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    With ``rows``, about how many there are, no more files are written than these need.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that no later step reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles that only finished steps read: it does once their plans are collected on the driver.

    The first collection only frees what holds the plans, so one must follow.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def tasks_for(n_bytes: int) -> int:
    """Tasks for a shuffle of ``n_bytes``: of 8 MB each at 128 MB, and growing with the fourth root of the input.

    So a task of 30 GB reads 31 MB, and one of 100 TB 240 MB (400,000 tasks).
    """
    each = (8 << 20) * max(1.0, n_bytes / (128 << 20)) ** 0.25
    return max(1, math.ceil(n_bytes / each))


def size_shuffles(spark: SparkSession, n_bytes: int) -> None:
    """At least as many partitions as ``n_bytes`` need in the joins that follow; adaptive execution joins small ones up to 16 MB."""
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(now, tasks_for(n_bytes))))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
