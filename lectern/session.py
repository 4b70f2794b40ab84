"""Session settings that the engine's results rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "lectern", **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` replace dots by double underscores."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A folder of its own in ``spark.checkpoint.dir``, which all executors share.

    Where unset, as in tests, it is in a local temporary folder that goes when the process ends.
    """
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if home is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="lectern-")
            atexit.register(shutil.rmtree, _LOCAL[app], True)
        home = _LOCAL[app]
    return f"{home.rstrip('/')}/work-{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table in a work folder, parted by the columns ``by``, so that what is used more than once is computed once."""
    path = work_dir(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    home, p = _folder(spark, path)
    return home.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, in order; none if it is not there."""
    home, p = _folder(spark, path)
    return sorted(f.getPath().toString() for f in home.listStatus(p) if f.isDirectory()) if home.exists(p) else []


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that no later step reads."""
    for t in tables:
        discard_folder(t.sparkSession, t._written)


def discard_folder(spark: SparkSession, path: str) -> None:
    home, p = _folder(spark, path)
    home.delete(p, True)


def make_importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, wherever the driver was started.

    On a cluster the package must be shipped (``--py-files``) or installed.
    """
    import os

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (home, known) if p)
