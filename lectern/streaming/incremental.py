"""Scoring that can stop and go on: results are appended by micro-batch, and what is there is not done again.

The checkpoint keeps the place in the input; the anti-join with the results makes a batch that is run
twice harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import exists

KEYS = ["video_id", "unit_id"]


def score_stream(units: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: list[str] | None = None) -> StreamingQuery:
    """Score the units of a stream that have no result yet and append the results. Runs until its input is used up."""
    keys = keys or KEYS

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        todo = df
        if exists(spark, out):
            done = spark.read.parquet(out).select(*keys).distinct()
            todo = df.join(done, keys, "left_anti")
        score(todo).write.mode("append").parquet(out)

    return units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def paced(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of text or parquet files, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


# --- extensions: windows over events, which the studied workflow itself does not have


def tumbling(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window; with ``late`` a watermark, for streams."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
