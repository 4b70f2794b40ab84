"""Lists of addresses: what is left to do, batches, retries, buckets, first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import work_dir


def remaining(wanted: DataFrame, *logs: DataFrame, key: str = "url") -> DataFrame:
    """Lines that are in no log, repeats kept."""
    for log in logs:
        wanted = wanted.join(log.select(key).distinct(), key, "left_anti")
    return wanted


def batches(wanted: DataFrame, order: str, size: int = 15, total: int = 100) -> DataFrame:
    """The first ``total`` rows in batches of ``size``. The limit comes first, so the numbering sees that many rows."""
    first = wanted.orderBy(order).limit(total)
    return first.withColumn("rn", F.row_number().over(Window.orderBy(order))).withColumn("batch_id", F.floor((F.col("rn") - 1) / size))


def outcomes(batch: DataFrame, files: DataFrame, retried: bool = False) -> DataFrame:
    """``downloaded`` where a file with the id is there, else ``retry``, or ``failed`` the second time."""
    got = files.select(F.col("stem").alias("video_id"), F.lit(True).alias("_got")).distinct()
    rows = batch.withColumn("video_id", urls.shell_id(F.col("url")))
    return rows.join(got, "video_id", "left").withColumn("outcome", F.when(F.col("_got"), F.lit("downloaded")).otherwise(F.lit("failed" if retried else "retry"))).drop("_got")


def retry_queue(first: DataFrame) -> DataFrame:
    """Rows for the second pass."""
    return first.where("outcome = 'retry'").drop("outcome")


def totals(attempts: DataFrame) -> DataFrame:
    return attempts.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("outcome") == "downloaded").alias("ok"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def url_buckets(rows: DataFrame, order: str, files: int) -> DataFrame:
    """A list of addresses parted into files of floor(n / files) + 1 lines."""
    return number_rows(rows, order).withColumn("bucket", F.floor((F.col("rn") - 1) / (F.floor(F.col("_total") / files) + 1))).drop("_total")


def number_rows(rows: DataFrame, order: str) -> DataFrame:
    """``rn`` from 1 over the whole table in order, and ``_total``, without gathering it in one task.

    Rows are sorted by range and numbered inside each range; the ranges' sizes give the offsets. The
    ranges are sampled, so they are written once and read by both steps.
    """
    spark = rows.sparkSession
    path = work_dir(spark)
    rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).withColumn("_total", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    return local.join(offsets, "_p").withColumn("rn", F.col("_k") + F.col("_before")).drop("_p", "_k", "_n", "_before")


def capped(rows: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """At most ``n`` rows for each key, in order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rn") <= n)


def lookup_by_url(videos: DataFrame, table: DataFrame) -> DataFrame:
    """The first row of a table for a video's address."""
    rows = first_seen(table, "url", "seq")
    return videos.withColumn("url", urls.watch_url(F.col("video_id"))).join(rows.drop("seq"), "url", "left")


def id_union(*tables: tuple[str, DataFrame]) -> DataFrame:
    """Ids of any of the tables, with a flag for each table that has them."""
    out = None
    for name, df in tables:
        own = df.select("video_id").distinct().withColumn(name, F.lit(True))
        out = own if out is None else out.join(own, "video_id", "full")
    return out.withColumns({name: F.coalesce(name, F.lit(False)) for name, _ in tables})


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose output does not exist yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
