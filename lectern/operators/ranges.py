"""Joins of two tables by time: intervals that overlap, and the last row as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Widths of bins grow by this factor from level to level.
FACTOR, LEVELS = 8, 20


def _placed(rows: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """``_level``: the finest whose bins are as wide as the interval is long, so that it touches two of them at most."""
    long = F.greatest(F.col(end).cast("double") - F.col(start).cast("double"), F.lit(0.0))
    level = F.least(F.ceil(F.greatest(F.log(float(FACTOR), F.greatest(long / width, F.lit(1.0))), F.lit(0.0)) - 1e-9), F.lit(LEVELS))
    return rows.where(F.col(start) <= F.col(end)).withColumn("_level", level.cast("int"))


def _binned(rows: DataFrame, start: str, end: str, width: float, levels: list[int], prefix: str) -> DataFrame:
    """A row for each level from the interval's own on at which either side has intervals, and each bin that it touches there."""
    at = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("_level")))
    out = rows.withColumn("_at", at).withColumn("_w", F.lit(width) * F.pow(F.lit(float(FACTOR)), F.col("_at")))
    first, last = (F.floor(F.col(c).cast("double") / F.col("_w")) for c in (start, end))
    return out.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last))).drop("_w").withColumnsRenamed({"_level": f"{prefix}level", "_first": f"{prefix}first"})


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float, most: int = 100_000) -> DataFrame:
    """Pairs of rows of equal ``on`` whose intervals (ends included) overlap. Times are numbers; ``width`` is about a usual interval's length.

    An interval is put into bins of its own length's level and of the coarser levels in use, two bins at most in each, so a very long
    one costs no more rows than a short one. A pair meets at the coarser of its two levels and in the first bin that both
    touch there: once, without a distinct. A bin with over ``most`` rows of the left side is dealt over as many tasks as it needs, to which
    its right side is copied. Rows with a null key or time, or that end before they start, have no pairs. Columns but the keys must differ.
    """
    left, right = _placed(left, *left_span, width), _placed(right, *right_span, width)
    used = left.select("_level").union(right.select("_level")).distinct()
    levels = sorted(r[0] for r in used.collect())  # at most LEVELS + 1 numbers
    a, b = _binned(left, *left_span, width, levels, "_l"), _binned(right, *right_span, width, levels, "_r")
    place = [*on, "_at", "_bin"]
    crowded = written(a.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")).where("_parts > 1"))
    if crowded.isEmpty():
        joined = a.join(b, place)
    else:
        a = a.join(crowded, place, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left_span, F.monotonically_increasing_id()), F.col("_parts"))).cast("int")).drop("_parts")
        b = b.join(crowded, place, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        joined = a.join(b, [*place, "_part"]).drop("_part")
    meet = (F.col("_at") == F.greatest("_llevel", "_rlevel")) & (F.col("_bin") == F.greatest("_lfirst", "_rfirst"))
    cross = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    return joined.where(meet & cross).drop("_at", "_bin", "_llevel", "_rlevel", "_lfirst", "_rfirst")


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, take: list[str], *, tie: str | None = None, tolerance: Column | None = None) -> DataFrame:
    """``left`` with the columns ``take`` of the last row of ``right`` of equal ``on`` and no later time; null where there is none.

    Both are dealt by ranges of key and time, so a key of any size is spread over many tasks. The last row within a range is a
    running value; the last one of the ranges before, one row for each key and range, is carried over to those that have none.
    ``tie`` orders rows of ``right`` of one key and time: the greatest counts. A row further back than ``tolerance`` (an
    interval or number, by the type of the times) is none. Null keys and times match nothing.
    """
    names = [f"_k{k}" for k in range(len(on))]
    key = [F.col(c).alias(n) for c, n in zip(on, names)]
    some = F.col(right_time).isNotNull()
    for c in on:
        some = some & F.col(c).isNotNull()
    value = F.struct(F.col(right_time).alias("time"), *[F.col(c).alias(f"t{k}") for k, c in enumerate(take)])
    order = F.col(tie) if tie else F.lit(0)
    kept = F.struct(*left.columns).alias("_row")
    shape = right.select(value.alias("v")).schema["v"].dataType
    rows = right.where(some).select(*key, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), order.alias("_tie"), value.alias("_value"), F.lit(None).cast(left.select(kept).schema["_row"].dataType).alias("_row"))
    rows = rows.unionByName(left.select(*key, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(rows.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(shape).alias("_value"), kept))
    ranged = written(rows.repartitionByRange(*names, "_time", "_side").withColumn("_p", F.spark_partition_id()))
    by = [*names, "_p"]
    upto = Window.partitionBy(*by).orderBy("_time", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranged.withColumn("_last", F.last("_value", ignorenulls=True).over(upto)).where("_side = 1")
    # of each key and range the last value, and what the ranges before leave to it
    ends = ranged.where("_side = 0").groupBy(*by).agg(F.max_by("_value", F.struct("_time", "_tie")).alias("_end"))
    places = ranged.where("_side = 1").select(*by).distinct().join(ends, by, "full")
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).where("_carried IS NOT NULL").select(*by, "_carried")
    out = seen.join(carried, by, "left").withColumn("_v", F.coalesce("_last", "_carried"))
    if tolerance is not None:
        out = out.withColumn("_v", F.when(F.col("_time") - tolerance <= F.col("_v.time"), F.col("_v")))
    return out.select("_row.*", *[F.col(f"_v.t{k}").alias(c) for k, c in enumerate(take)])
