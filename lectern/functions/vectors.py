"""Unit vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product, summed in double precision; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def join_ordered(items: Column, glue: str = " ") -> Column:
    """Join the texts of an array of structs (position, text) by position."""
    return F.array_join(F.transform(F.sort_array(items), lambda x: x["text"]), glue)


def evenly(n: Column, k: int) -> Column:
    """``k`` evenly spaced indices below ``n``, rounded half to even, distinct; all if there are no more."""
    if k <= 1:
        # the middle of a single pick is undefined; the first is taken
        return F.when(n > 0, F.array(F.lit(0)).cast("array<int>")).otherwise(F.array().cast("array<int>"))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(k - 1)), 0).cast("int")))
    every = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(n <= k, every).otherwise(spread)
