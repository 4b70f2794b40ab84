"""Connected components by minimum labels, distributed: edges and labels are tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(``node``, ``comp``) for every node of ``edges``; ``comp`` is the least node that it is connected to.

    Each round takes the least label of the neighbours and then the label of that label, so labels travel
    along paths at growing speed. Sums by node are combined before they are shuffled; a node with many
    edges is only the hot side of a join, which adaptive execution splits.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = materialise(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    n = both.count()
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"), F.lit(True).alias("moved")), "labels", n)
    while not labels.where("moved").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        took = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        far = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = materialise(took.join(far, "comp").select("node", F.least("comp", "up").alias("comp"), (F.least("comp", "up") != F.col("old")).alias("moved")), "labels", n)
        discard(labels)
        labels = new
    discard(both)
    out = labels.select("node", "comp")
    out._written = labels._written
    return out
