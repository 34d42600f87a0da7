"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for the end points of ``edges`` (a, b): the smallest vertex reachable from v.

    In each round every vertex and the vertex it is labelled with take the smallest label
    around, then labels jump one step ahead; the number of rounds is about the logarithm of
    the longest path. All rounds are written to the shared folder, so a lost executor costs
    one round at most, and only one sum per round reaches the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a != b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    before = None
    while True:
        total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total
        around = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        seen = materialize(labels.join(around, "v"), "around")
        hooked = seen.select("v", F.least("root", "near").alias("root")).unionByName(
            seen.where("near < root").select(F.col("root").alias("v"), F.col("near").alias("root")))
        hooked = materialize(hooked.groupBy("v").agg(F.min("root").alias("root")), "hooked")
        ahead = hooked.select(F.col("v").alias("root"), F.col("root").alias("far"))
        labels = materialize(hooked.join(ahead, "root").select("v", F.least("root", "far").alias("root")), "labels")
