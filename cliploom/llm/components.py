"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, c): each vertex of edges (a, b) with the smallest vertex that it can reach.

    Every round takes the smallest label among the neighbours and then the label's own label, so chains shorten by half and stars
    are done at once. Rounds are written to the shared folder; only the number of changes comes to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    label = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c"), F.lit(True).alias("moved")), "labels")
    while not label.where("moved").isEmpty():
        near = both.join(label.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("n"))
        low = label.select("v", "c").join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        of = label.select(F.col("v").alias("c"), F.col("c").alias("up"))
        low = low.join(of, "c", "left").select("v", "old", F.least("c", F.coalesce("up", "c")).alias("c"))
        label = materialize(low.select("v", "c", (F.col("c") < F.col("old")).alias("moved")), "labels")
    return label.select("v", "c")
