"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins on the edge list; the number of rounds grows with the
logarithm of the longest path. Only the count of changed rows comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.store import removed, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: directed both ways (large) or from the greater to the smaller node (small)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    both = edges.join(least, "u")
    if large:
        return both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) of one orderable type -> rows (node, label), label the least node of the component.

    Nulls and self-links are ignored; repeated links count once; an empty input gives an empty result.
    Raises if max_rounds do not suffice, rather than return wrong labels.
    """
    spark = edges.sparkSession
    now = written(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        mirrored = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = _star(mirrored, True).where("u <> v").distinct()
        after = written(_star(stars, False).where("u <> v").distinct(), "edges")
        old = now.inputFiles()
        # stars only: every node hangs on one root, and no root hangs on another
        done = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and after.select(F.col("v").alias("u")).join(after.select("u"), "u", "left_semi").isEmpty()
        if old:
            removed(spark, old[0].rsplit("/", 1)[0])
        now = after
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
