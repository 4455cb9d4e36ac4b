"""Exact order statistics by distributed selection: of each group only counts by bin are held, never its values.

The interval that holds a wanted rank is cut into bins of equal width; the bin with the rank, shrunk to the values it really
holds, is the next interval. As the least and the greatest value of an interval fall into different bins, every round
narrows it, and most need two or three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.store import written

BINS = 4096


def at_ranks(values: DataFrame, by: list[str], value: str, ranks: dict[str, Column], max_rounds: int = 200) -> DataFrame:
    """values (by, value) -> by, name, n, value: in each group the values at these ranks, ranks (name to a column of `n`, the
    group's number of values) counted from 0 in rising order.

    Nulls are left out, and so are groups without a value; NaN is an error, as it has no place in the order. Null groups are groups.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_"))
    rows = written(values.where(F.col(value).isNotNull()).select(group.alias("g"), F.when(F.isnan(F.col(value).cast("double")), F.raise_error(F.lit("NaN has no rank"))).otherwise(F.col(value).cast("double")).alias("v")), "ranks")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    totals = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    now = written(totals.withColumn("w", F.explode(wanted)).select("g", "n", "w.name", "w.rank", "low", "high", F.lit(0).cast("long").alias("below")), "ranks")
    for _ in range(max_rounds):
        if now.where("low < high").isEmpty():
            return now.select(*[F.col(f"g.{c}").alias(c) for c in by], "name", "n", F.col("low").alias("value"))
        intervals = now.where("low < high").select(F.col("g").alias("h"), "low", "high").distinct()
        span = F.col("high") - F.col("low")
        # halves where the span is beyond the greatest double
        share = F.when(span < float("inf"), (F.col("v") - F.col("low")) / span).otherwise((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2))
        # infinities are bins of their own, before any other
        edge = F.when(F.col("v") == float("-inf"), 0).when(F.col("v") == float("inf"), 2).otherwise(1)
        bin_ = F.when((F.col("low") == float("-inf")) | (F.col("high") == float("inf")), edge).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        inside = rows.join(intervals, F.col("g").eqNullSafe(F.col("h")) & F.col("v").between(F.col("low"), F.col("high")))
        bins = inside.groupBy("h", "low", "high", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = Window.partitionBy("h", "low", "high").orderBy("bin")  # at most BINS rows
        bins = bins.withColumn("before", F.sum("c").over(upto) - F.col("c")).withColumnsRenamed({"low": "_low", "high": "_high"})
        met = now.where("low < high").join(bins, F.col("g").eqNullSafe(F.col("h")) & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high")))
        met = met.where((F.col("rank") - F.col("below") >= F.col("before")) & (F.col("rank") - F.col("below") < F.col("before") + F.col("c")))
        after = met.select("g", "n", "name", "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("below") + F.col("before")).alias("below"))
        now = written(now.where("low = high").unionByName(after), "ranks")
    raise RuntimeError(f"ranks: not found after {max_rounds} rounds")


def medians(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median: of an even number of values the mean of the middle two."""
    n = F.col("n")
    found = at_ranks(values, by, value, {"lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2)})
    return found.groupBy(*by).agg(F.avg("value").alias("median")) if by else found.agg(F.avg("value").alias("median"))


def nearest_ranks(values: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """by, p, value: the value at index round-half-even((n - 1) p), a row for each group and p."""
    found = at_ranks(values, by, value, {repr(p): F.bround((F.col("n") - 1) * F.lit(p), 0) for p in probs})
    return found.select(*by, F.col("name").cast("double").alias("p"), "value")
