"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def bounded_sample(rows: DataFrame, by: str, each: int, max_chars: int = 60_000, most_classes: int = 2000) -> list:
    """About `each` distinct texts of every class of rows (text, by), by hash of the text: [(class, text)] in a fixed order.

    Classes with fewer usable texts give all of them. Whole texts of up to max_chars are drawn; only a class
    without any such text gives the first max_chars characters of longer ones. So at most about
    1.2 * each * max_chars characters a class reach the driver; more classes than most_classes are refused.
    """
    u = F.shiftrightunsigned(F.xxhash64("text"), 34) / float(1 << 30)
    usable = rows.where(F.col(by).isNotNull() & F.col("text").isNotNull()).select(F.col(by).alias("k"), "text", u.alias("u"), (F.length("text") <= max_chars).alias("short"))
    # of copies one counts, so a class of many copies is not drawn too thinly
    counts = usable.groupBy("k").agg(F.approx_count_distinct(F.when(F.col("short"), F.col("u"))).alias("short"), F.approx_count_distinct("u").alias("all")).limit(most_classes + 1).collect()
    if len(counts) > most_classes:
        raise ValueError(f"over {most_classes} values of {by}: not a column of classes")
    if not counts:
        return []
    shares = [(r["k"], min(1.0, 1.1 * each / (r["short"] or r["all"])), not r["short"]) for r in counts]
    plan = rows.sparkSession.createDataFrame(shares, usable.select("k").schema.add("share", "double").add("cut", "boolean"))  # at most most_classes rows
    drawn = usable.join(F.broadcast(plan), "k").where((F.col("u") < F.col("share")) & (F.col("short") | F.col("cut")))
    drawn = drawn.select("k", "u", F.when(F.col("cut"), F.substring("text", 1, max_chars)).otherwise(F.col("text")).alias("text")).distinct()
    first = F.row_number().over(Window.partitionBy("k").orderBy("u", "text"))
    return [(r["k"], r["text"]) for r in drawn.withColumn("n", first).where(F.col("n") <= each).orderBy("u", "text", "k").select("k", "text").collect()]


def labelled_sample(docs: DataFrame, labels: DataFrame, by: str, each: int, max_chars: int = 60_000) -> list:
    """At most about `each` labelled texts a class of labels[by] (0 or 1), by hash of their ids: [(class, text)].

    Only the chosen ids, at most 3 * each, are sent to the documents' scan. Texts over max_chars are left out.
    """
    known = labels.where(F.col(by).isin(0, 1)).select("doc_id", F.col(by).alias("k"), (F.shiftrightunsigned(F.xxhash64("doc_id"), 34) / float(1 << 30)).alias("u"))
    counts = {r["k"]: r["count"] for r in known.groupBy("k").count().collect()}
    share = F.when(F.col("k") == 1, min(1.0, each / max(1, counts.get(1, 0)))).otherwise(min(1.0, each / max(1, counts.get(0, 0))))
    chosen = known.where(F.col("u") < share).orderBy("u", "doc_id", "k").limit(3 * each).select("doc_id", "k")
    rows = docs.where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return sorted((r["k"], r["text"]) for r in rows.select("k", "text").limit(9 * each).collect())
