"""Filter interaction audit: what every order of five filters keeps, removes and loses, from one pass over documents.

Which filters a document fails is a set, and all an order's step needs is the set of filters before it and its
own: an edge of the lattice of subsets. Documents are counted by part and failed set, these counts contribute to
80 edges (already-applied subset, next filter), and the aggregated edges are joined to the 600 steps of the 120
orders, each order a path through the lattice. DataFrame functions only.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.mixing import WORD
from attesta.store import spread, table, written

FILTERS = "ABCDE"
#: A: fewer words; B: a smaller percentage of distinct words; C: a greater percentage of capitals; D: any of these characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: whether the whole text (null: empty) fails A, B, C, D."""
    text = F.coalesce(text, F.lit(""))
    # words are taken out once: the array is a lambda's argument, so it is not computed anew for each of its uses
    by_words = F.transform(
        F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)),
        lambda w: (F.size(w) < LEAST_WORDS).cast("int") + 2 * (100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w)).cast("int"),
    )[0]
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long")
    return by_words + 4 * capitals.cast("int") + 8 * text.rlike(MARKS).cast("int")


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> n, good, toxic (rows, and those of them labelled so) by part and failed (bit i: filter i of ABCDE).

    A row fails E where a smaller doc_id has an identical text (compared by SHA-256). Null ids never fail E and have
    no labels; null langs are the part ''. Repeated rows count each; an id with several labels is good or toxic
    if any of them says so. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = spread(docs).select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text_failures(F.col("text")).alias("own"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    # repeated rows are one from here on; texts are read once, what follows reads digests
    rows = written(narrow.groupBy("digest", "doc_id", "part", "own").agg(F.count("*").alias("times")), "audit-rows")
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["digest", "doc_id"], "left").withColumn("failed", F.col("own") + 16 * (F.col("doc_id").isNotNull() & F.col("first").isNull()).cast("int"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.groupBy("doc_id", "part", "failed").agg(F.sum("times").alias("times")).join(known, "doc_id", "left")
    count = lambda c: F.sum(F.when(F.col(c), F.col("times")).otherwise(0)).cast("long").alias(c)
    return rows.groupBy("part", "failed").agg(F.sum("times").alias("n"), count("good"), count("toxic"))


def edges() -> list[tuple[int, int, int]]:
    """All (applied subset, next filter) and in how many of the 120 orders each lies."""
    n = len(FILTERS)
    return [(s, f, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for f in range(n) for s in range(1 << n) if not s >> f & 1]


def steps() -> list[tuple[str, int, int, int]]:
    """All (order, step from 1, applied subset, next filter)."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[i] for i in order), k + 1, sum(1 << i for i in order[:k]), f))
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang), labels (doc_id, quality, toxic) -> part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley: 600 rows a part, zeros included.

    Nulls, repeated rows, repeated labels and ids as in failed_sets; empty texts fail A alone (and E after another); very long texts are
    judged whole; columns other than those named are not read, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sets = written(failed_sets(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic")), "audit-sets")
    lattice = spark.createDataFrame([(i, *e) for i, e in enumerate(edges())], "edge int, applied int, next int, orders long")  # 80 rows
    paths = spark.createDataFrame(steps(), "filter_order string, step int, applied int, next int")  # 600 rows
    bit = F.expr("shiftleft(1, next)")
    fails = F.col("failed").bitwiseAND(bit) != 0
    before = F.col("failed").bitwiseAND(F.col("applied")) != 0
    total = lambda when, c: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    # at most 32 sets a part, each to all 80 edges
    each = sets.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(len(edges()) - 1)))).join(F.broadcast(lattice), "edge")
    counted = each.groupBy("part", "applied", "next", "orders").agg(
        total(~before & ~fails, "n").alias("kept"), total(~before & fails, "n").alias("removed"), total(before & fails, "n").alias("redundant"), total(F.col("failed") == bit, "n").alias("unique_fails"), total(~before & fails, "good").alias("good_lost"), total(~before & fails, "toxic").alias("toxic_lost"),
    )
    shares = counted.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    walked = counted.join(F.broadcast(paths), ["applied", "next"]).join(shares, ["part", "next"])
    return walked.select("part", "filter_order", "step", *MEASURES, "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All documents by language through every order of the five filters; awkward rows as in audit."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
with t as (select doc_id, coalesce(lang, '') part, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) caps from documents),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) good, bool_or(coalesce(toxic = 1, false)) toxic from labels group by doc_id),
m as (select part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * caps > 10 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(t.doc_id > min(t.doc_id) over (partition by text), false)::int f,
  coalesce(good, false) good, coalesce(toxic, false) toxic from t left join l using (doc_id)),
s as (select part, f, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from m group by part, f),
c as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select a.x || b.x || c1.x || d.x || e.x filter_order from c a, c b, c c1, c d, c e where len(list_distinct([a.x, b.x, c1.x, d.x, e.x])) = 5),
p as (select filter_order, unnest(range(1, 6))::int step from o),
q as (select filter_order, step, ascii(filter_order[step]) - 65 k, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::int b from p),
r as (select part, filter_order, step, k,
  sum(case when f & coalesce(b, 0) = 0 and f & (1 << k) = 0 then n else 0 end)::bigint kept, sum(case when f & coalesce(b, 0) = 0 and f & (1 << k) > 0 then n else 0 end)::bigint removed,
  sum(case when f & coalesce(b, 0) > 0 and f & (1 << k) > 0 then n else 0 end)::bigint redundant, sum(case when f = 1 << k then n else 0 end)::bigint unique_fails,
  sum(case when f & coalesce(b, 0) = 0 and f & (1 << k) > 0 then good else 0 end)::bigint good_lost, sum(case when f & coalesce(b, 0) = 0 and f & (1 << k) > 0 then toxic else 0 end)::bigint toxic_lost
  from q, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, k)::bigint shapley from r
"""
