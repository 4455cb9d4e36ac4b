"""Directed graphs as edge tables: closure, depth, roots, cycles, degrees; each step is one distributed join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.store import written


def full_closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """edges (child, parent) -> (start, ancestor, depth) for every node, depth the shortest distance.

    By doubling: a shortest path of up to 2 n steps has a node exactly n steps from its start, so a round joins the pairs
    n steps apart with all pairs up to n, and the number of rounds is the logarithm of the depth. No node is its own
    ancestor, on a cycle neither.
    """
    pairs = written(edges.where("child is not null and parent is not null and child <> parent").select(F.col("child").alias("start"), F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(1)), "closure")
    reach = 1
    for _ in range(max_rounds):
        ends = pairs.where(F.col("depth") == reach)
        if ends.isEmpty():
            return pairs
        on = pairs.select(F.col("start").alias("_at"), F.col("ancestor").alias("_to"), F.col("depth").alias("_more"))
        further = ends.join(on, F.col("ancestor") == F.col("_at")).where("start <> _to").select("start", F.col("_to").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))
        pairs = written(pairs.unionByName(further).groupBy("start", "ancestor").agg(F.min("depth").alias("depth")), "closure")
        reach *= 2
    raise RuntimeError(f"closure: not finished after {max_rounds} doublings")


def reachable(edges: DataFrame, starts: DataFrame, most_nodes: int) -> tuple[DataFrame, DataFrame]:
    """edges (child, parent), starts (node) -> (start, ancestor) of all nodes above a start, and the starts (start) from which a
    cycle is reached. most_nodes: as many nodes as any connected part has, at least.

    Walks of exactly 1, 2, 4, ... steps are found by joining each with itself; a start's ancestors follow from these, the
    longest first, as any distance is a sum of such lengths. So rounds grow with the logarithm of the depth, and a
    chain costs a row a node and round. A walk of as many steps as there are nodes goes round a cycle.
    """
    walks = [written(edges.where("child is not null and parent is not null").select("child", "parent").distinct(), "walks")]
    length = 1
    while length < most_nodes and not walks[-1].isEmpty():
        one = walks[-1]
        walks.append(written(one.join(one.select(F.col("child").alias("parent"), F.col("parent").alias("_to")), "parent").select("child", F.col("_to").alias("parent")).distinct(), "walks"))
        length *= 2
    reach = written(starts.select(F.col("node").alias("start"), F.col("node").alias("at")).distinct(), "reach")
    for walk in reversed(walks):
        step = reach.join(walk, F.col("at") == F.col("child")).select("start", F.col("parent").alias("at"))
        reach = written(reach.unionByName(step).distinct(), "reach")
    endless = walks[-1].select(F.col("child").alias("at")).distinct()
    looped = reach.join(endless, "at", "left_semi").select("start").distinct() if length >= most_nodes else reach.limit(0).select("start")
    return reach.where("start <> at").select("start", F.col("at").alias("ancestor")), looped


def closure(edges: DataFrame, starts: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """edges (child, parent), starts (node) -> (start, ancestor, depth), depth the shortest distance; no starts: of all nodes, by
    full_closure.

    Set semantics: a node met before is not followed again, so diamonds do not multiply and cycles end. A round's
    fresh pairs are one written table; rounds are merged as their sizes double, so a round reads few tables and each
    pair is rewritten at most once for every doubling.
    """
    if starts is None:
        return full_closure(edges)
    step = written(edges.where("child is not null and parent is not null").select("child", "parent").distinct(), "closure-step")
    front = written(starts.select(F.col("node").alias("start"), F.col("node").alias("ancestor")).distinct().withColumn("depth", F.lit(0)), "closure")
    seen: list[tuple[int, DataFrame]] = [(front.count(), front)]
    for depth in range(1, max_rounds + 1):
        reached = front.select("start", F.col("ancestor").alias("child")).join(step, "child").select("start", F.col("parent").alias("ancestor")).distinct()
        known = reduce(DataFrame.unionByName, [s for _, s in seen])
        fresh = written(reached.join(known.select("start", "ancestor"), ["start", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        n = fresh.count()  # from the footers of what was just written
        if n == 0:
            return known.where("depth > 0")
        seen.append((n, fresh))
        while len(seen) > 8 and len(seen) > 1 and seen[-2][0] <= 2 * seen[-1][0]:
            (a, x), (b, y) = seen[-2:]
            seen[-2:] = [(a + b, written(x.unionByName(y), "closure"))]
        if len(seen) > 16:
            seen = [(sum(k for k, _ in seen), written(reduce(DataFrame.unionByName, [s for _, s in seen]), "closure"))]
        front = fresh
    raise RuntimeError(f"closure: not finished after {max_rounds} rounds")


def roots(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each start's ancestors those without a parent."""
    return reached.join(edges.select(F.col("child").alias("ancestor")).distinct(), "ancestor", "left_anti").select("start", "ancestor")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node), edges (citing, cited) -> citations inside the corpus by node, zero kept, self-citations left out."""
    inside = edges.where("citing <> cited").distinct().groupBy(F.col("cited").alias("node")).agg(F.count("*").alias("n"))
    return nodes.join(inside, "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("in_degree"))


def reference_split(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """By citing node: references inside the corpus and outside it (references to itself count as outside)."""
    known = nodes.select(F.col("node").alias("cited"), F.lit(True).alias("known"))
    marked = edges.join(known, "cited", "left").withColumn("inside", F.coalesce("known", F.lit(False)) & (F.col("citing") != F.col("cited")))
    return marked.groupBy("citing").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node, edge, duplicate-edge and external-reference counts in one row."""
    known = nodes.select(F.col("node").alias("cited"), F.lit(True).alias("known"))
    counted = edges.groupBy("citing", "cited").agg(F.count("*").alias("times")).join(known, "cited", "left")
    inside = F.coalesce("known", F.lit(False)) & (F.col("citing") != F.col("cited"))
    e = counted.agg(F.count_if(inside).alias("edges"), F.coalesce(F.sum(F.when(inside, F.col("times") - 1)), F.lit(0)).cast("long").alias("duplicate_edges"), F.coalesce(F.sum(F.when(~inside, F.col("times"))), F.lit(0)).cast("long").alias("external"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(e))  # one row each


def ring(nodes: DataFrame, by: list[str], order: str) -> DataFrame:
    """Each member of a group paired with the next, the last with the first."""
    w = Window.partitionBy(*by).orderBy(order)
    first = F.first(order).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return nodes.withColumn("reviews", F.coalesce(F.lead(order).over(w), first))
