"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source whose target is e whole epochs and a rest takes every document e times; the rest is filled with the
documents of the largest keys u ** (1 / weight), u uniform from the document, weight its quality, prefix-summed
to the budget. Prefix sums are two-level: counts per source and key bin first, then exact sums inside the one
bin where a source's budget ends, so no source is sorted in one task. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.store import table, written

#: Words are maximal runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) -> and target: the weights' shares, cut at `most` times the size, the excess reshared.

    Resharing ends where every uncut source has level * weight; the level is found from the running sums in
    order of size / weight. One row a source, null included.
    """
    by_name, by_cap, rest = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")), Window.orderBy("ratio", "rank"), Window.orderBy(F.desc("ratio"), F.desc("rank"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    summed = ranked.withColumn("cut", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("free", F.sum("w").over(rest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("whole", F.sum("source_size").over(Window.partitionBy()) * share)
    # the first source in cap order that is not cut fixes the level
    level = summed.withColumn("try", (F.col("whole") - F.col("cut")) / F.col("free")).withColumn("level", F.min(F.when(F.col("try") <= F.col("ratio"), F.struct("ratio", "rank", "try"))).over(Window.partitionBy())["try"])
    return level.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def uniform(*cols: Column) -> Column:
    """In (0, 1), from the MD5 of the columns: equal on every engine and rerun."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, quality: DataFrame | None = None, seed: int = 7, bins: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, source) -> a row for each: doc_id, source, size, source_size, target, copies, taken.

    quality (doc_id, weight): positive weights of documents in the fractional draw (null or none: 1). keep: further
    columns of docs that come along (they are written on the way). Documents without a word take part with size 0. Null sources and
    ids count as values; rows are drawn by id and text, so documents without an id are drawn apart. Repeated rows
    share a key and so stand side by side in the draw; where a budget ends among them, as many of them are taken as
    come nearest to it, so every source comes within half a document of its budget. An empty table gives an empty mix.
    """
    carried = [c for c in keep or () if c not in ("doc_id", "source")]
    narrow = docs.select("doc_id", "source", *[F.col(c).alias(f"_keep_{c}") for c in carried], n_words(F.col("text")).alias("size"), uniform(F.lit(seed), F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("_u"))
    if quality is not None:
        weighed = quality.groupBy("doc_id").agg(F.max("weight").alias("_q"))
        # with texts beside them rows go by sort and merge at every size, so that what is exchanged grows as the input does
        narrow = narrow.join(weighed.hint("merge") if carried else weighed, "doc_id", "left")
    else:
        narrow = narrow.withColumn("_q", F.lit(1.0))
    narrow = narrow.withColumn("_key", F.pow("_u", 1.0 / F.coalesce(F.col("_q"), F.lit(1.0)))).withColumn("_bin", F.floor(F.col("_key") * bins).cast("int")).withColumn("_row", F.monotonically_increasing_id())
    keyed = written(narrow.drop("_q", "_u"), "mix")
    per_bin = keyed.groupBy("source", "_bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(per_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")).withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    goal = written(goal.withColumnRenamed("source", "_s"), "mix-goal")
    down = Window.partitionBy("source").orderBy(F.desc("_bin"))
    above = per_bin.withColumn("above", F.sum("bin_size").over(down) - F.col("bin_size"))
    ends = above.join(goal, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("above") + F.col("bin_size") > F.col("budget")).groupBy("_s").agg(F.max(F.struct("_bin", "above")).alias("e"))
    plan = goal.join(ends.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", "source_size", "target", "epochs", "budget", F.coalesce(F.col("e._bin"), F.lit(-1)).alias("end_bin"), F.coalesce(F.col("e.above"), F.lit(0)).alias("above"))
    # exact sums only inside the bin where the budget ends: about 1 / bins of a source
    edge = keyed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("end_bin"))).groupBy("_s", "_key", "budget", "above").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    upto = Window.partitionBy("_s").orderBy(F.desc("_key"))
    edge = edge.withColumn("before", F.col("above") + F.sum("n").over(upto) - F.col("n")).where(F.col("before") < F.col("budget"))
    # of the last key that begins below the budget, so many rows come nearest to it; keys above it are taken whole
    fit = F.when(F.col("n") > 0, F.least("rows", F.floor((F.col("budget") - F.col("before")) * F.col("rows") / F.col("n") + 0.5))).otherwise(F.col("rows")).cast("long")
    edge = edge.groupBy("_s").agg(F.min(F.struct(F.col("_key").alias("k"), "rows", fit.alias("fit"))).alias("edge")).withColumnRenamed("_s", "_t")
    plan = plan.join(edge, F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", "source_size", "target", "epochs", "budget", "end_bin", F.col("edge.k").alias("edge_key"), F.coalesce(F.col("edge.fit"), F.lit(0)).alias("fit"), F.coalesce((F.col("edge.fit") > 0) & (F.col("edge.fit") < F.col("edge.rows")), F.lit(False)).alias("cut"))
    plan = written(plan, "mix-plan")
    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    at_edge = (F.col("_bin") == F.col("end_bin")) & (F.col("_key") == F.col("edge_key"))
    above_edge = (F.col("_bin") > F.col("end_bin")) | ((F.col("_bin") == F.col("end_bin")) & (F.col("_key") > F.col("edge_key")))
    chosen = (F.col("budget") > 0) & F.coalesce(above_edge | (at_edge & (F.col("fit") > 0)), F.lit(False))
    if plan.where("cut").isEmpty():
        rows = rows.withColumn("_chosen", chosen)
    else:  # a budget ends among repeated rows, maybe very many: they are numbered task by task, and the tasks' counts summed
        cut = F.coalesce(F.col("cut") & at_edge, F.lit(False))
        lane = F.shiftright("_row", 33)
        among = rows.where(cut).withColumn("_lane", lane).withColumn("_n", F.row_number().over(Window.partitionBy("_s", "_lane").orderBy("_row")))
        lanes = rows.where(cut).groupBy(F.col("_s").alias("_t"), lane.alias("_of")).agg(F.count("*").alias("_c"))
        lanes = lanes.withColumn("_start", F.sum("_c").over(Window.partitionBy("_t").orderBy("_of")) - F.col("_c"))
        among = among.join(lanes, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_lane") == F.col("_of"))).withColumn("_chosen", (F.col("budget") > 0) & (F.col("_n") + F.col("_start") <= F.col("fit")))
        rows = rows.where(~cut).withColumn("_chosen", chosen).unionByName(among.select(*rows.columns, "_chosen"))
    rows = rows.withColumn("copies", F.least(F.lit(most).cast("long"), F.col("epochs") + F.col("_chosen").cast("long")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in carried])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as mix() decides for it (a document that is not taken: not at all)."""
    mixed = mix(docs, keep=docs.columns, **options).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def label_weights(labels: DataFrame) -> DataFrame:
    """Weight 2 for a document labelled good, 1/2 for one labelled bad."""
    return labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.when(F.max("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by source, labelled quality weighing in the draw; awkward rows as in mix."""
    return mix(table(spark, sf_dir, "documents"), quality=label_weights(table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")


_UNIFORM = "((('0x' || substr(md5('7|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))), 1, 12))::bigint + 0.5) / 281474976710656.0)"
ORACLE = rf"""
with q as (select doc_id, max(quality) q from labels where quality in (0, 1) group by doc_id),
d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, pow({_UNIFORM}, 1.0 / case q when 1 then 2.0 when 0 then 0.5 else 1.0 end) k from documents left join q using (doc_id)),
s as (select source, sum(size)::bigint source_size from d group by source),
r as (select *, row_number() over (order by source is null, encode(source)) rk from s),
w as (select *, case (rk - 1) % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end w, 2.0 * source_size cap from r),
c as (select *, coalesce(sum(cap) over (order by cap / w, rk rows between unbounded preceding and 1 preceding), 0) cut, sum(w) over (order by cap / w desc, rk desc) free, 1.5 * (select sum(source_size) from s) whole from w),
l as (select *, (select arg_min((whole - cut) / free, (cap / w, rk)) from c where (whole - cut) / free <= cap / w) lv from c),
t as (select source, source_size, least(cap, lv * w) target, floor(least(cap, lv * w) / source_size + 1e-12)::bigint e from l where source_size > 0),
g as (select d.*, source_size, target, e, target - e * source_size b, sum(size) over (partition by d.source order by k desc) - sum(size) over same before, sum(size) over same n, count(*) over same m, row_number() over (partition by d.source, k) i from d join t on d.source is not distinct from t.source window same as (partition by d.source, k))
select doc_id, size, source_size, target, (size * least(2, e + case when b > 0 and (before + n <= b or before < b and i <= floor((b - before) * m / n + 0.5)) then 1 else 0 end))::bigint taken from g
"""
