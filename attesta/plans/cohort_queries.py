"""Cohort queries over orders (submissions) and line items (reviewer slots), documents and labels (review texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import cohort as C
from attesta.operators.selection import medians
from attesta.plans.registry import query
from attesta.store import table


def slots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity").cast("long") % 6).cast("double").alias("rating"), F.col("l_linenumber").cast("double").alias("confidence"), F.col("l_extendedprice").alias("words"), "l_discount", "l_tax", "l_suppkey")


def records(spark: SparkSession, d: str, track: bool = False, replies: bool = False) -> DataFrame:
    """Submissions with their ratings; those without a slot have none."""
    more = [F.size(F.collect_set("l_suppkey")).alias("replies")] if replies else []
    per = slots(spark, d).groupBy("id").agg(F.collect_list("rating").alias("ratings"), *more)
    subs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("area"), "o_custkey")
    if track:
        subs = subs.join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("track")), F.col("o_custkey") == F.col("c_custkey"), "left")
    ratings = F.coalesce(F.col("ratings"), F.array().cast("array<double>")).alias("ratings")
    return subs.join(per, "id", "left").select("id", "status", "area", *(["track"] if track else []), *(["replies"] if replies else []), ratings)


def summaries(spark: SparkSession, d: str, track: bool = False) -> DataFrame:
    """Submissions with counts and mean of their ratings."""
    subs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("area"), "o_custkey")
    if track:
        subs = subs.join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("track")), F.col("o_custkey") == F.col("c_custkey"), "left")
    return C.scored_slots(subs, slots(spark, d).select("id", "rating"))


def each_slot(spark: SparkSession, d: str) -> DataFrame:
    """Every slot as a record of its own, for what does not look at submissions."""
    return slots(spark, d).select(F.array("rating").alias("ratings"), F.array("confidence").alias("confidences"), F.array("words").alias("words"))


_S = "s as (select l_orderkey id, (l_quantity::bigint % 6)::double rating, l_linenumber conf, l_extendedprice words, l_discount, l_tax, l_suppkey from lineitem)"
_P = f"{_S}, p as (select o_orderkey id, o_orderstatus status, o_orderpriority area, c_mktsegment track, count(rating) filter (rating > 0) n, count(rating) filter (rating <= 0) bad, count(rating) m, avg(rating) filter (rating > 0) mean, count(distinct rating) filter (rating > 0) kinds, count(distinct l_suppkey) replies from orders left join s on id = o_orderkey left join customer on c_custkey = o_custkey group by all)"


@query("venue_summary", f"with {_P} select status, count(*) submissions, count(mean) scored, sum(n)::bigint reviews, sum(bad)::bigint anomalies, round(avg(mean), 6) mean_of_means, round(median(mean), 6) median_of_means, round(min(mean), 6) lowest, round(max(mean), 6) highest, count(*) filter (n >= 2 and kinds = 1) unanimous, round(count(*) filter (n >= 2 and kinds = 1) / nullif(count(*) filter (n >= 2), 0)::double, 6) unanimous_share from p group by status")
def venue_summary(spark, d):
    return C.venue_summary(summaries(spark, d))


@query("status_counts", "select coalesce(o_orderstatus, 'Unknown') status, count(*) n from orders group by 1")
def status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.coalesce("o_orderstatus", F.lit("Unknown")).alias("status")).agg(F.count("*").alias("n"))


@query("submission_counters", "with r as (select o_orderkey k, o_totalprice > 1000 ok from orders union all select o_orderkey, o_totalprice > 1000 from orders where o_orderkey % 10 = 0) select count(*) raw, count(*) filter (not ok) invalid, count(*) filter (ok) - count(distinct case when ok then k end) duplicate, count(distinct case when ok then k end) \"valid\" from r")
def submission_counters(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return C.submission_counters(o.unionByName(o.where("o_orderkey % 10 = 0")), "o_orderkey", F.col("o_totalprice") > 1000)


@query("rating_histogram", f"with {_S} select rating, count(*) n from s where rating > 0 group by 1")
def rating_histogram(spark, d):
    return C.rating_histogram(each_slot(spark, d))


@query("rating_histogram_all", f"with {_S} select rating, count(*) n from s group by 1")
def rating_histogram_all(spark, d):
    return C.rating_histogram(each_slot(spark, d), anomalies=True)


@query("status_by_track", "select c_mktsegment track, o_orderstatus status, count(*) n from orders join customer on c_custkey = o_custkey group by 1, 2")
def status_by_track(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("track"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("unanimity_share", f"with {_P} select count(*) filter (n >= 2) records, count(*) filter (n >= 2 and kinds = 1) unanimous, round(count(*) filter (n >= 2 and kinds = 1) / nullif(count(*) filter (n >= 2), 0)::double, 6) \"share\" from p")
def unanimity_share(spark, d):
    s = summaries(spark, d).where("n_pos >= 2")
    return s.agg(F.count("*").alias("records"), F.count_if("one_mind").alias("unanimous"), F.round(F.avg(F.col("one_mind").cast("double")), 6).alias("share"))


@query("iid_unanimity_baseline", f"with {_P}, k as (select n m, count(*) n_m from p where n >= 2 group by 1), h as (select rating, count(*) c from s where rating > 0 and id in (select id from p where n >= 2) group by 1), q as (select c / (sum(c) over ())::double p from h) select round(sum(n_m * pow(p, m)) / sum(n_m * p), 6) iid_share from k, q")
def iid_unanimity_baseline(spark, d):
    return C.iid_baseline(records(spark, d))


@query("mean_quantiles_nearest_rank", f"with {_P}, v as (select status, list_sort(list(mean)) x from p where mean is not null group by status), q as (select unnest([0.25, 0.5, 0.75, 0.9]) p) select status, p::double p, round(x[round_even((len(x) - 1) * p::double, 0)::int + 1], 4) quantile from v, q")
def mean_quantiles(spark, d):
    return C.nearest_rank(summaries(spark, d), ["status"], "mean_rating", [0.25, 0.5, 0.75, 0.9])


@query("modal_slot_count", f"with {_P}, k as (select m::int slots, count(*) records from p group by 1) select slots, records from k order by records desc, slots limit 1")
def modal_slot_count(spark, d):
    return C.modal_slots(records(spark, d))


@query("words_median_by_confidence", f"with {_S} select conf::int confidence, count(*) n, round(median(words), 6) median_words, round(avg(words), 6) mean_words from s group by 1")
def words_median(spark, d):
    return C.median_words(each_slot(spark, d))


@query("word_count_slots", "with w as (select case when l_discount > 0.05 then l_extendedprice when l_tax > 0.02 then l_quantity + l_linenumber else l_quantity end words from lineitem) select count(words) n, round(avg(words), 6) mean_words, round(median(words), 6) median_words from w")
def word_count_slots(spark, d):
    li = table(spark, d, "lineitem")
    w = C.word_counts(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).otherwise(0.0), F.col("l_quantity"), F.when(F.col("l_tax") > 0.02, F.col("l_linenumber").cast("double")))
    words = li.select(w.alias("words"))
    middle = medians(words, [], "words").select(F.round("median", 6).alias("median_words"))
    return words.agg(F.count("words").alias("n"), F.round(F.avg("words"), 6).alias("mean_words")).crossJoin(F.broadcast(middle))  # one row each


@query("subscore_means", f"with {_S} select 'rating' dimension, count(rating) n, round(avg(rating), 5) mean from s union all select 'l_discount', count(l_discount), round(avg(l_discount), 5) from s union all select 'l_tax', count(l_tax), round(avg(l_tax), 5) from s")
def subscore_means(spark, d):
    return C.pooled_means(slots(spark, d), ["rating", "l_discount", "l_tax"])


@query("zero_discussion_share", f"with {_P} select count(*) records, count(*) filter (replies <= m) silent, round(avg((replies <= m)::int), 6) \"share\" from p where m > 0")
def zero_discussion_share(spark, d):
    return C.zero_discussion(records(spark, d, replies=True), "replies")


@query("out_of_scale_ratings", f"with {_P} select track, sum(bad)::bigint ratings, count(*) records from p where bad > 0 group by 1")
def out_of_scale(spark, d):
    return C.out_of_scale(records(spark, d, track=True))


@query("top_areas", "select o_orderpriority area, count(*) n from orders group by 1 order by n desc, area limit 10")
def top_areas(spark, d):
    return C.top_groups(table(spark, d, "orders").select(F.col("o_orderpriority").alias("area")), "area")


@query("topic_filter_samples", f"with {_P} select id, round(mean, 6) mean_rating from p where regexp_matches(concat_ws(' ', status, area), '(?i)urgent|high') and mean is not null order by mean desc, id limit 10")
def topic_samples(spark, d):
    s = summaries(spark, d).where(F.concat_ws(" ", "status", "area").rlike("(?i)urgent|high") & F.col("mean_rating").isNotNull())
    return s.orderBy(F.desc("mean_rating"), "id").limit(10).select("id", F.round("mean_rating", 6).alias("mean_rating"))


@query("cohort_filter", "select c_mktsegment track, o_orderstatus status, count(*) n from orders join customer on c_custkey = o_custkey where c_mktsegment in ('BUILDING', 'MACHINERY') and o_orderstatus in ('F', 'O') group by 1, 2")
def cohort_filter(spark, d):
    return C.cohort_filter(records(spark, d, track=True), {"BUILDING", "MACHINERY"}, {"F", "O"}).groupBy("track", "status").agg(F.count("*").alias("n"))


@query("fallback_rating", f"with {_P} select case when n > 0 then 'rating' else 'recommendation' end used, count(*) n from p group by 1")
def fallback_rating(spark, d):
    s = summaries(spark, d)
    return s.groupBy(F.when(F.col("n_pos") > 0, "rating").otherwise("recommendation").alias("used")).agg(F.count("*").alias("n"))


@query("slot_parse", f"with {_S} select id, list_sort(list(rating))::varchar ratings from s where rating is not null group by id")
def slot_parse(spark, d):
    packed = slots(spark, d).groupBy("id").agg(F.concat_ws(";", F.sort_array(F.collect_list(F.col("rating").cast("string"))), F.lit(""), F.lit("n/a")).alias("packed"))
    return packed.select("id", F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(C.parse_slots(F.col("packed"))), lambda x: x.cast("string")), ", "), F.lit("]")).alias("ratings"))


#: Wordings and the status each has.
_WORDINGS = {
    "Accepted as poster": "accepted", "Notable top 5%": "accepted", "ICLR 2026 Oral": "accepted", "Accept (spotlight)": "accepted", "never accepted": "unknown", "not accepted, under review": "unknown", "accept threshold not met": "unknown",
    "unaccepted": "unknown", "cannot accept": "unknown", "Withdrawn after reject": "withdrawn", "withdrawal": "withdrawn", "Desk rejected": "rejected_or_unaccepted", "Reject": "rejected_or_unaccepted", "desk_reject": "rejected_or_unaccepted",
    "Active": "under_review", "inactive": "unknown", "under review": "under_review", "submitted": "under_review", "submitted to X": "unknown", "postered": "unknown",
}
_WORDED = ", ".join(f"({i}, '{w}', '{s}')" for i, (w, s) in enumerate(_WORDINGS.items()))


@query("status_cascade", f"with w(i, raw, status) as (values {_WORDED}) select raw, status, count(*) n from orders join w on i = o_orderkey % {len(_WORDINGS)} group by 1, 2")
def status_cascade(spark, d):
    raw = F.element_at(F.array(*[F.lit(w) for w in _WORDINGS]), (F.col("o_orderkey") % len(_WORDINGS) + 1).cast("int"))
    return table(spark, d, "orders").select(raw.alias("raw")).withColumn("status", C.classify_status(F.col("raw"))).groupBy("raw", "status").agg(F.count("*").alias("n"))


_HIGH, _MID, _LOW = C.SOUNDNESS
_BIN = f"case when {{0}} >= 3.25 then '{_HIGH}' when {{0}} <= 2.0 then '{_LOW}' else '{_MID}' end"


@query("soundness_bins", f"select {_BIN.format('l_quantity / 12')} bin, count(*) n from lineitem group by 1")
def soundness_bins(spark, d):
    return table(spark, d, "lineitem").groupBy(C.soundness_bin(F.col("l_quantity") / 12).alias("bin")).agg(F.count("*").alias("n"))


#: What reviews may say, in the families' wording and beside it.
_REMARKS = (
    "there are no Error Bars at all", "it has typos and a missing reference", "table 2 and table  3 disagree", "recent baselines are absent", "no code was found", "the std of runs", "numbers in table 4 do not match", "reproducibility is doubtful",
    "confidence is high", "the intervals are wide", "a grammar book", "ablation studies abound", "baselines exist", "codes and coders", "over lengthy", "hyperparameters are not specified",
)
_STATUSES = ("ICLR 2026 Oral", "ICLR 2026 Poster", "Reject", "Withdraw", "Desk Reject")


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Orders as papers with a status, their line items as reviews whose remarks follow from part and supplier."""
    remark = F.element_at(F.array(*[F.lit(x) for x in _REMARKS]), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 40 + 1).cast("int"))
    remark = F.when((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 40 < len(_REMARKS), remark).otherwise("fine work")
    items = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") % 10 + 1).alias("rating"), (F.col("l_quantity") % 4 + 1).alias("soundness"), *C.incidence_flags(remark))
    papers = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("reviews"), F.avg("rating").alias("rating"), F.avg("soundness").alias("soundness"), *[F.bool_or(f).alias(f) for f in C.FAMILIES])
    status = F.element_at(F.array(*[F.lit(s) for s in _STATUSES]), (F.col("o_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", C.decision_tier(status).alias("tier")).join(papers, F.col("o_orderkey") == F.col("l_orderkey"))


_SAID = ", ".join(f"'{x}'" for x in _REMARKS)
_FLAGS = ", ".join(f"bool_or(regexp_matches(said, '(?i){p}')) {n}" for n, p in C.FAMILIES.items())
_R = (
    f"s as (select l_orderkey k, l_quantity % 10 + 1 rating, l_quantity % 4 + 1 soundness, case when (l_partkey * 7 + l_suppkey) % 40 < {len(_REMARKS)} then [{_SAID}][((l_partkey * 7 + l_suppkey) % 40 + 1)::int] else 'fine work' end said from lineitem), "
    f"p as (select k, count(*) reviews, avg(rating) rating, avg(soundness) soundness, {_FLAGS} from s group by 1), r as (select p.*, ['Oral', 'Poster', 'Rejected', 'Withdrawn', 'Desk Reject'][(o_custkey % 5 + 1)::int] tier from p join orders on o_orderkey = k)"
)
_ANY = " or ".join(C.FAMILIES)
_RSUM = f"count(*) papers_n, sum(reviews)::bigint reviews_n, round(avg(rating), 3) mean_rating, round(avg(soundness), 3) mean_soundness, count(*) filter ({_ANY}) hit_any, round(100.0 * count(*) filter ({_ANY}) / count(*), 1) hit_any_pct, " + ", ".join(f"count(*) filter ({n}) {n}, round(100.0 * count(*) filter ({n}) / count(*), 1) {n}_pct" for n in C.FAMILIES)
_GROUPED = f"(select *, tier tier_group from r union all select *, 'ALL_SCORED' from r union all select *, 'STANDARD_DECISION_TIERS' from r where tier <> 'Desk Reject' union all select *, {_BIN.format('soundness')} from r)"


def tiered(spark: SparkSession, d: str) -> DataFrame:
    return C.with_labels(reviewed(spark, d), C.incidence_groups(F.col("tier"), F.col("soundness")))


@query("incidence_by_tier", f"with {_R} select tier_group, {_RSUM} from {_GROUPED} group by 1")
def incidence_by_tier(spark, d):
    return C.incidence(tiered(spark, d), ["tier_group"])


@query("incidence_split_half", f"with {_R} select tier_group, (instr('0123456789abcdef', right(sha256(k::varchar), 1)) - 1)::int % 2 half, {_RSUM} from {_GROUPED} group by 1, 2")
def incidence_split_half(spark, d):
    return C.incidence(tiered(spark, d).withColumn("half", C.split_half(F.col("o_orderkey"))), ["tier_group", "half"])


@query("partition_conservation", f"with {_R}, g as (select tier, count(*) papers_n, sum(reviews)::bigint reviews_n, count(*) filter ({_ANY}) hit_any from r group by 1), w as (select count(*) papers_n, sum(reviews)::bigint reviews_n, count(*) filter ({_ANY}) hit_any from r) " + " union all ".join(f"select '{c}' what, any_value(w.{c}) whole, sum(g.{c})::bigint parts, any_value(w.{c}) = sum(g.{c}) consistent from g, w" for c in ("papers_n", "reviews_n", "hit_any")))
def partition_conservation(spark, d):
    tiers = (*C.DECISION_TIERS, "Desk Reject")
    by = C.incidence(tiered(spark, d), ["tier_group"]).where(F.col("tier_group").isin(*tiers, "ALL_SCORED"))
    return C.conservation(by, F.col("tier_group") == "ALL_SCORED", ["papers_n", "reviews_n", "hit_any"])


@query("hit_bounds", f"with {_R} select tier tier_group, greatest(" + ", ".join(f"count(*) filter ({n})" for n in C.FAMILIES) + f") least, count(*) filter ({_ANY}) hit_any, " + " + ".join(f"count(*) filter ({n})" for n in C.FAMILIES) + " most, true ok from r group by 1")
def hit_bounds(spark, d):
    """Any hit lies between the largest family and all families together."""
    by = C.incidence(tiered(spark, d), ["tier_group"]).where(F.col("tier_group").isin(*C.DECISION_TIERS, "Desk Reject"))
    most = sum((F.col(n) for n in C.FAMILIES), F.lit(0))
    least = F.greatest(*C.FAMILIES)
    return by.select("tier_group", least.alias("least"), "hit_any", most.cast("long").alias("most"), F.col("hit_any").between(least, most).alias("ok"))


@query("confusion_matrix", "with v as (select quality = 0 e, text ~ '.*(!!|%%%|###).*' or regexp_matches(text, '!!|%%%|###') p from documents d join labels l using (doc_id)), c as (select count(*) filter (e and p) tp, count(*) filter (not e and not p) tn, count(*) filter (not e and p) fp, count(*) filter (e and not p) fn from v) select *, round(tp / nullif(tp + fn, 0)::double, 6) recall, round(tp / nullif(tp + fp, 0)::double, 6) \"precision\", round(tn / nullif(tn + fp, 0)::double, 6) specificity, round((tp + tn) / nullif(tp + tn + fp + fn, 0)::double, 6) accuracy from c")
def confusion_matrix(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").rlike("!!|%%%|###").alias("p"))
    return C.confusion(docs.join(table(spark, d, "labels"), "doc_id").withColumn("e", F.col("quality") == 0), "e", "p")
