"""Review cohorts: records with reviewer slots, their filters, histograms, quantiles and incidence.

A cohort is a DataFrame of records (id, status, area, track, ratings, confidences, words), one row a submission,
the three arrays aligned by reviewer. Ratings at or below zero are anomalies: counted, never scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.selection import medians, nearest_ranks
from attesta.store import written

UNSPECIFIED = "<unspecified>"


def parse_slots(slots: Column, keep_positions: bool = False) -> Column:
    """Numbers of a packed field `4;6;;8`; what is no finite number is dropped, or null at its place."""
    number = F.transform(F.split(slots, ";"), lambda x: F.when(F.trim(x).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.expr("try_cast(0 as double)") + F.trim(x).try_cast("double")))
    number = F.transform(number, lambda x: F.when(F.abs(x) < float("inf"), x))
    return number if keep_positions else F.filter(number, lambda x: x.isNotNull())


def positive(ratings: Column) -> Column:
    return F.filter(ratings, lambda x: x > 0)


def cohort_filter(records: DataFrame, tracks: set[str] | None = None, statuses: set[str] | None = None) -> DataFrame:
    """Rows of these tracks and statuses (None: all); missing values count as <unspecified>."""
    for name, chosen in (("track", tracks), ("status", statuses)):
        records = records.withColumn(name, F.coalesce(name, F.lit(UNSPECIFIED)))
        if chosen is not None:
            records = records.where(F.col(name).isin(sorted(chosen)))
    return records


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order (of equal ones any); rows without a key are all kept.

    An aggregate: each task keeps one row a key before the exchange, so a key of any number of rows is no more than another.
    """
    least = F.min_by(F.struct(*rows.columns), F.struct(*order))
    with_key = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(least.alias("_first")).select("_first.*")
    return with_key.unionByName(rows.where(F.col(key).isNull()))


def submission_counters(rows: DataFrame, key: str, valid: Column) -> DataFrame:
    """raw, invalid, duplicate and valid counts; a key counts once, rows without one always."""
    keyed = rows.select(F.col(key).alias("k"), valid.alias("ok"))
    totals = keyed.agg(F.count("*").alias("raw"), F.count_if(~F.col("ok")).alias("invalid"), F.count_if(F.expr("ok and k is null")).alias("anonymous"), F.count_if(F.expr("ok and k is not null")).alias("named"))
    kinds = keyed.where("ok and k is not null").groupBy("k").agg(F.lit(1).alias("one")).agg(F.count("*").alias("distinct"))
    return totals.crossJoin(F.broadcast(kinds)).select("raw", "invalid", (F.col("named") - F.col("distinct")).alias("duplicate"), (F.col("anonymous") + F.col("distinct")).alias("valid"))


def scored(records: DataFrame) -> DataFrame:
    """records and positive ratings, their number and mean (null without one), and the number of anomalies."""
    p = records.withColumn("pos", positive(F.col("ratings"))).withColumn("n_pos", F.size("pos")).withColumn("n_anomalies", F.size("ratings") - F.size("pos"))
    p = p.withColumn("mean_rating", F.when(F.col("n_pos") > 0, F.aggregate("pos", F.lit(0.0), lambda a, x: a + x) / F.col("n_pos")))
    return p.withColumn("one_mind", F.size(F.array_distinct("pos")) == 1)


def scored_slots(submissions: DataFrame, slots: DataFrame) -> DataFrame:
    """The same from submissions (id, ...) and slots (id, rating), by sums alone: no record's slots are gathered."""
    up = F.when(F.col("rating") > 0, F.col("rating"))
    per = slots.groupBy("id").agg(F.count(up).alias("n_pos"), F.count(F.when(F.col("rating") <= 0, 1)).alias("n_anomalies"), F.sum(up).alias("s"), (F.min(up) == F.max(up)).alias("one_mind"))
    rows = submissions.join(per, "id", "left").withColumn("mean_rating", F.when(F.col("n_pos") > 0, F.col("s") / F.col("n_pos")))
    return rows.drop("s").fillna(0, ["n_pos", "n_anomalies"]).fillna(False, ["one_mind"])


def venue_summary(s: DataFrame) -> DataFrame:
    """One row a status of scored records: submissions, scored, reviews, anomalies, statistics of the records' mean ratings, unanimity."""
    s = written(s.select("status", "mean_rating", "n_pos", "n_anomalies", "one_mind").withColumn("many", F.col("n_pos") >= 2), "summary")
    middle = medians(s, ["status"], "mean_rating").select(F.col("status").alias("_s"), F.round("median", 6).alias("median_of_means"))
    told = s.groupBy("status").agg(
        F.count("*").alias("submissions"), F.count("mean_rating").alias("scored"), F.sum("n_pos").cast("long").alias("reviews"), F.sum("n_anomalies").cast("long").alias("anomalies"),
        F.round(F.avg("mean_rating"), 6).alias("mean_of_means"), F.round(F.min("mean_rating"), 6).alias("lowest"), F.round(F.max("mean_rating"), 6).alias("highest"),
        F.count_if(F.expr("many and one_mind")).alias("unanimous"), F.round(F.count_if(F.expr("many and one_mind")) / F.nullif(F.count_if("many"), F.lit(0)), 6).alias("unanimous_share"),
    )
    return told.join(middle, F.col("status").eqNullSafe(F.col("_s")), "left").drop("_s")


def rating_histogram(records: DataFrame, anomalies: bool = False) -> DataFrame:
    ratings = F.col("ratings") if anomalies else positive(F.col("ratings"))
    return records.select(F.explode(ratings).alias("rating")).groupBy("rating").agg(F.count("*").alias("n"))


def nearest_rank(values: DataFrame, by: list[str], value: str, probs: list[float], digits: int = 4) -> DataFrame:
    """Value at index round-half-even((n - 1) p) of the sorted values, a row for each group and p."""
    return nearest_ranks(values, by, value, probs).select(*by, "p", F.round("value", digits).alias("quantile"))


def iid_baseline(records: DataFrame) -> DataFrame:
    """Share of unanimous records if ratings were drawn independently from the pooled histogram."""
    s = scored(records)
    sizes = s.where("n_pos >= 2").groupBy(F.col("n_pos").alias("m")).agg(F.count("*").alias("n_m"))
    pooled = s.where("n_pos >= 2").select(F.explode("pos").alias("rating")).groupBy("rating").agg(F.count("*").alias("c"))
    shares = pooled.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy()))
    # a row for each number of reviews and rating value
    return sizes.crossJoin(F.broadcast(shares)).agg(F.round(F.sum(F.col("n_m") * F.pow("p", "m")) / F.sum(F.col("n_m") * F.col("p")), 6).alias("iid_share"))


def modal_slots(records: DataFrame) -> DataFrame:
    """The commonest number of ratings, ties to the smaller."""
    n = records.groupBy(F.size("ratings").alias("m")).agg(F.count("*").alias("n"))
    return n.agg(F.max_by("m", F.struct("n", -F.col("m"))).alias("slots"), F.max("n").alias("records"))


def median_words(records: DataFrame) -> DataFrame:
    """Median and count of words by rounded confidence, slots aligned by position."""
    zipped = records.select(F.explode(F.arrays_zip("confidences", "words")).alias("z")).select(F.round("z.confidences").cast("int").alias("confidence"), F.col("z.words").alias("words"))
    slots = written(zipped.where("confidence is not null and words is not null"), "words")
    told = slots.groupBy("confidence").agg(F.count("*").alias("n"), F.round(F.avg("words"), 6).alias("mean_words"))
    return told.join(medians(slots, ["confidence"], "words"), "confidence").select("confidence", "n", F.round("median", 6).alias("median_words"), "mean_words")


def word_counts(review: Column, both: Column, limits: Column) -> Column:
    """Words of a review: its own count if positive, else the sum of the two parts, else whichever there is."""
    return F.when(review > 0, review).when(both.isNotNull() & limits.isNotNull(), both + limits).otherwise(F.coalesce(both, limits))


def pooled_means(slots: DataFrame, dimensions: list[str]) -> DataFrame:
    """Mean and count of each dimension over all reviewers (not a mean of means)."""
    long = slots.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("v")) for d in dimensions])).alias("x")).select("x.*").where("v is not null")
    return long.groupBy("dimension").agg(F.count("*").alias("n"), F.round(F.avg("v"), 5).alias("mean"))


def zero_discussion(records: DataFrame, replies: str) -> DataFrame:
    """Share of records with no more replies than ratings."""
    known = records.where(F.col(replies).isNotNull())
    return known.agg(F.count("*").alias("records"), F.count_if(F.col(replies) <= F.size("ratings")).alias("silent"), F.round(F.avg((F.col(replies) <= F.size("ratings")).cast("double")), 6).alias("share"))


def out_of_scale(records: DataFrame) -> DataFrame:
    """Ratings at or below zero by track: how many, and in how many records."""
    s = scored(records).where("n_anomalies > 0")
    return s.groupBy("track").agg(F.sum("n_anomalies").cast("long").alias("ratings"), F.count("*").alias("records"))


def top_groups(records: DataFrame, by: str, k: int = 10) -> DataFrame:
    return records.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


#: Wordings of a status, in the order in which they decide (fixed values).
STATUS_WORDS = {
    "withdrawn": r"\bwithdraw(?:n|al)?\b",
    "rejected_or_unaccepted": r"\breject(?:ed)?\b|\bdesk[\s_-]*reject",
    "accepted": r"\b(?:poster|spotlight|oral|notable)\b|(?<!not\s)(?<!un)(?<!cannot\s)(?<!never\s)\baccept(?:ed)?\b(?!\s+threshold)",
    "under_review": r"^(?:active|under review|submitted)$",
}


def classify_status(status: Column) -> Column:
    """withdrawn before rejected_or_unaccepted before accepted before under_review; anything else is unknown."""
    s = F.lower(F.trim(status))
    return F.coalesce(*[F.when(s.rlike(words), name) for name, words in STATUS_WORDS.items()], F.lit("unknown"))


#: Tiers of a decision, bins of soundness and groups over them (fixed values).
DECISION_TIERS = ("Oral", "Poster", "Rejected", "Withdrawn")
SOUNDNESS = ("SOUND_HIGH(>=3.25)", "SOUND_MID(2.0_to_3.25)", "SOUND_LOW(<=2.0)")


def decision_tier(status: Column) -> Column:
    """The tier of a status; one that has none is an error."""
    exact = {"Reject": "Rejected", "Withdraw": "Withdrawn", "Desk Reject": "Desk Reject"}
    out = F.when(F.contains(status, F.lit("Oral")), "Oral").when(F.contains(status, F.lit("Poster")), "Poster")
    for raw, tier in exact.items():
        out = out.when(status == raw, tier)
    return out.otherwise(F.raise_error(F.concat(F.lit("unexpected status: "), F.coalesce(status, F.lit("null")))))


def soundness_bin(x: Column) -> Column:
    high, middle, low = SOUNDNESS
    return F.when(x >= 3.25, high).when(x <= 2.0, low).when(x.isNotNull(), middle)


#: Families of wording looked for in review text, in any case (fixed values).
FAMILIES = {
    "dispersion_error_bars": r"\b(?:error\s+bars?|standard\s+deviations?|std\b|stdev\b|confidence\s+intervals?|statistical\s+significance|multiple\s+(?:runs|seeds)|random\s+seeds?|variance\s+across)\b",
    "format_section_page": r"\b(?:typos?|grammatical|grammar\s+errors?|broken\s+references?|missing\s+references?|citation\s+format|template|page\s+limit|over\s+length|limitations?\s+section|no\s+limitations?|lack\s+of\s+limitations?|unresolved\s+reference)\b",
    "table_quant_ablation": r"\b(?:inconsistent\s+numbers?|mismatch\s+between\s+table|table\s+\d+\s+and\s+table\s+\d+|ablation\s+study\s+is\s+missing|no\s+ablation|marginal\s+improvement|overclaimed|over-claimed|hyperbole|exaggerated|numbers?\s+in\s+table\s+\d+\s+do\s+not\s+match|sum\s+to\s+100)\b",
    "citation_baseline": r"\b(?:missing\s+citations?|missing\s+references?|outdated\s+baselines?|recent\s+baselines?|duplicate\s+citations?|duplicate\s+references?|wrong\s+citation|incorrect\s+citation|hallucinated\s+reference|non-existent\s+reference)\b",
    "reproducibility_code": r"\b(?:no\s+code|code\s+is\s+not\s+provided|code\s+is\s+not\s+available|missing\s+code|anonymous\s+(?:code|repo|repository|link)|reproducib(?:le|ility)|hyperparameters?\s+are\s+not\s+specified|implementation\s+details?\s+are\s+missing)\b",
}


def incidence_flags(text: Column) -> list[Column]:
    return [F.coalesce(text.rlike("(?i)" + p), F.lit(False)).alias(name) for name, p in FAMILIES.items()]


def incidence_groups(tier: Column, soundness: Column) -> dict[str, Column]:
    """The groups a paper counts in: its tier, the four decision tiers together, all, and its bin of soundness."""
    groups = {t: tier == t for t in (*DECISION_TIERS, "Desk Reject")}
    groups |= {"STANDARD_DECISION_TIERS": tier.isin(*DECISION_TIERS), "ALL_SCORED": F.lit(True)}
    return groups | {b: soundness_bin(soundness) == b for b in SOUNDNESS}


def incidence(papers: DataFrame, by: list[str]) -> DataFrame:
    """papers (reviews, rating, soundness, a flag for each family) -> by group: papers and reviews, mean rating and
    soundness, papers with any hit, and hits and percentage of each family."""
    hit = F.lit(False)
    for name in FAMILIES:
        hit = hit | F.col(name)
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), 1)
    out = [F.count(F.lit(1)).alias("papers_n"), F.sum("reviews").cast("long").alias("reviews_n"), F.round(F.avg("rating"), 3).alias("mean_rating"), F.round(F.avg("soundness"), 3).alias("mean_soundness"), F.count_if(hit).alias("hit_any"), share(hit).alias("hit_any_pct")]
    for name in FAMILIES:
        out += [F.count_if(name).alias(name), share(F.col(name)).alias(f"{name}_pct")]
    return papers.groupBy(*by).agg(*out)


def split_half(key: Column) -> Column:
    """0 or 1 from the last hex digit of the key's SHA-256."""
    return (F.conv(F.right(F.sha2(key.cast("string"), 256), F.lit(1)), 16, 10).cast("int") % 2).alias("half")


def with_labels(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Each row once for every named group it is in (overlapping totals and subtotals in one pass)."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]), lambda x: x.isNotNull())
    return rows.withColumn("tier_group", F.explode(names))


def conservation(parts: DataFrame, total_row: Column, columns: list[str]) -> DataFrame:
    """One row a column: the whole, the sum of the parts and whether they agree."""
    sums = [F.struct(F.lit(c).alias("what"), F.sum(F.when(total_row, F.col(c))).cast("long").alias("whole"), F.sum(F.when(~total_row, F.col(c))).cast("long").alias("parts")) for c in columns]
    return parts.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("x")).select("x.*").withColumn("consistent", F.col("whole") == F.col("parts"))


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """True and false positives and negatives with recall, precision, specificity and accuracy."""
    e, p = F.col(expected), F.col(predicted)
    c = rows.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & ~p).alias("tn"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return c.select("tp", "tn", "fp", "fn", ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"), ratio(tn, tn + fp).alias("specificity"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))
