"""Forum notes and provider records: classes of notes, statuses, scores, open-access locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import bare_doi
from attesta.operators.cohort import classify_status
from attesta.store import dealt


def value_of(content: Column, field: str) -> Column:
    """A field of a note's JSON content, bare or wrapped as {"value": ...}."""
    return F.coalesce(F.get_json_object(content, f"$.{field}.value"), F.get_json_object(content, f"$.{field}"))


def leading_number(s: Column) -> Column:
    """The number that a score text begins with (`4: weak accept`)."""
    return F.nullif(F.regexp_extract(s, r"^\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def note_class(invitation: Column, content: Column) -> Column:
    """meta_review, decision, review or other; comments that carry a rating are no reviews."""
    i = F.lower(invitation)
    denied = i.rlike("comment|rebuttal|withdraw|desk|revision|ethics|meta|decision|acknowledg|response")
    return F.when(i.rlike("meta_?review"), "meta_review").when(i.rlike("decision"), "decision").when(i.rlike("official_?review|/review$") & ~denied, "review").when(~denied & value_of(content, "rating").isNotNull() & i.rlike("review"), "review").otherwise("other")


def forum_summary(notes: DataFrame, declared: DataFrame) -> DataFrame:
    """notes (forum, invitation, content), declared (forum, count) -> reviews, mean rating, decision status, completeness."""
    n = notes.withColumn("class", note_class(F.col("invitation"), F.col("content"))).withColumn("rating", leading_number(value_of(F.col("content"), "rating")))
    decision = F.max(F.when(F.col("class") == "decision", value_of(F.col("content"), "decision")))
    venue = F.max(value_of(F.col("content"), "venue"))
    s = n.groupBy("forum").agg(F.count("*").alias("notes"), F.count_if((F.col("class") == "review") & F.col("rating").isNotNull()).alias("reviews"), F.round(F.avg(F.when(F.col("class") == "review", F.col("rating"))), 6).alias("mean_rating"), decision.alias("decision"), venue.alias("venue"))
    status = F.when(F.col("decision").isNotNull(), classify_status(F.col("decision"))).when(F.lower("venue").startswith("submitted to"), "under_review").otherwise(classify_status(F.col("venue")))
    return s.join(declared, "forum", "left").select("forum", "reviews", "mean_rating", status.alias("status"), (F.col("notes") < F.coalesce("count", F.lit(0))).alias("incomplete"))


def _http(url: Column) -> Column:
    u = F.trim(url)
    return F.when(u.rlike("^https?://"), u)


def openalex_locations(works: DataFrame) -> DataFrame:
    """works (key, work: JSON of an OpenAlex record) -> key, kind, url, pdf for every open location, as best_location takes them."""
    place = "struct<is_oa: boolean, pdf_url: string, landing_page_url: string, version: string, license: string, source: struct<type: string, display_name: string>>"
    w = works.select("key", F.from_json("work", f"locations array<{place}>, best_oa_location {place}, open_access struct<is_oa: boolean, oa_url: string, oa_status: string>").alias("w"))
    pdf = lambda x: F.coalesce(_http(x["pdf_url"]), _http(x["landing_page_url"]))
    row = lambda kind, url, is_pdf: F.struct(F.lit(kind).alias("kind"), url.alias("url"), is_pdf.alias("pdf"))
    open_ = F.coalesce(F.col("w.open_access.is_oa"), F.lit(False))
    listed = F.transform(F.filter(F.coalesce("w.locations", F.array().cast(f"array<{place}>")), lambda x: F.coalesce(x["is_oa"], F.lit(False))), lambda x: F.when(x["source"]["type"].eqNullSafe(F.lit("repository")) & _http(x["pdf_url"]).isNotNull(), row("repository", pdf(x), F.lit(True))).otherwise(row("other", pdf(x), _http(x["pdf_url"]).isNotNull())))
    best = F.col("w.best_oa_location")
    best = F.when(best.isNotNull() & F.coalesce(best["is_oa"], open_), row("best", pdf(best), _http(best["pdf_url"]).isNotNull()))
    link = F.col("w.open_access.oa_url")
    link = F.when(open_ & _http(link).isNotNull(), row("link", _http(link), F.lower(F.trim(link)).endswith(".pdf")))
    return w.select("key", F.explode(F.concat(listed, F.array_compact(F.array(best, link)))).alias("x")).select("key", "x.*").where("url is not null")


def semantic_scholar_locations(papers: DataFrame) -> DataFrame:
    """papers (key, paper: JSON of a Semantic Scholar record) -> key, doi, url of its open PDF, landing."""
    p = papers.select("key", F.from_json("paper", "externalIds struct<DOI: string>, doi string, openAccessPdf struct<url: string, status: string, license: string>, url string").alias("p"))
    url = _http(F.col("p.openAccessPdf.url"))
    return p.select("key", F.coalesce("p.externalIds.DOI", "p.doi").alias("doi"), url.alias("url"), F.coalesce(_http(F.col("p.url")), url).alias("landing")).where("url is not null")


def europe_pmc_locations(answers: DataFrame) -> DataFrame:
    """answers (key, answer: JSON of a Europe PMC search) -> key, doi, url, landing of every open result: its first PDF, else
    its first other address."""
    a = answers.select("key", F.explode(F.from_json("answer", "resultList struct<result: array<struct<doi: string, isOpenAccess: string, license: string, fullTextUrlList: struct<fullTextUrl: array<struct<availabilityCode: string, documentStyle: string, url: string>>>>>>")["resultList"]["result"]).alias("r"))
    urls = F.filter(F.coalesce("r.fullTextUrlList.fullTextUrl", F.array()), lambda u: F.upper(F.coalesce(u["availabilityCode"], F.lit(""))).isin("OA", "F", "") & _http(u["url"]).isNotNull())
    first = lambda keep: F.try_element_at(F.filter(urls, keep), F.lit(1))["url"]
    pdf, other = first(lambda u: F.lower(u["documentStyle"]) == "pdf"), first(lambda u: F.coalesce(F.lower(u["documentStyle"]) != "pdf", F.lit(True)))
    return a.where("upper(r.isOpenAccess) = 'Y'").select("key", F.col("r.doi").alias("doi"), F.coalesce(_http(pdf), _http(other)).alias("url"), F.coalesce(_http(other), _http(pdf)).alias("landing")).where("url is not null")


#: Providers of open-access locations in the order they are asked, and the mode a hit is reported with (fixed values).
OA_SOURCES = {"unpaywall": "unpaywall-live", "openalex": "openalex-fallback", "semantic_scholar": "semantic-scholar-fallback", "europe_pmc": "europe-pmc-fallback"}


def resolve_open_access(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """wanted (key, type doi or arxiv, value), answers (key, source, doi, url) -> a row for each wanted: status, mode, is_oa, url.

    Answers count only where their own DOI is the wanted one. The first provider with an address wins; an arXiv id is its
    own address; a DOI that only answers of other DOIs came for has failed; one without any address is not open.
    """
    doi = bare_doi(F.col("value"), "locator")
    rank = F.array_position(F.array(*[F.lit(s) for s in OA_SOURCES]), F.col("source"))
    asked = wanted.select("key", "type", "value", doi.alias("_doi"))
    met = answers.withColumnRenamed("doi", "_own").join(asked.select("key", "_doi"), "key").withColumn("same", bare_doi(F.col("_own"), "locator").eqNullSafe(F.col("_doi")))
    best = met.groupBy("key").agg(F.min(F.when(F.col("same") & F.col("url").isNotNull(), F.struct(rank.alias("r"), "url", "source"))).alias("hit"), F.bool_or("same").alias("same"))
    out = asked.join(best, "key", "left")
    modes = F.create_map(*[F.lit(x) for pair in OA_SOURCES.items() for x in pair])
    arxiv, is_doi = F.col("type") == "arxiv", F.col("type") == "doi"
    status = F.when(arxiv, "ok").when(~is_doi, "unsupported").when(F.col("same") | F.col("same").isNull(), "ok").otherwise("failed")
    url = F.when(arxiv, F.concat(F.lit("https://arxiv.org/pdf/"), "value", F.lit(".pdf"))).when(is_doi, F.col("hit.url"))
    mode = F.when(arxiv, "arxiv-direct").when(is_doi & F.col("hit").isNotNull(), modes[F.col("hit.source")]).otherwise("none")
    return out.select("key", status.alias("status"), mode.alias("mode"), url.isNotNull().alias("is_oa"), url.alias("url"))


def best_location(locations: DataFrame, key: str) -> DataFrame:
    """locations (key, kind, url, pdf): repository PDFs, then the best one, then the plain link, then others; URLs once."""
    rank = F.when((F.col("kind") == "repository") & F.col("pdf"), 0).when(F.col("kind") == "best", 1).when(F.col("kind") == "link", 2).otherwise(3)
    once = locations.where("url is not null").withColumn("rank", rank).groupBy(key, "url").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy(key).orderBy("rank", "url")
    return once.withColumn("n", F.row_number().over(w)).withColumn("locations", F.count("*").over(Window.partitionBy(key))).where("n = 1").select(key, "url", "rank", "locations")


def average_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Ranks of |value| with ties averaged."""
    w = Window.partitionBy(*by)
    size = F.abs(F.col(value))
    return rows.withColumn("_a", size).withColumn("avg_rank", F.rank().over(w.orderBy("_a")) + (F.count("*").over(Window.partitionBy(*by, "_a")) - 1) / 2.0).drop("_a")


def first_k(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def seeded_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A permutation that depends on seed and key alone."""
    return rows.withColumn("place", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))


def set_sizes(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Sizes of union, intersection and both differences of two array columns, and whether they are disjoint."""
    x, y = F.col(a), F.col(b)
    return rows.select("*", F.size(F.array_union(x, y)).alias("n_union"), F.size(F.array_intersect(x, y)).alias("n_both"), F.size(F.array_except(x, y)).alias("only_a"), F.size(F.array_except(y, x)).alias("only_b"), (~F.arrays_overlap(x, y)).alias("disjoint"))


def same_condition_conflicts(fields: DataFrame) -> DataFrame:
    """fields (paper, name, context, unit, value): conditions under which one name has several values."""
    # values of a condition hardly repeat, so rows are dealt before they are grouped: a task holds a bounded number of them
    by = ["paper", "name", "context", "unit"]
    return dealt(fields.select(*by, "value"), *by).groupBy(*by).agg(F.count_distinct("value").alias("values")).where("values > 1")


def comparable(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Fields of either document without a partner of the same name, unit and context in the other."""
    left = a.join(b.select(*on).distinct(), on, "left_anti").select(*on, F.lit("first").alias("missing_from_other"))
    return left.unionByName(b.join(a.select(*on).distinct(), on, "left_anti").select(*on, F.lit("second").alias("missing_from_other")))


def extraction_errors(fields: DataFrame) -> DataFrame:
    """fields (field_id, status, literal, quote, unit): literal not in its quote, unit not in it, inequality lost."""
    got = fields.where("status = 'extracted'")
    bad = F.filter(F.array(F.when(~F.contains("quote", "literal"), F.lit("LITERAL_NOT_IN_QUOTE")), F.when(F.col("unit").isNotNull() & ~F.contains(F.lower("quote"), F.lower("unit")), F.lit("UNIT_NOT_IN_QUOTE")), F.when(F.col("quote").rlike(r"[<>≤≥]\s*\d") & ~F.col("literal").rlike("[<>≤≥]"), F.lit("INEQUALITY_LOST"))), lambda x: x.isNotNull())
    return got.select("field_id", F.explode(bad).alias("error"))


#: Parts of a field's context (fixed values), and what stands for none.
AXES = ("dataset", "group", "timepoint", "analysis_set", "condition")
UNKNOWN = ("", "unknown", "none", "null", "n/a")


def directly_comparable(unit: Column, context: Column) -> Column:
    """Whether a field says enough to be compared as it is: its unit and every part of its context are known."""
    known = lambda x: ~F.coalesce(F.lower(F.trim(x)), F.lit("")).isin(*UNKNOWN)
    out = known(unit)
    for axis in AXES:
        out = out & known(context[axis])
    return out


#: Checks between groups, whose inputs may differ in group; and of each kind the inputs that must share a unit, and those
#: that must share a group (fixed values).
BETWEEN_GROUPS = ("effect_size", "hedges_g", "or_rr_2x2", "power_ttest")
SAME_UNIT = {"effect_size": ("mean1", "sd1", "mean2", "sd2"), "hedges_g": ("mean1", "sd1", "mean2", "sd2"), "ci_consistency": ("estimate", "lower", "upper"), "sd_possible": ("sd", "minimum", "maximum"), "z_beta_se": ("beta", "se")}
SAME_GROUP = {"effect_size": (("mean1", "sd1", "n1"), ("mean2", "sd2", "n2")), "hedges_g": (("mean1", "sd1", "n1"), ("mean2", "sd2", "n2")), "or_rr_2x2": (("a", "b"), ("c", "d"))}


def context_errors(inputs: DataFrame) -> DataFrame:
    """inputs (check_id, kind, argument, status, type, name, unit, context; argument `reported` for the reported value) ->
    check_id, error: why the inputs of a check do not go together."""
    usable = (F.col("status") == "extracted") & F.col("type").isin("number", "integer", "p_value")
    # a check's inputs are few, so they are gathered once, in place of a copy of each for every count of distinct values. A null
    # is a value of its own here
    own = lambda c: F.coalesce(c, F.lit("\0"))
    mislabelled = F.concat_ws(" ", "name", "unit").rlike(r"(?i)\bSE\b|standard error|标准误")
    one = F.struct("kind", "argument", own(F.col("unit")).alias("unit"), *[own(F.col("context")[axis]).alias(axis) for axis in AXES], F.coalesce(usable, F.lit(False)).alias("usable"), mislabelled.alias("mislabelled"))
    held = inputs.select("check_id", one.alias("x")).groupBy("check_id").agg(F.collect_list("x").alias("rows"))
    rows = F.col("rows")
    is_input = lambda x: x["argument"] != "reported"
    values = lambda of, c: F.array_distinct(F.transform(F.filter(rows, of), lambda x: x[c]))
    among = lambda args: lambda x: x["argument"].isin(*args)
    kinds = lambda hit: F.forall(rows, lambda x: F.coalesce(hit(x["kind"]), F.lit(True))) & F.exists(rows, lambda x: x["kind"].isNotNull())
    found = []
    for axis in AXES:
        counts = kinds(lambda k: ~k.isin(*BETWEEN_GROUPS)) if axis == "group" else F.lit(True)
        n = F.size(values(is_input, axis))
        found.append((f"inputs_differ_in_{axis}", counts & (n > 1)))
        found.append((f"reported_differs_in_{axis}", counts & F.exists(rows, lambda x: ~is_input(x)) & (F.size(values(lambda x: F.lit(True), axis)) > F.greatest(n, F.lit(1)))))
    for kind, args in SAME_UNIT.items():
        found.append(("units_differ", kinds(lambda k, name=kind: k == name) & (F.size(values(among(args), "unit")) > 1)))
    for kind, sets in SAME_GROUP.items():
        for args in sets:
            found.append(("groups_differ_within_" + args[-1], kinds(lambda k, name=kind: k == name) & (F.size(F.filter(rows, among(args))) == len(args)) & (F.size(values(among(args), "group")) > 1)))
    found.append(("standard_error_for_deviation", kinds(lambda k: k.isin("effect_size", "hedges_g")) & F.exists(rows, lambda x: x["argument"].isin("sd1", "sd2") & x["mislabelled"])))
    unusable = F.exists(rows, lambda x: is_input(x) & ~x["usable"])
    wide = held.select("check_id", unusable.alias("unusable"), F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in found])).alias("errors"))
    # without usable numbers nothing else is said
    errors = F.when(F.col("unusable"), F.array(F.lit("no_usable_number"))).otherwise(F.array_distinct("errors"))
    return wide.select("check_id", F.explode(errors).alias("error"))


def replay_differences(stored: DataFrame, replayed: DataFrame, key: str) -> DataFrame:
    """Two tables of figures by key -> field, key, stored, replayed of every figure that differs, is missing or is too many."""
    fields = [c for c in replayed.columns if c != key]
    long = lambda df, name: df.select(F.col(key).cast("string").alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("x")).select("key", "x.*")
    both = long(stored, "stored").join(long(replayed, "replayed"), ["key", "field"], "full")
    return both.where(~F.col("stored").eqNullSafe(F.col("replayed"))).select("field", "key", "stored", "replayed")
