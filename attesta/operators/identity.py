"""Research objects: from canonical works, from receipts, linked by directed relations and by lineage both sides keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as T

#: Relations that only their subject keeps, those that both sides keep, and what evidence of a link must hold (fixed values).
RELATIONS = ("cites", "contradicts", "replicates", "derived_from")
LINEAGE = ("preprint_to_vor", "correction", "retraction", "version_chain")
EVIDENCE = ("source", "queried_at", "match_fields", "conflict_fields", "human_confirmed")


def arxiv_id(s: Column) -> Column:
    """An arXiv id without address, prefix, suffix and version, in lower case."""
    t = F.trim(F.coalesce(s, F.lit("")))
    for extra in (r"(?i)^https?://arxiv\.org/(?:abs|pdf)/", r"(?i)^arxiv:\s*", r"(?i)\.pdf$", r"(?i)v\d+$"):
        t = F.regexp_replace(t, extra, "")
    return F.lower(F.trim(t))


def objects(works: DataFrame) -> DataFrame:
    """works (doi, arxiv, title, authors, year, container) -> object_id, object_type, identifiers, title, authors, year,
    container. The id is that of the DOI, else of the title's first six words, else of an untitled work."""
    doi, arxiv = T.bare_doi(F.col("doi"), "identity"), arxiv_id(F.col("arxiv"))
    entry = lambda kind, value, normal: F.when(normal != "", F.struct(F.lit(kind).alias("type"), value.alias("value"), normal.alias("normalized")))
    slug = F.array_join(F.slice(F.split(T.normal_title(F.coalesce("title", F.lit(""))), " "), 1, 6), "-")
    name = F.when(doi != "", doi).otherwise(F.coalesce(F.nullif(slug, F.lit("")), F.lit("untitled")))
    empty = F.array().cast("array<string>")
    return works.select(F.concat(F.lit("ro:work:"), name).alias("object_id"), F.lit("Work").alias("object_type"), F.array_compact(F.array(entry("doi", F.col("doi"), doi), entry("arxiv_id", F.col("arxiv"), arxiv))).alias("identifiers"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("authors", empty).alias("authors"), "year", F.coalesce("container", F.lit("")).alias("container"))


def checked_links(links: DataFrame) -> DataFrame:
    """links (a, b, kind, and the five columns of evidence) -> with error: missing_evidence, same_object or unknown_kind, else null."""
    lacking = F.lit(False)
    for c in EVIDENCE:
        lacking = lacking | F.col(c).isNull()
    error = F.when(lacking, "missing_evidence").when(F.col("a").eqNullSafe(F.col("b")), "same_object").when(~F.coalesce(F.col("kind").isin(*RELATIONS, *LINEAGE), F.lit(False)), "unknown_kind")
    return links.withColumn("error", error)


def edges_of(links: DataFrame) -> DataFrame:
    """Sound links -> holder, holds (relations or lineage), from_object, to_object, kind and the evidence: a relation is held by
    its subject alone, an edge of lineage by both ends, its direction kept in it."""
    sound = checked_links(links).where("error is null")
    lineage = F.col("kind").isin(*LINEAGE)
    holders = F.when(lineage, F.array("a", "b")).otherwise(F.array("a"))
    return sound.select(F.explode(holders).alias("holder"), F.when(lineage, "lineage").otherwise("relations").alias("holds"), F.col("a").alias("from_object"), F.col("b").alias("to_object"), "kind", *EVIDENCE)


#: What a claim of a receipt leaves open, and whether a person must look (fixed values).
OPEN_CLAIMS = {"contradicted": ("contradicted_claim", True), "unverifiable": ("unverifiable_claim", False), "out_of_scope": ("out_of_scope_claim", False)}
RECEIPT = "schema_version string, sources array<struct<source: string, queried_at: string, status: string, coverage: string, raw_identifier: string>>, claims array<struct<claim: string, support_status: string>>, conflicts array<string>, failures array<string>"


def observations(receipts: DataFrame) -> DataFrame:
    """receipts (key, receipt JSON) -> key, source, queried_at, status, coverage, raw_identifier of every source; what is missing is
    empty, a missing status skipped, and the last two null."""
    s = receipts.select("key", F.explode(F.from_json("receipt", RECEIPT)["sources"]).alias("s"))
    text = lambda c, otherwise: F.coalesce(F.col(f"s.{c}"), F.lit(otherwise)).alias(c)
    given = lambda c: F.nullif(F.col(f"s.{c}"), F.lit("")).alias(c)
    return s.select("key", text("source", ""), text("queried_at", ""), text("status", "skipped"), given("coverage"), given("raw_identifier"))


def open_questions(receipts: DataFrame) -> DataFrame:
    """receipts (key, receipt JSON) -> key, item, kind, needs_human: what they leave open. Of a version other than 1.0 only that
    is said."""
    r = receipts.select("key", F.from_json("receipt", RECEIPT).alias("r"))
    known = F.col("r.schema_version").eqNullSafe(F.lit("1.0"))
    row = lambda item, kind, human: F.struct(item.alias("item"), F.lit(kind).alias("kind"), F.lit(human).alias("needs_human"))
    none = F.array().cast("array<struct<item: string, kind: string, needs_human: boolean>>")
    no_claims, no_texts = F.array().cast("array<struct<claim: string, support_status: string>>"), F.array().cast("array<string>")

    def left_open(status: str, kind: str, human: bool) -> Column:
        those = F.filter(F.coalesce("r.claims", no_claims), lambda c: c["support_status"] == status)
        return F.transform(those, lambda c: row(F.coalesce(c["claim"], F.lit("")), kind, human))

    def said(field: str, kind: str, human: bool) -> Column:
        return F.transform(F.coalesce(f"r.{field}", no_texts), lambda x: row(x, kind, human))

    parts = [*(left_open(status, kind, human) for status, (kind, human) in OPEN_CLAIMS.items()), said("conflicts", "receipt_conflict", True), said("failures", "query_failure", False)]
    items = F.when(known, F.concat(*parts)).otherwise(F.array(row(F.lit("unsupported schema_version"), "unsupported_schema_version", True)))
    return r.select("key", F.explode(F.coalesce(items, none)).alias("x")).select("key", "x.*")


def compare_works(works: DataFrame, target: DataFrame, fields: tuple[str, ...] = ("doi", "title", "year")) -> DataFrame:
    """works (key, provider, and fields), target (key, and fields) -> key, field, known, agree, conflicts: of the providers' values
    that are known, how many agree with the target's; null target: with each other's least."""
    normal = {"doi": lambda c: F.nullif(T.bare_doi(c), F.lit("")), "title": lambda c: F.nullif(T.normal_title(c), F.lit("")), "year": lambda c: c.cast("string")}
    long = lambda df, *keep: df.select("key", *keep, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), normal[f](F.col(f)).alias("value")) for f in fields])).alias("x")).select("key", *keep, "x.*")
    w = long(works, "provider").where("value is not null")
    goal = long(target).withColumnRenamed("value", "wanted")
    first = w.groupBy("key", "field").agg(F.min("value").alias("least"))
    met = w.join(goal, ["key", "field"], "left").join(first, ["key", "field"]).withColumn("same", F.col("value") == F.coalesce("wanted", "least"))
    return met.groupBy("key", "field").agg(F.count(F.lit(1)).alias("known"), F.count_if("same").alias("agree"), F.array_sort(F.collect_set(F.when(~F.col("same"), F.col("provider")))).alias("conflicts"))
