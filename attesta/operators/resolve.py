"""Entity resolution: candidates of several layers merged into works, and records judged as one object with the evidence for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators.components import connected_components
from attesta.operators.corpus import longest, similar_titles
from attesta.store import written


def candidate_key(doi: Column, openalex: Column, title: Column, year: Column) -> Column:
    """doi before openalex before title with year (without, where there is none); null if there is nothing to go by."""
    d, t = F.nullif(T.bare_doi(doi), F.lit("")), F.nullif(T.normal_title(title), F.lit(""))
    return F.coalesce(F.concat(F.lit("doi:"), d), F.concat(F.lit("openalex:"), openalex), F.concat(F.lit("title:"), t, F.coalesce(F.concat(F.lit("#"), F.nullif(year.cast("string"), F.lit(""))), F.lit(""))))


def _fullest(value: Column) -> Column:
    """Aggregate: the array of most members, of these the one with the greatest canonical JSON."""
    return F.max(F.when(value.isNotNull(), F.struct(F.size(value).alias("n"), F.to_json(value).alias("j"), value.alias("v"))))["v"]


def merge_candidates(works: DataFrame) -> DataFrame:
    """works (layer, doi, openalex, title, year, citations, relevance, authors, abstract, cited) -> key, the same fields merged, layers
    and merged (rows), one row a work; rows without doi, openalex or title are left out (see unidentifiable).

    An OpenAlex id joins the DOI it goes with, and with it all that bear the one or the other, as long as it goes with one
    DOI only; so a component is a DOI with its ids, and is named by the DOI. Of the joined rows the least doi, openalex and year, the greatest citations and relevance, the longest
    then greatest title and abstract, and the fullest authors and cited are kept. The order of rows is of no account; repeated
    rows count in `merged` alone.
    """
    openalex = F.nullif(F.element_at(F.split(F.trim("openalex"), "/"), -1), F.lit(""))
    told = works.select("layer", F.nullif(T.bare_doi(F.col("doi")), F.lit("")).alias("doi"), openalex.alias("openalex"), *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("title", "abstract")], "year", "citations", "relevance", "authors", "cited")
    told = told.withColumn("own", candidate_key(F.col("doi"), F.col("openalex"), F.col("title"), F.col("year"))).where("own is not null")
    links = told.where("doi is not null and openalex is not null").groupBy("openalex").agg(F.min("doi").alias("_doi"), F.max("doi").alias("_most")).where("_doi = _most")
    goes = links.select(F.concat(F.lit("openalex:"), "openalex").alias("own"), F.concat(F.lit("doi:"), "_doi").alias("_root"))
    rooted = told.join(goes, "own", "left").withColumn("key", F.coalesce("_root", "own"))
    return rooted.groupBy("key").agg(
        F.min("doi").alias("doi"), F.min("openalex").alias("openalex"), longest(F.col("title")).alias("title"), F.min("year").alias("year"), F.max("citations").alias("citations"), F.max("relevance").alias("relevance"),
        _fullest(F.col("authors")).alias("authors"), longest(F.col("abstract")).alias("abstract"), _fullest(F.col("cited")).alias("cited"), F.array_sort(F.collect_set("layer")).alias("layers"), F.count("*").alias("merged"),
    )


def unidentifiable(works: DataFrame) -> DataFrame:
    """How many rows merge_candidates leaves out: skipped."""
    return works.agg(F.count_if(candidate_key(F.col("doi"), F.nullif(F.trim("openalex"), F.lit("")), F.col("title"), F.col("year")).isNull()).alias("skipped"))


def identity_text(s: Column) -> Column:
    """A title or name as identities are compared by: lower case, its runs of letters, digits and underscores one space apart."""
    return F.trim(F.regexp_replace(F.lower(s), r"(?U)\W+", " "))


def resolve(records: DataFrame, identifiers: DataFrame, least_similarity: float = 0.5) -> DataFrame:
    """records (batch, record, object_type, title, authors, year), identifiers (batch, record, kind, value) -> one row a batch: records,
    object_type, verdict, match_fields, conflict_fields, merged, partial (shared identifiers join some of the records only).

    The records of a batch are taken for one object, and judged: CONFLICT where a kind of identifier has two values; EXACT
    where identifiers join all records, directly or through others, or the only record has one; STRONG_MATCH for equal titles and
    authors throughout; CANDIDATE for two similar titles or an author in common; else UNRESOLVED. merged: the identifiers
    (kind, value, normalized), each with its least spelling. record is unique in its batch; null titles, years and authors are unknown.
    No batch is gathered: facts are counts by batch, and titles meet on rare words.
    """
    names = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), identity_text), lambda a: a != "")
    r = written(records.select("batch", F.col("record").cast("string").alias("record"), F.nullif("object_type", F.lit("")).alias("object_type"), F.nullif(identity_text(F.col("title")), F.lit("")).alias("title"), F.array_sort(F.array_distinct(names)).alias("authors"), F.nullif(F.col("year").cast("string"), F.lit("")).alias("year")), "resolve")
    known = identifiers.select("batch", F.col("record").cast("string").alias("record"), F.trim("kind").alias("kind"), F.trim("value").alias("value")).withColumn("normalized", T.normal_identifier(F.col("kind"), F.col("value"))).where("kind <> '' and normalized <> ''")
    known = written(known.join(r.select("batch", "record"), ["batch", "record"], "left_semi"), "resolve")
    pairs = written(known.groupBy("batch", "kind", "normalized").agg(F.min("value").alias("value"), F.min("record").alias("least"), F.max("record").alias("most")), "resolve")
    by_kind = pairs.groupBy("batch", "kind").agg((F.count("*") > 1).alias("conflict"), F.bool_or(F.col("least") < F.col("most")).alias("shared"))
    kinds = by_kind.groupBy("batch").agg(F.collect_list(F.when(F.col("conflict"), F.col("kind"))).alias("against"), F.collect_list(F.when(F.col("shared"), F.col("kind"))).alias("shared"))
    merged = pairs.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("kind", "normalized", "value"))).alias("merged"))
    # which records identifiers join: the parts of a batch are those of its graph of records and shared identifiers
    node = lambda c: F.to_json(F.struct("batch", F.col(c).alias("r")))
    shared = known.join(pairs.where("least < most").select("batch", "kind", "normalized", "least"), ["batch", "kind", "normalized"])
    label = connected_components(shared.where("record <> least").select(node("record").alias("u"), node("least").alias("v")))
    parts = r.select("batch", node("record").alias("node")).join(label, "node", "left").groupBy("batch").agg(F.count_distinct(F.coalesce("label", "node")).alias("parts"))
    facts = r.groupBy("batch").agg(
        F.count("*").alias("records"), F.array_sort(F.collect_set("object_type")).alias("types"), F.count("title").alias("titles"), F.count_distinct("title").alias("titles_of"), F.count("year").alias("years"), F.count_distinct("year").alias("years_of"),
        F.count_if(F.size("authors") > 0).alias("named"), F.min("authors").alias("first_authors"), F.max("authors").alias("last_authors"),
    )
    # titles are compared inside a batch: its name makes their words its own
    marked = r.where("title is not null").select(node("record").alias("id"), "batch", F.concat_ws(" ", F.transform(F.split("title", " "), lambda w: F.md5(F.concat_ws("|", w, F.to_json(F.struct("batch")))))).alias("title"))
    alike = similar_titles(marked.select("id", "title"), least_similarity).select(F.col("a").alias("id")).distinct().join(marked.select("id", "batch"), "id").select("batch", F.lit(True).alias("similar")).distinct()
    met = r.select("batch", "record", F.explode("authors").alias("author")).groupBy("batch", "author").agg(F.min("record").alias("a"), F.max("record").alias("b")).where("a < b").select("batch", F.lit(True).alias("together")).distinct()
    f = facts.join(parts, "batch").join(kinds, "batch", "left").join(merged, "batch", "left").join(alike, "batch", "left").join(met, "batch", "left")
    none = F.array().cast("array<string>")
    f = f.withColumn("against", F.coalesce("against", none)).withColumn("shared", F.coalesce("shared", none))
    same_title = (F.col("titles") == F.col("records")) & (F.col("titles_of") == 1)
    same_authors = (F.col("named") == F.col("records")) & (F.col("first_authors") == F.col("last_authors"))
    same_year = (F.col("years") == F.col("records")) & (F.col("years_of") == 1)
    verdict = F.when(F.size("against") > 0, "CONFLICT").when((F.size("shared") > 0) & (F.col("parts") == 1), "EXACT").when(F.col("records") == 1, F.when(F.col("merged").isNotNull(), "EXACT").otherwise("UNRESOLVED"))
    verdict = verdict.when(same_title & same_authors, "STRONG_MATCH").when(F.coalesce("similar", F.lit(False)) | F.coalesce("together", F.lit(False)), "CANDIDATE").otherwise("UNRESOLVED")
    fields = lambda base, **more: F.array_sort(F.array_distinct(F.array_compact(F.concat(base, F.array(*[F.when(c, F.lit(n)) for n, c in more.items()])))))
    return f.select(
        "batch", "records", F.coalesce(F.try_element_at("types", F.lit(1)), F.lit("Work")).alias("object_type"), verdict.alias("verdict"), fields(F.col("shared"), title=same_title, authors=same_authors, year=same_year).alias("match_fields"),
        fields(F.col("against"), title=F.col("titles_of") > 1, year=F.col("years_of") > 1, object_type=F.size("types") > 1).alias("conflict_fields"), F.coalesce("merged", F.array().cast("array<struct<kind:string,normalized:string,value:string>>")).alias("merged"),
        ((F.size("shared") > 0) & (F.col("parts") > 1)).alias("partial"),
    )
