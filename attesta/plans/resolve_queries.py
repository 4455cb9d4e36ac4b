"""Candidates merged and identities resolved over documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import resolve as R
from attesta.plans.registry import query
from attesta.store import table

#: Works made from orders: an order names its customer's work by DOI, by OpenAlex id, by both or by its title; every ninth customer's id goes with two DOIs.
_DOI = "case when o_orderkey % 4 < 2 then '10.1000/c' || o_custkey || case when o_custkey % 9 = 0 and o_orderkey % 3 = 0 then 'b' else '' end end"
_OA = "case when o_orderkey % 4 in (1, 2) then 'W' || o_custkey end"
_TITLE = "case when o_orderkey % 5 > 0 then o_orderpriority || ' of ' || (o_custkey % 100) end"
_YEAR = "case when o_orderkey % 7 > 0 then year(o_orderdate) end"


@query("merge_candidates", rf"""
with d as (select doc_id k, source layer, cast(null as varchar) doi, cast(null as varchar) oa, nullif(trim(split_part(text, chr(10), 1)), '') title, cast(null as bigint) "year", n_chars c, cast(null as double) rel, [lang] authors from documents),
o as (select o_orderkey k, o_orderstatus layer, {_DOI} doi, {_OA} oa, {_TITLE} title, {_YEAR} "year", cast(null as bigint) c, o_totalprice rel, case when o_orderkey % 2 = 0 then [o_orderstatus, o_orderpriority] else [o_orderpriority] end authors from orders),
w as (select *, nullif(array_to_string(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+'), ' '), '') t from (select * from d union all select * from o)),
x as (select *, coalesce('doi:' || doi, 'openalex:' || oa, 'title:' || t || coalesce('#' || "year", '')) own from w), g as (select oa, min(doi) root from x where doi is not null and oa is not null group by oa having count(distinct doi) = 1),
y as (select x.*, case when own = 'openalex:' || x.oa and root is not null then 'doi:' || root else own end "key" from x left join g using (oa) where own is not null)
select "key", min(doi) doi, min(oa) openalex, arg_max(title, (length(title), title)) title, min("year")::int "year", max(c) citations, max(rel) relevance, arg_max(array_to_string(authors, ';'), (len(authors), to_json(authors)::varchar)) authors, array_to_string(list_sort(list_distinct(list(layer))), ',') layers, count(*) merged from y group by "key" """)
def merge_candidates(spark, d):
    """First lines of documents, and orders, as candidates."""
    none = lambda kind: F.lit(None).cast(kind)
    docs = table(spark, d, "documents").select(F.col("source").alias("layer"), none("string").alias("doi"), none("string").alias("openalex"), F.substring_index("text", "\n", 1).alias("title"), none("int").alias("year"), F.col("n_chars").alias("citations"), none("double").alias("relevance"), F.array("lang").alias("authors"))
    o = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("layer"), F.concat(F.lit("https://doi.org/"), F.upper(F.expr(_DOI))).alias("doi"), F.concat(F.lit("https://openalex.org/"), F.expr(_OA)).alias("openalex"), F.expr(_TITLE).alias("title"), F.expr(_YEAR).alias("year"),
        none("long").alias("citations"), F.col("o_totalprice").alias("relevance"), F.when(o % 2 == 0, F.array("o_orderstatus", "o_orderpriority")).otherwise(F.array("o_orderpriority")).alias("authors"),
    )
    works = docs.unionByName(orders).withColumn("abstract", none("string")).withColumn("cited", none("array<string>"))
    found = R.merge_candidates(works)
    return found.select("key", "doi", "openalex", "title", "year", "citations", "relevance", F.array_join("authors", ";").alias("authors"), F.array_join("layers", ",").alias("layers"), "merged")


#: Three orders in a row are records of one batch; their identifiers, titles, authors and years are what the orders hold.
_IDS = [("doi", "o_orderstatus <> 'P' and o_custkey % 3 > 0", "'DOI: 10.1/' || upper(o_orderstatus)", "'10.1/' || lower(o_orderstatus)"), ("pmid", "o_custkey % 5 = 0", "'PMID ' || (o_custkey % 2)", "(o_custkey % 2)::varchar"), ("orcid", "o_orderkey % 4 = 1 and o_custkey % 7 > 2", "'https://orcid.org/0000-' || (o_orderkey // 12)", "'0000' || (o_orderkey // 12)")]


@query("identity_resolution", rf"""
with r as (select o_orderkey // 3 batch, o_orderkey rec, array_to_string(regexp_extract_all(lower(o_orderpriority), '\w+'), ' ') title, case when o_custkey % 4 > 0 then o_custkey % 6 end author, year(o_orderdate) y from orders),
i as ({" union all ".join(f"select o_orderkey // 3 batch, o_orderkey rec, '{k}' kind, {n} norm from orders where {w}" for k, w, _, n in _IDS)}),
p as (select batch, kind, norm, count(*) n, min(rec) a, max(rec) b from i group by all), k as (select batch, kind, count(*) > 1 against, bool_or(a < b) shared from p group by all),
e as (select distinct x.batch, x.rec a, y.rec b from i x join i y on x.batch = y.batch and x.kind = y.kind and x.norm = y.norm), n2 as (select distinct e.batch, e.a, f.b from e join e f on e.batch = f.batch and e.b = f.a),
j as (select r.batch, count(*) = count(c) whole from r left join (select distinct n2.batch, b c from n2 join (select batch, min(rec) m from r group by batch) q on n2.batch = q.batch and n2.a = q.m) z on r.batch = z.batch and r.rec = z.c group by r.batch),
s as (select distinct x.batch from r x join r y on x.batch = y.batch and x.rec < y.rec where 2 * len(list_intersect(string_split(x.title, ' '), string_split(y.title, ' '))) >= len(list_distinct(list_concat(string_split(x.title, ' '), string_split(y.title, ' ')))) or x.author = y.author),
f as (select batch, count(*) records, count(distinct title) titles, count(distinct author) = 1 and count(author) = count(*) same_a, count(distinct y) yrs from r group by batch),
g as (select f.*, coalesce(whole, false) or records = 1 whole, (select list(kind) from k where k.batch = f.batch and against) ag, (select list(kind) from k where k.batch = f.batch and shared) sh, f.batch in (select batch from s) alike, f.batch in (select batch from i) has from f left join j using (batch))
select batch, records, case when ag is not null then 'CONFLICT' when sh is not null and whole then 'EXACT' when records = 1 then case when has then 'EXACT' else 'UNRESOLVED' end when titles = 1 and same_a then 'STRONG_MATCH' when alike then 'CANDIDATE' else 'UNRESOLVED' end verdict,
  array_to_string(list_sort(list_concat(coalesce(sh, []), case when titles = 1 then ['title'] else [] end, case when same_a then ['authors'] else [] end, case when yrs = 1 then ['year'] else [] end)), '|') match_fields,
  array_to_string(list_sort(list_concat(coalesce(ag, []), case when titles > 1 then ['title'] else [] end, case when yrs > 1 then ['year'] else [] end)), '|') conflict_fields, (select count(*) from p where p.batch = g.batch) identifiers, sh is not null and not whole partial from g""")
def identity_resolution(spark, d):
    """Batches of three orders in a row."""
    orders = table(spark, d, "orders").withColumn("batch", F.floor(F.col("o_orderkey") / 3).cast("long"))
    author = F.when(F.col("o_custkey") % 4 > 0, F.array(F.concat(F.lit("Author, No. "), (F.col("o_custkey") % 6).cast("string")))).otherwise(F.array().cast("array<string>"))
    records = orders.select("batch", F.col("o_orderkey").alias("record"), F.lit("Work").alias("object_type"), F.col("o_orderpriority").alias("title"), author.alias("authors"), F.year("o_orderdate").alias("year"))
    ids = None
    for kind, when, raw, _ in _IDS:
        one = orders.where(when).select("batch", F.col("o_orderkey").alias("record"), F.lit(kind).alias("kind"), F.expr(raw.replace("o_orderkey // 12", "cast(floor(o_orderkey / 12) as long)")).alias("value"))
        ids = one if ids is None else ids.unionByName(one)
    found = R.resolve(records, ids)
    return found.select("batch", "records", "verdict", F.array_join("match_fields", "|").alias("match_fields"), F.array_join("conflict_fields", "|").alias("conflict_fields"), F.size("merged").cast("long").alias("identifiers"), "partial")
