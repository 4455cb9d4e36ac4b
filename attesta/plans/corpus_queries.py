"""Text functions, corpus merging and graphs over documents, orders, parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import corpus as L
from attesta.operators import graph as G
from attesta.plans.registry import query
from attesta.store import spread, table

# text functions

_TITLE = "array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' ')"


@query("title_normalize", f"select doc_id, {_TITLE.format('text')} title from documents")
def title_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normal_title(F.col("text")).alias("title"))


@query("title_jaccard", "with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) w from documents) select a.doc_id, round(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0)::double, 6) jaccard, round(len(list_intersect(a.w, b.w)) / nullif(len(a.w), 0)::double, 6) coverage from w a join w b on b.doc_id = xor(a.doc_id, 1)")
def title_jaccard(spark, d):
    """Every text against that of the id beside it, over all their words."""
    w = table(spark, d, "documents").select("doc_id", T.title_words(F.col("text")).alias("w"))
    other = w.select(F.col("doc_id").bitwiseXOR(F.lit(1)).alias("doc_id"), F.col("w").alias("v"))
    return w.join(other, "doc_id").select("doc_id", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"), F.round(T.coverage(F.col("w"), F.col("v")), 6).alias("coverage"))


#: Texts of every grammar, right and wrong, by the rest of the key by 26; both engines read this.
_RAW = "case o_orderkey % 26 " + " ".join(f"when {i} then {x}" for i, x in enumerate((
    "'https://doi.org/10.1234/AbC.' || o_orderkey || '.'", "'doi: 10.5555/x' || o_orderkey", "'arXiv:2101.' || lpad(cast(o_orderkey % 100000 as varchar(9)), 5, '0') || 'v' || (1 + o_orderkey % 4)", "'PMID: ' || o_orderkey",
    "'https://openalex.org/w' || o_orderkey", "'W' || o_orderkey", "'https://openalex.org/A' || o_orderkey || '/'", "'  ' || o_orderkey || ' '", "'hep-th/' || lpad(cast(o_orderkey as varchar(9)), 7, '0')",
    "'math.GT/' || lpad(cast(o_orderkey as varchar(9)), 7, '0') || 'v2'", "'https://arxiv.org/pdf/2101.' || lpad(cast(o_orderkey % 100000 as varchar(9)), 5, '0') || 'V2.PDF'", "'http://arxiv.org/abs/0704.' || lpad(cast(o_orderkey % 10000 as varchar(9)), 4, '0')",
    "'10.1000/Q' || o_orderkey || '.'", "'doi:11.1000/' || o_orderkey", "'http://dx.doi.org/10.123/' || o_orderkey", "'https://pubmed.ncbi.nlm.nih.gov/' || o_orderkey || '/'", "'PMID:123456789' || o_orderkey", "'X' || o_orderkey",
    "'0000-0002-1825-0097'", "cast(null as varchar(9))", "''", "'arxiv:' || o_orderkey", "'pmid:12a'", "'t' || o_orderkey", "'DOI:10.1000/' || o_orderkey || '...'", "'arxiv.org/abs/2101.00001'",
))) + " end"


@query("identifier_normalize", rf"""
with r as (select o_orderkey id, trim(coalesce({_RAW}, '')) t from orders), l as (select *, lower(t) w from r),
p as (select *, case when regexp_matches(w, '^(https?://(dx\.)?doi\.org/|doi:)') then 'doi' when regexp_matches(w, '^(https?://arxiv\.org/(abs|pdf)/|arxiv:)') then 'arxiv' when regexp_matches(w, '^(https?://pubmed\.ncbi\.nlm\.nih\.gov/|pmid:)') then 'pmid' when starts_with(w, 'https://openalex.org/') then 'openalex' end pre from l),
c as (select *, case pre when 'doi' then rtrim(trim(regexp_replace(w, '^(https?://(dx\.)?doi\.org/|doi:)', '')), '.') when 'arxiv' then trim(trim(case when w like '%arxiv.org/pdf/%' then regexp_replace(split_part(w, '/pdf/', 2), '\.pdf$', '') else regexp_replace(t, '(?i)^(https?://arxiv\.org/abs/|arxiv:)', '') end), '/')
  when 'pmid' then trim(trim(regexp_replace(w, '^(https?://pubmed\.ncbi\.nlm\.nih\.gov/|pmid:)', '')), '/') when 'openalex' then upper(trim(trim(substr(t, 22)), '/')) end v from p),
k as (select *, case when pre is not null then pre when regexp_matches(t, '^\d{{4}}\.\d{{4,5}}(v\d+)?$') or regexp_matches(w, '^[a-z][a-z-]*(\.[a-z]{{2}})?/\d{{7}}(v\d+)?$') then 'arxiv' when regexp_matches(w, '^10\.\d{{4,9}}/\S+$') then 'doi' when regexp_matches(upper(t), '^[WASTCPFI]\d+$') then 'openalex' when regexp_matches(t, '^\d{{1,9}}$') then 'pmid' end kind from c),
x as (select id, kind, case when pre is null then case kind when 'doi' then w when 'openalex' then upper(t) else t end else v end value from k),
y as (select id, case when kind = 'doi' and regexp_matches(value, '^10\.\d{{4,9}}/\S+$') or kind = 'arxiv' and (regexp_matches(value, '^\d{{4}}\.\d{{4,5}}(v\d+)?$') or regexp_matches(lower(value), '^[a-z][a-z-]*(\.[a-z]{{2}})?/\d{{7}}(v\d+)?$')) or kind = 'pmid' and regexp_matches(value, '^\d{{1,9}}$') or kind = 'openalex' and regexp_matches(value, '^[WASTCPFI]\d+$') then kind end kind, value from x)
select id, coalesce(kind, 'unknown') "type", case when kind is not null then value end "value", case kind when 'doi' then 'https://doi.org/' || value when 'arxiv' then 'https://arxiv.org/abs/' || value when 'pmid' then 'https://pubmed.ncbi.nlm.nih.gov/' || value || '/' when 'openalex' then 'https://openalex.org/' || value end canonical from y""")
def identifier_normalize(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.identifier(F.expr(_RAW)).alias("x")).select("id", "x.*")


_KIND = "['doi', 'arxiv_id', 'pmid', 'pmcid', 'openalex_id', 'orcid', 'isbn', 'issn', 'handle', 'url', 'other']"
_KINDED = "case o_orderkey % 11 " + " ".join(f"when {i} then {x}" for i, x in enumerate((
    "'DOI: 10.1000/Q' || o_orderkey", "'https://arxiv.org/pdf/2101.12345V' || o_orderkey || '.pdf'", "'PMID ' || o_orderkey || ' (x)'", "'pmc ' || o_orderkey || 'a'", "'https://openalex.org/w' || o_orderkey || '/'", "'https://ORCID.org/0000-0002-' || o_orderkey || '-009x'",
    "'ISBN 978-' || o_orderkey || '-X'", "'1234-567x'", "'http://hdl.handle.net/20.500/' || o_orderkey", "'HTTPS://Example.ORG/Path' || o_orderkey || '//'", "'  Left as it is ' || o_orderkey || ' '",
))) + " end"


@query("identifier_by_kind", rf"""
with r as (select o_orderkey id, {_KIND}[(o_orderkey % 11 + 1)::int] kind, trim({_KINDED}) t from orders)
select id, kind, case kind when 'doi' then lower(trim(regexp_replace(t, '(?i)^(https?://(dx\.)?doi\.org/|doi:\s*|doi\.org/)', ''))) when 'arxiv_id' then lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)^https?://arxiv\.org/(abs|pdf)/', ''), '(?i)^arxiv:\s*', ''), '(?i)\.pdf$', ''), '(?i)v\d+$', ''))
  when 'pmid' then regexp_replace(t, '\D', '', 'g') when 'pmcid' then upper(regexp_replace(regexp_replace(t, '(?i)^PMC\s*', ''), '\s', '', 'g')) when 'openalex_id' then upper(regexp_extract(rtrim(t, '/'), '[^/]*$')) when 'orcid' then upper(regexp_replace(regexp_replace(t, '(?i)^https?://orcid\.org/', ''), '[^0-9Xx]', '', 'g'))
  when 'isbn' then upper(regexp_replace(t, '[^0-9Xx]', '', 'g')) when 'issn' then upper(regexp_replace(t, '[^0-9Xx]', '', 'g')) when 'handle' then trim(regexp_replace(t, '(?i)^https?://(hdl\.)?handle\.net/', '')) when 'url' then lower(regexp_extract(t, '^[^:]+://[^/]+')) || substr(rtrim(t, '/'), length(regexp_extract(t, '^[^:]+://[^/]+')) + 1) else t end "value" from r""")
def identifier_by_kind(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in (*T.KINDS, "other")]), (F.col("o_orderkey") % 11 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind"), T.normal_identifier(kind, F.expr(_KINDED)).alias("value"))


@query("arxiv_versions", f"select o_orderkey id, regexp_extract(lower({_RAW}), '(\\d{{4}}\\.\\d{{4,5}}|/\\d{{7}})v(\\d+)', 2) v, try_cast(nullif(v, '') as int) version from orders".replace("select o_orderkey id, ", "select id, version from (select o_orderkey id, ") + ")")
def arxiv_versions(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.arxiv_version(F.expr(_RAW)).alias("version"))


@query("doi_extraction", "select o_orderkey id, '10.1000/a' || o_orderkey || '|10.2000/b' dois from orders")
def doi_extraction(spark, d):
    text = F.concat(F.lit("See 10.1000/A"), F.col("o_orderkey").cast("string"), F.lit(", (10.2000/b) and 10.2000/B."))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(T.dois_in(text), "|").alias("dois"))


@query("name_split", "select c_custkey, split_part(c_name, '#', 1) family, split_part(c_name, '#', 2) given from customer")
def name_split(spark, d):
    family, given = F.split_part("c_name", F.lit("#"), F.lit(1)), F.split_part("c_name", F.lit("#"), F.lit(2))
    flip = F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(", ", family, given)).otherwise(F.concat_ws(" ", given, family))
    return table(spark, d, "customer").select("c_custkey", T.split_name(flip).alias("n")).select("c_custkey", "n.*")


@query("citekeys", "select c_custkey, 'customer' || (1990 + c_custkey % 30) || 'learning' citekey from customer")
def citekeys(spark, d):
    authors = F.array(F.concat(F.lit("Customer, No "), F.col("c_custkey").cast("string")))
    return table(spark, d, "customer").select("c_custkey", T.citekey(authors, 1990 + F.col("c_custkey") % 30, F.lit("On the Learning of it")).alias("citekey"))


@query("abstract_rebuild", "select doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') abstract from documents")
def abstract_rebuild(spark, d):
    """Whole texts to inverted indexes and back, each in its own row."""
    words = F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda x: x != "")
    index = L.inverted_indexes(spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", words.alias("words")))
    return index.select("doc_id", T.rebuild_abstract(F.col("index")).alias("abstract"))


@query("tex_escape", "select p_partkey, replace(replace(p_name || '_50%&', '_', '\\_'), '%', '\\%') name0, p_name || '_50%&' back from part".replace("name0", "x").replace("select p_partkey, replace(replace(p_name || '_50%&', '_', '\\_'), '%', '\\%') x", "select p_partkey, replace(replace(replace(replace(p_name || '_50%&', '#', '\\#'), '_', '\\_'), '%', '\\%'), '&', '\\&') escaped"))
def tex_escape(spark, d):
    s = F.concat("p_name", F.lit("_50%&"))
    return table(spark, d, "part").select("p_partkey", T.tex_escape(s).alias("escaped"), T.tex_unescape(T.tex_escape(s)).alias("back"))


_SHOUTED = "regexp_replace(text, '\\n', ' ', 'g') || ' GPT-4, mRNA LLMs {BERT} {NASA}. (ÄÖ) A B2B ' || upper(lang)"


@query("acronym_protection", rf"""
with t as (select doc_id, unnest(string_split({_SHOUTED.replace("\\\\n", "\\n")}, ' ')) w, generate_subscripts(string_split({_SHOUTED.replace("\\\\n", "\\n")}, ' '), 1) i from documents),
c as (select *, trim(w, '.,:;()[]') k from t)
select doc_id, string_agg(case when length(k) >= 2 and upper(k) = k and lower(k) <> k and not (w like '{{%}}' or k like '{{%}}' or w like '\{{%\}}' or k like '\{{%\}}') then '{{' || w || '}}' else w end, ' ' order by i) title from c group by doc_id""")
def acronym_protection(spark, d):
    """The whole texts as titles, with words of every kind after them."""
    text = F.concat(F.regexp_replace("text", "\n", " "), F.lit(" GPT-4, mRNA LLMs {BERT} {NASA}. (ÄÖ) A B2B "), F.upper("lang"))
    return table(spark, d, "documents").select("doc_id", T.protect_acronyms(text).alias("title"))


@query("number_literals", "with v(i, value) as (values (0, 1234.5), (1, 3.0), (2, null), (3, 0.01), (4, 20.0), (5, 42.0), (6, 91.0), (7, 1200345.0), (8, null), (9, 0.5)), u(i, unit) as (values (0, 'pp'), (1, 'ms'), (2, '%'), (3, 'us'), (4, 'x'), (5, 'parsec')) select p_partkey, value::double \"value\", unit from part join v on v.i = p_partkey % 10 join u on u.i = p_partkey % 6")
def number_literals(spark, d):
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("p_partkey") % len(x) + 1).cast("int"))
    number = pick("1,234.5 items", "three", "2 of 3", "p = 1e-2", "Twenty", "forty-two", "ninety  one", "1,200, 345", "no number", "about .5")
    return table(spark, d, "part").select("p_partkey", T.number_in(number).alias("value"), T.unit(pick(" Percentage  Points ", "Milliseconds", "pct", "µs", "×", "parsec")).alias("unit"))


@query("doi_forms", "with f as (select p_partkey, '10.1/a' || p_partkey b, p_partkey % 4 c from part) select p_partkey, case c when 0 then b || '/' when 1 then b || '.' when 2 then 'doi.org/' || b else 'http://dx.doi.org/' || b end works, case c when 0 then b || '/' when 1 then b || '.' else b end identity_, case c when 1 then b || '.' when 2 then 'doi.org/' || b else b end locator, case c when 0 then b || '/' when 2 then 'doi.org/' || b else b end kernel from f")
def doi_forms(spark, d):
    """One DOI in four spellings, as four of the readers have it."""
    k = F.col("p_partkey").cast("string")
    c = F.col("p_partkey") % 4
    raw = F.when(c == 0, F.concat(F.lit(" DOI: 10.1/A"), k, F.lit("/"))).when(c == 1, F.concat(F.lit("https://doi.org/10.1/A"), k, F.lit("."))).when(c == 2, F.concat(F.lit("doi.org/10.1/A"), k)).otherwise(F.concat(F.lit("http://dx.doi.org/10.1/A"), k))
    return table(spark, d, "part").select("p_partkey", *[T.bare_doi(raw, form).alias("identity_" if form == "identity" else form) for form in ("works", "identity", "locator", "kernel")])


@query("entry_keys", "select c_custkey, case when c_custkey % 4 = 0 then 'anon' else 'obrien' || c_custkey end || case when c_custkey % 3 = 0 then 'nd' else (1990 + c_custkey % 30)::varchar end || case when c_custkey % 5 = 0 then 'untitled' else '3d' end \"key\" from customer")
def entry_keys(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", T.entry_key(F.when(k % 4 > 0, F.concat(F.lit("O'Brien"), k.cast("string"))), F.when(k % 3 > 0, 1990 + k % 30), F.when(k % 5 > 0, "3D scenes of it").otherwise("")).alias("key"))


@query("author_sets", "select p_partkey, 'doe ann ' || p_partkey || '|王 小 明' names from part")
def author_sets(spark, d):
    k = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select("p_partkey", F.array_join(T.normal_authors(F.array(F.concat(F.lit("Doe, Ann-"), k), F.lit("王小明"), F.concat(F.lit("DOE Ann "), k))), "|").alias("names"))


@query("canonical_json_digest", "select event_id, sha256('{\"a\":[1,2],\"k\":' || (props->>'k') || ',\"ü\":\"x\"}') digest from events")
def canonical_json_digest(spark, d):
    s = F.concat(F.lit('{ "ü" : "x", "k":'), F.get_json_object("props", "$.k"), F.lit(', "a": [1,  2] }'))
    return table(spark, d, "events").select("event_id", F.sha2(T.canonical_json(s), 256).alias("digest"))


@query("target_paths", "select p_partkey, 'src/m' || p_partkey || '.py' \"path\", 'core' \"class\" from part")
def target_paths(spark, d):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "./src/m").otherwise("C:\\src\\m"), F.col("p_partkey").cast("string"), F.lit(".py:12"))
    return table(spark, d, "part").select("p_partkey", T.target_path(raw).alias("path")).withColumn("class", T.path_class(F.col("path")))


@query("issue_identity", "select p_partkey, case when p_partkey % 2 = 0 then 'k' || p_partkey else left(sha256(lower('Claim no ' || p_partkey)), 12) end issue from part")
def issue_identity(spark, d):
    k = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select("p_partkey", T.issue_identity(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" K"), k)), F.concat(F.lit("Claim  no "), k)).alias("issue"))


@query("payload_decode", "select event_id, case when event_id % 5 = 0 then null else strlen(props)::int end bytes from events")
def payload_decode(spark, d):
    s = F.when(F.col("event_id") % 5 == 0, F.lit("%%%")).otherwise(F.base64(F.col("props").cast("binary")))
    return table(spark, d, "events").select("event_id", F.octet_length(T.payload(s)).alias("bytes"))


@query("json_in_prose", "select event_id, (props->>'k')::int k from events")
def json_in_prose(spark, d):
    s = F.concat(F.lit("Set {x | x > 0} first: {not: json} then "), F.col("props"), F.lit(' and {"k": 1}.'))
    return table(spark, d, "events").select("event_id", F.get_json_object(T.first_json_object(s), "$.k").cast("int").alias("k"))


# corpus


def works(spark, d):
    """Documents as works; a title is the whole first line."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.col("source").alias("layer"), F.substring_index("text", "\n", 1).alias("title"), (1990 + F.col("n_chars") % 30).alias("year"), F.col("n_chars").alias("citations"), F.when(F.col("doc_id") % 3 > 0, F.length("text") / 7.0).alias("relevance"), "lang")


_LINE = "split_part(text, chr(10), 1)"
_W = f"w as (select doc_id, source layer, {_LINE} title, 1990 + n_chars % 30 as \"year\", n_chars citations, case when doc_id % 3 > 0 then length(text) / 7.0::double end relevance, lang, nullif({_TITLE.format(_LINE)}, '') k from documents)"


@query("merge_layers", f"with {_W} select k \"key\", arg_max(title, (length(title), title)) title, min(year) \"year\", max(citations) citations, round(max(relevance), 6) relevance, array_to_string(list_sort(list_distinct(list(layer))), '|') layers, count(*) merged from w where k is not null group by k")
def merge_layers(spark, d):
    w = works(spark, d).withColumn("key", F.nullif(T.normal_title(F.col("title")), F.lit("")))
    return L.merge_layers(w, "key").withColumn("relevance", F.round("relevance", 6)).withColumn("layers", F.array_join("layers", "|"))


@query("candidate_ranking", "with w as (select doc_id, n_chars citations, case when doc_id % 3 > 0 then length(text) / 7.0::double end relevance from documents) select doc_id, citations from w order by relevance is null, relevance desc, citations desc, doc_id limit 20")
def candidate_ranking(spark, d):
    return L.ranked(works(spark, d), "doc_id").limit(20).select("doc_id", "citations")


@query("work_keys", f"with {_W} select doc_id, case when doc_id % 4 = 0 then 'doi:10.1234/x' || doc_id when doc_id % 4 = 1 then 'oa:W' || doc_id else 't:' || k || '#' || \"year\" end \"key\" from w")
def work_keys(spark, d):
    k = F.col("doc_id").cast("string")
    key = L.work_key(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://doi.org/10.1234/X"), k)), F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("w"), k)), F.col("title"), F.col("year"))
    return works(spark, d).select("doc_id", key.alias("key"))


@query("dedup_first_seen", "select min(doc_id) doc_id, md5(text) h from documents group by text")
def dedup_first_seen(spark, d):
    from attesta.operators.cohort import first_seen

    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return first_seen(docs, "h", ["doc_id"])


@query("deduplicate_works", "with recursive o as (select o_orderkey pos, case when o_orderkey % 5 = 0 then o_custkey end d, o_custkey t, ['a' || (o_orderkey % 3), 'b' || (o_orderkey % 7)] a, case when o_orderkey % 4 > 0 then year(o_orderdate) end y from orders), f as (select *, min(pos) over (partition by d) p from o), w as (select *, row_number() over (partition by t order by pos) n from f where d is null or pos = p), g(t, n, kept, pos, fate, of) as (select t, 1::bigint, [{'p': pos, 'a': a, 'y': y}], pos, 'kept', null::bigint from w where n = 1 union all select t, n, case when len(m) > 0 then kept else list_append(kept, {'p': pos, 'a': a, 'y': y}) end, pos, case when len(m) > 0 then 'duplicate_title' else 'candidate' end, case when len(m) > 0 then m[1].p else kept[1].p end from (select w.t, w.n, g.kept, w.pos, w.a, w.y, list_filter(g.kept, lambda k: list_has_any(k.a, w.a) and (k.y is null or w.y is null or k.y = w.y)) m from g join w on w.t = g.t and w.n = g.n + 1)) select pos, fate, of from g union all select pos, 'duplicate_doi', p from f where d is not null and pos <> p")
def deduplicate_works(spark, d):
    """Orders as works: a customer is a title, every fifth has a DOI, authors and years vary."""
    k = F.col("o_orderkey")
    authors = F.array(F.concat(F.lit("a"), (k % 3).cast("string")), F.concat(F.lit("b"), (k % 7).cast("string")))
    w = table(spark, d, "orders").select(k.alias("pos"), F.when(k % 5 == 0, F.concat(F.lit("10.1234/"), F.col("o_custkey").cast("string"))).alias("doi"), F.col("o_custkey").cast("string").alias("title"), authors.alias("authors"), F.when(k % 4 > 0, F.year("o_orderdate")).alias("year"))
    return L.deduplicate(w)


@query("components", "select doc_id record, min(doc_id) over (partition by text) cluster from documents")
def components(spark, d):
    docs = table(spark, d, "documents")
    ids = docs.select(F.col("doc_id").alias("record"), F.explode(F.array(F.md5("text"), F.concat(F.lit("own"), F.col("doc_id").cast("string")))).alias("identifier"))
    return L.linked_records(ids)


@query("guarded_identifier_links", "with w as (select o_custkey oa, case when o_custkey % 2 = 0 then o_custkey * 10 else o_orderkey % 3 end doi from orders) select oa openalex, min(doi) doi from w group by 1 having count(distinct doi) = 1")
def guarded_links(spark, d):
    """Customers as OpenAlex ids: the even ones go with one DOI, the odd ones with one for each kind of order."""
    w = table(spark, d, "orders").select(F.col("o_custkey").alias("openalex"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey") * 10).otherwise(F.col("o_orderkey") % 3).alias("doi"))
    return L.guarded_links(w)


@query("similar_titles", f"with w as (select doc_id id, list_sort(list_distinct(regexp_extract_all(lower({_LINE}), '[\\p{{L}}\\p{{N}}]+'))) w from documents), c as (select w, min(id) id, list(id) ids from w where len(w) > 0 group by w), p as (select a.id a, b.id b, len(list_intersect(a.w, b.w)) met, len(a.w) + len(b.w) most from c a join c b on a.id < b.id and 2 * len(a.w) >= len(b.w) and 2 * len(b.w) >= len(a.w)) select a, b, round(met / (most - met)::double, 6) similarity from p where 2 * met >= most - met union all select id, unnest(list_filter(ids, lambda x: x <> id)), 1.0 from c")
def similar_titles(spark, d):
    """First lines as titles."""
    w = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"))
    return L.similar_titles(w).withColumn("similarity", F.round("similarity", 6))


@query("provider_comparison", "with r as (select o_custkey w, o_orderstatus s, o_orderpriority p from orders) select w work, 'o_orderstatus' field, count(s) present, case when count(s) >= 2 then count(distinct s) = 1 end agree from r group by 1 union all select w, 'o_orderpriority', count(p), case when count(p) >= 2 then count(distinct p) = 1 end from r group by 1")
def provider_comparison(spark, d):
    return L.compare_providers(table(spark, d, "orders").withColumnRenamed("o_custkey", "work"), "work", ["o_orderstatus", "o_orderpriority"])


@query("identity_verdicts", "with v as (select p_partkey, p_partkey % 3 c, p_partkey % 5 s, p_size / 50.0::double t, p_partkey % 2 = 0 a, p_partkey % 7 < 4 y, p_partkey % 4 n from part) select p_partkey, case when c = 2 then 'CONFLICT' when s = 4 then 'EXACT' when n < 2 then 'UNRESOLVED' when t >= 0.9 and a and y then 'STRONG_MATCH' when t >= 0.5 and (a or y) then 'CANDIDATE' else 'UNRESOLVED' end verdict from v")
def identity_verdicts(spark, d):
    k = F.col("p_partkey")
    v = L.verdict((k % 3 == 2).cast("int"), (k % 5 == 4).cast("int"), F.col("p_size") / 50.0, k % 2 == 0, k % 7 < 4, k % 4)
    return table(spark, d, "part").select("p_partkey", v.alias("verdict"))


@query("review_matrix", "select doc_id \"key\", array_to_string(list_filter(string_split(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') title, 2::int n_authors, case when doc_id % 3 = 0 then '[no abstract]' else 'A ' || doc_id end abstract from documents")
def review_matrix(spark, d):
    w = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.substring_index("text", "\n", 1).alias("title"), F.array(F.lit("a"), F.lit("b")).alias("authors"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" A  "), F.col("doc_id").cast("string"))).alias("abstract"))
    return L.review_matrix(w)


# graphs: a turn cites the one before it, orders their customers, these their nations and regions


def citations(spark, d):
    """Parts are the nodes; a line item has its part cite the number of its order, a part or something outside."""
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return nodes, table(spark, d, "lineitem").select(F.col("l_partkey").alias("citing"), F.col("l_orderkey").alias("cited"))


_C = "n as (select p_partkey node from part), e as (select l_partkey citing, l_orderkey cited, l_orderkey <> l_partkey and l_orderkey in (select node from n) inside from lineitem)"


@query("citation_in_degree", f"with {_C} select node, count(citing)::bigint in_degree from n left join (select distinct citing, cited from e where inside) on cited = node group by 1")
def citation_in_degree(spark, d):
    return G.degrees(*citations(spark, d))


@query("external_refs", f"with {_C} select citing, count(*) filter (inside) internal, count(*) filter (not inside) \"external\" from e group by 1")
def external_refs(spark, d):
    return G.reference_split(*citations(spark, d))


@query("citation_summary", f"with {_C} select (select count(*) from n)::bigint nodes, count(distinct case when inside then citing * 10000000000 + cited end) edges, count(*) filter (inside) - count(distinct case when inside then citing * 10000000000 + cited end) duplicate_edges, count(*) filter (not inside) \"external\" from e")
def citation_summary(spark, d):
    return G.summary(*citations(spark, d))


def lineage(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o = table(spark, d, "orders").select(key("o", "o_orderkey").alias("child"), key("c", "o_custkey").alias("parent"))
    c = table(spark, d, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey"))
    n = table(spark, d, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"))
    t = table(spark, d, "conversations")
    turns = t.where("turn > 0").select(F.concat_ws("-", F.lit("t"), "conv_id", "turn"), F.concat_ws("-", F.lit("t"), "conv_id", (F.col("turn") - 1).cast("string")))
    return o.union(c).union(n).union(turns)


_LIN = "e as (select 'o' || o_orderkey child, 'c' || o_custkey parent from orders union select 'c' || c_custkey, 'n' || c_nationkey from customer union select 'n' || n_nationkey, 'r' || n_regionkey from nation union select 't-' || conv_id || '-' || turn, 't-' || conv_id || '-' || (turn - 1) from conversations where turn > 0), a as (select child \"start\", parent cur, 1 depth from e union select \"start\", parent, depth + 1 from a join e on cur = child), m as (select \"start\", cur ancestor, min(depth)::int depth from a group by 1, 2)"


@query("lineage_closure", f"with recursive {_LIN} select * from m")
def lineage_closure(spark, d):
    """The ancestors of every node."""
    return G.closure(lineage(spark, d))


@query("lineage_roots", f"with recursive {_LIN} select \"start\", ancestor from m where ancestor not in (select child from e)")
def lineage_roots(spark, d):
    e = lineage(spark, d)
    return G.roots(G.closure(e), e)


@query("ring_pairing", "select n_regionkey, n_nationkey, coalesce(lead(n_nationkey) over (partition by n_regionkey order by n_nationkey), min(n_nationkey) over (partition by n_regionkey)) reviews from nation")
def ring_pairing(spark, d):
    return G.ring(table(spark, d, "nation").select("n_regionkey", "n_nationkey"), ["n_regionkey"], "n_nationkey")
