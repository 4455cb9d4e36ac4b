"""Sources and sinks, forum notes, rankings, sets and validation over orders, line items, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import forum as O
from attesta.operators import recompute as R
from attesta.plans.registry import query
from attesta.store import new_path, table


@query("json_lines_scan", "select event_id, event_type, value, (props->>'k')::bigint k from events")
def json_lines_scan(spark, d):
    path = new_path(spark, "jsonl")
    table(spark, d, "events").select("event_id", "event_type", "value", F.from_json("props", "k long").alias("props")).write.json(path)
    return spark.read.schema("event_id long, event_type string, value double, props struct<k: long>").json(path).select("event_id", "event_type", "value", "props.k")


@query("json_array_scan", """
select o_custkey document_id, o_orderkey, o_orderstatus, null as error from orders where o_custkey % 9 > 2 union all select o_custkey, null, null, 'no object' from orders where o_custkey % 9 = 2
union all select distinct o_custkey, null, null, case o_custkey % 9 when 0 then 'an empty array' else 'no array' end from orders where o_custkey % 9 < 2 union all select c_custkey, null, null, 'no JSON' from customer where c_custkey not in (select o_custkey from orders)""")
def json_array_scan(spark, d):
    """A file a customer: an array of its orders, an empty one, an object, an array of numbers, or nothing."""
    from attesta.sources import documents as A

    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("o"))
    k = F.col("o_custkey") % 9
    content = F.when(k == 0, F.lit("[]")).when(k == 1, F.to_json(F.struct("o"))).when(k == 2, F.to_json(F.transform("o", lambda x: x["o_orderkey"]))).otherwise(F.to_json("o"))
    held = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("document_id"), F.coalesce(content, F.lit("")).alias("content"))
    return A.json_arrays(held, "o_orderkey long, o_orderstatus string").select("document_id", "record.o_orderkey", "record.o_orderstatus", "error")


@query("verified_file_pick", "select 1::bigint files, sum(n_nationkey)::bigint total from nation")
def verified_file_pick(spark, d):
    from attesta.sources import documents as A

    path = new_path(spark, "picked")
    table(spark, d, "nation").coalesce(1).select(F.col("n_nationkey").cast("string").alias("value")).write.text(path)
    files = A.files(spark, path)
    want = files.where("suffix = 'txt'").select(F.col("length").alias("l"), F.col("sha256").alias("h"))  # of the one part
    one = files.join(want, (F.col("length") == F.col("l")) & (F.col("sha256") == F.col("h"))).orderBy("document_id").limit(1)
    n = F.aggregate(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: x != ""), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return one.select(F.lit(1).cast("long").alias("files"), n.alias("total"))


def notes(spark, d):
    k = F.col("l_linenumber")
    rating = F.concat((F.col("l_quantity").cast("long") % 10).cast("string"), F.lit(": text"))
    content = F.when(k % 3 == 0, F.to_json(F.struct(F.struct(rating.alias("value")).alias("rating")))).when(k == 7, F.lit('{"decision": {"value": "Accept (poster)"}}')).otherwise(F.to_json(F.struct(rating.alias("rating"))))
    inv = F.when(k == 7, "Conf/Decision").when(k == 5, "Conf/Official_Comment").when(k == 4, "Conf/Meta_Review").otherwise("Conf/Official_Review")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("forum"), inv.alias("invitation"), content.alias("content"))


@query("forum_notes", "with n as (select l_orderkey forum, l_linenumber k, l_quantity::bigint % 10 r from lineitem), s as (select forum, count(*) c, count(*) filter (k not in (4, 5, 7)) reviews, round(avg(r) filter (k not in (4, 5, 7)), 6) mean_rating, bool_or(k = 7 and k % 3 <> 0) dec from n group by 1) select forum, reviews, mean_rating, case when dec then 'accepted' else 'unknown' end status, c < 4 incomplete from s")
def forum_notes(spark, d):
    n = notes(spark, d)
    return O.forum_summary(n, n.select("forum").distinct().withColumn("count", F.lit(4)))


@query("note_classes", "select case l_linenumber when 7 then 'decision' when 5 then 'other' when 4 then 'meta_review' else 'review' end \"class\", count(*) n from lineitem group by 1")
def note_classes(spark, d):
    return notes(spark, d).groupBy(O.note_class(F.col("invitation"), F.col("content")).alias("class")).agg(F.count("*").alias("n"))


@query("oa_locations", "with l as (select l_partkey k, 'u' || l_suppkey % 20 url, case when l_returnflag = 'R' and l_linenumber % 2 = 0 then 0 when l_returnflag = 'A' then 1 when l_returnflag = 'N' then 2 else 3 end r from lineitem), o as (select k, url, min(r) r from l group by 1, 2) select k, arg_min(url, (r, url)) url, min(r)::int \"rank\", count(*) locations from o group by 1")
def oa_locations(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "repository").when(F.col("l_returnflag") == "A", "best").otherwise("link")
    loc = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), kind.alias("kind"), F.concat(F.lit("u"), (F.col("l_suppkey") % 20).cast("string")).alias("url"), (F.col("l_linenumber") % 2 == 0).alias("pdf"))
    return O.best_location(loc, "k")


@query("average_ranks", "select event_id, rank() over (partition by user_id order by abs(value - 50)) + (count(*) over (partition by user_id, abs(value - 50)) - 1) / 2.0::double avg_rank from events")
def average_ranks(spark, d):
    return O.average_ranks(table(spark, d, "events").select("event_id", "user_id", (F.col("value") - 50).alias("v")), ["user_id"], "v").select("event_id", "avg_rank")


@query("first_k_per_group", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) n from orders) where n <= 3")
def first_k(spark, d):
    return O.first_k(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("seeded_order", "select n_nationkey, md5('7|' || n_nationkey) place from nation")
def seeded_order(spark, d):
    return O.seeded_order(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", 7)


@query("set_operations", "with s as (select o_custkey k, list(distinct o_orderkey % 20) filter (o_orderstatus = 'F') a0, list(distinct o_orderkey % 20) filter (o_orderstatus <> 'F') b0 from orders group by 1), t as (select k, coalesce(a0, []) a, coalesce(b0, []) b from s) select k, len(list_distinct(list_concat(a, b)))::int n_union, len(list_intersect(a, b))::int n_both, (len(a) - len(list_intersect(a, b)))::int only_a, (len(b) - len(list_intersect(a, b)))::int only_b, len(list_intersect(a, b)) = 0 disjoint from t")
def set_operations(spark, d):
    f = F.col("o_orderstatus") == "F"
    v = F.col("o_orderkey") % 20
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.when(f, v)).alias("a"), F.collect_set(F.when(~f, v)).alias("b"))
    return O.set_sizes(s, "a", "b").drop("a", "b")


@query("layer_union", "select 'customer' layer, c_nationkey \"key\" from customer union select 'supplier', s_nationkey from supplier")
def layer_union(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("layer"), F.col("c_nationkey").alias("key"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("layer"), F.col("s_nationkey").alias("key"))).distinct()


@query("unreached_nodes", "select n_nationkey from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)")
def unreached_nodes(spark, d):
    return table(spark, d, "nation").select("n_nationkey").join(table(spark, d, "supplier").where("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti")


@query("condition_conflicts", "select l_orderkey paper, l_returnflag \"name\", l_linestatus context, 'x' unit, count(distinct l_quantity) \"values\" from lineitem group by 1, 2, 3 having count(distinct l_quantity) > 1")
def condition_conflicts(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("context"), F.lit("x").alias("unit"), F.col("l_quantity").alias("value"))
    return O.same_condition_conflicts(f)


@query("document_comparison", "with a as (select distinct o_custkey s, o_orderpriority n from orders where o_orderstatus = 'F'), b as (select distinct o_custkey s, o_orderpriority n from orders where o_orderstatus = 'O') select s, n, 'first' missing_from_other from a anti join b using (s, n) union all select s, n, 'second' from b anti join a using (s, n)")
def document_comparison(spark, d):
    """Finished and open orders as two documents, customer and priority as name and context of a field."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("s"), F.col("o_orderpriority").alias("n"), "o_orderstatus")
    a, b = (o.where(F.col("o_orderstatus") == x).select("s", "n").distinct() for x in "FO")
    return O.comparable(a, b, ["s", "n"])


@query("extraction_checks", "select p_partkey field_id, unnest(case p_partkey % 4 when 1 then ['LITERAL_NOT_IN_QUOTE'] when 2 then ['UNIT_NOT_IN_QUOTE'] when 3 then ['INEQUALITY_LOST'] else [] end) error from part")
def extraction_checks(spark, d):
    k = F.col("p_partkey")
    f = table(spark, d, "part").select(k.alias("field_id"), F.lit("extracted").alias("status"), F.when(k % 4 == 1, "7.5").otherwise("0.05").alias("literal"), F.when(k % 4 == 3, "p < 0.05 ms").otherwise("value 0.05 ms").alias("quote"), F.when(k % 4 == 2, "kg").otherwise("ms").alias("unit"))
    return O.extraction_errors(f)


@query("recompute_dispatch", "with o as (select o_orderkey id, ['percentage', 'values', 'p', 'sample_size', 'ci', 'unknown'][(o_orderkey % 6 + 1)::int] kind, o_custkey % 50 n, o_totalprice v, year(o_orderdate) % 7 y from orders) select id, kind, case kind when 'percentage' then 100 * n >= (200 * n + y - 5) * 50 / 100 and 100 * n < (200 * n + y + 5) * 50 / 100 when 'values' then abs(v - round(v, 1)) <= 0.000001 * greatest(abs(v), abs(round(v, 1))) + 1e-15 when 'p' then n / 1000.0 + y / 10000.0 >= n / 1000.0 - 0.0005 and n / 1000.0 + y / 10000.0 < n / 1000.0 + 0.0005 when 'sample_size' then y = 1 when 'ci' then abs(n + y / 100.0 - n) / greatest(n, 2e-9, 1e-12) <= 0.02 and y <= 100 end consistent, case when kind = 'unknown' then 'unsupported kind' end error from o")
def recompute_dispatch(spark, d):
    """Checks of several kinds in one table, what was printed off by the order's year; one kind is not known."""
    k, n, y = F.col("o_orderkey"), F.col("o_custkey") % 50, F.year("o_orderdate") % 7
    kinds = ("percentage", "values", "p", "sample_size", "ci", "unknown")
    rows = table(spark, d, "orders").select(k.alias("id"), F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 6 + 1).cast("int")).alias("kind"), n.alias("n"), y.alias("y"), F.col("o_totalprice").alias("v"))
    n, y, v = (F.col(x) for x in "nyv")
    printed = F.format_string("%.3f", n / 1000)
    checks = {
        "percentage": R.percentage_matches(n, 2.0 * n + y / 100.0, F.lit(50)),
        "values": R.values_agree(v, F.round(v, 1)),
        "p": R.p_matches(printed, (n / 1000 + y / 10000).cast("decimal(20,6)")),
        "sample_size": R.sample_size_from_df(n.cast("double"), n + y, F.lit("one_sample"), F.lit(1)),
        "ci": R.ci_consistency(n + y / 100.0, (n - 1).cast("double"), (n + 1).cast("double"))["consistent"],
    }
    ok = F.coalesce(*[F.when(F.col("kind") == kind, check) for kind, check in checks.items()])
    return rows.select("id", "kind", ok.alias("consistent"), F.when(~F.col("kind").isin(*checks), "unsupported kind").alias("error"))


@query("incidence_join", "with f as (select doc_id, min(quality) q from labels group by 1), t as (select distinct on (md5(text)) doc_id, source from documents order by md5(text), doc_id) select source, count(*) papers, sum(q)::bigint good from t join f using (doc_id) group by 1")
def incidence_join(spark, d):
    from attesta.operators.cohort import first_seen

    texts = first_seen(table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("h")), "h", ["doc_id"])
    meta = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return texts.join(meta, "doc_id").groupBy("source").agg(F.count("*").alias("papers"), F.sum("q").cast("long").alias("good"))


@query("replay_equality", "with f as (select doc_id, min(quality) q from labels group by 1), t as (select distinct on (md5(text)) doc_id, source from documents order by md5(text), doc_id), r as (select source, count(*) papers, sum(q)::bigint good from t join f using (doc_id) group by 1) select 'papers' field, source \"key\", (papers + 1)::varchar stored, papers::varchar replayed from r where papers % 2 = 1 union all select 'good', source, null, good::varchar from r where good % 3 = 0")
def replay_equality(spark, d):
    """A stored receipt against the same figures computed anew: where it says one more, and where it says nothing."""
    now = incidence_join(spark, d)
    stored = now.select("source", (F.col("papers") + F.col("papers") % 2).alias("papers"), F.when(F.col("good") % 3 != 0, F.col("good")).alias("good"))
    return O.replay_differences(stored, now, "source")


@query("inline_edge_forms", "with o as (select o_orderkey n, o_custkey \"doc\", o_orderkey % 7 f, 'x' || o_orderkey a, 'x' || (o_orderkey + 1) b from orders) select \"doc\", n, case f when 0 then a when 1 then b when 2 then a when 3 then a when 4 then a end child, case f when 0 then b when 1 then a when 2 then b when 3 then b when 4 then b end parent, case f when 5 then 'unsupported_type' when 6 then 'unrecognised_form' end error from o")
def inline_edge_forms(spark, d):
    from attesta.operators import validate as V

    k = F.col("o_orderkey")
    a, b = (F.concat(F.lit("x"), x.cast("string")) for x in (k, k + 1))
    form = lambda *which: F.when((k % 7).isin(*which), F.lit(True))
    raw = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc"), k.alias("n"), F.when(form(0), a).alias("child_id"), F.when(form(0), b).alias("parent_id"), F.when(form(1, 2, 5), a).when(form(3), b).alias("source_id"), F.when(form(1, 2, 5), b).alias("target_id"),
        F.when(form(3), a).alias("derived_id"), F.when(form(4), a).alias("entity_id"), F.when(form(4), b).alias("used_id"), F.when(form(1), " Produced").when(form(2), "used").when(form(5), "likes").alias("type"),
    )
    return V.inline_edges(raw).select("doc", "n", "child", "parent", "error")


@query("context_checks", "with o as (select o_orderkey id, o_custkey c, ['t_p', 'effect_size', 'ci_consistency', 'percentage'][(o_orderkey % 4 + 1)::int] kind from orders), l as (select id check_id, kind, l_linenumber ln, l_returnflag g, l_linestatus u, l_suppkey % 3 = 0 later from o join (select l_orderkey, l_linenumber, any_value(l_returnflag order by l_partkey, l_suppkey, l_quantity) l_returnflag, any_value(l_linestatus order by l_partkey, l_suppkey, l_quantity) l_linestatus, any_value(l_suppkey order by l_partkey, l_suppkey, l_quantity) l_suppkey from lineitem group by 1, 2) on l_orderkey = id), a as (select check_id, any_value(kind) kind, count(distinct g) gs, count(distinct later) ts, count(distinct case when ln <= 3 then u end) us from l group by 1) select check_id, 'inputs_differ_in_group' error from a where kind not in ('effect_size') and gs > 1 union all select check_id, 'inputs_differ_in_timepoint' from a where ts > 1 union all select check_id, 'units_differ' from a where kind = 'ci_consistency' and us > 1")
def context_checks(spark, d):
    """An order is a check, its line items the inputs: return flags are groups, line states units, some suppliers later times."""
    kinds = ("t_p", "effect_size", "ci_consistency", "percentage")
    # of lines of one number the first counts
    one = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")).alias("x")
    items = table(spark, d, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(one).select("l_orderkey", "l_linenumber", "x.l_returnflag", "x.l_linestatus", F.col("x.l_suppkey").alias("l_supp"))
    args = F.array(*[F.lit(x) for x in ("estimate", "lower", "upper", "level", "a4", "a5", "a6")])
    context = F.struct(F.lit("d").alias("dataset"), F.col("l_returnflag").alias("group"), F.when(F.col("l_supp") % 3 == 0, "later").otherwise("base").alias("timepoint"), F.lit("all").alias("analysis_set"), F.lit("c").alias("condition"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("check_id"), F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("kind"))
    inputs = o.join(items, F.col("check_id") == F.col("l_orderkey")).select("check_id", "kind", F.element_at(args, F.col("l_linenumber").cast("int")).alias("argument"), F.lit("extracted").alias("status"), F.lit("number").alias("type"), F.lit("x").alias("name"), F.col("l_linestatus").alias("unit"), context.alias("context"))
    return O.context_errors(inputs)


@query("comparable_fields", "select l_orderkey id, l_linenumber ln, l_partkey part, l_suppkey supp, l_quantity qty, l_returnflag <> 'N' and l_linestatus = 'F' ok from lineitem")
def comparable_fields(spark, d):
    """A returned line's context is known, an open one has no unit."""
    unit = F.when(F.col("l_linestatus") == "F", "ms").otherwise(" N/A ")
    context = F.struct(F.lit("d").alias("dataset"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("group"), F.lit("t").alias("timepoint"), F.lit("all").alias("analysis_set"), F.lit("c").alias("condition"))
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"), unit.alias("unit"), context.alias("context"))
    return i.select("id", "ln", "part", "supp", "qty", O.directly_comparable(F.col("unit"), F.col("context")).alias("ok"))


@query("open_access", "with w as (select o_orderkey k, case when o_orderkey % 9 = 0 then 'arxiv' when o_orderkey % 17 = 0 then 'pmid' else 'doi' end t from orders), a as (select l_orderkey k, ['unpaywall', 'openalex', 'semantic_scholar', 'europe_pmc'][(l_linenumber % 4 + 1)::int] s, l_linenumber % 4 r, l_returnflag <> 'R' same, case when l_linestatus = 'F' then 'https://h/' || l_partkey end u from lineitem), b as (select k, bool_or(same) same, arg_min(u, (r, u)) filter (same and u is not null) u, arg_min(s, (r, u)) filter (same and u is not null) s from a group by 1) select k \"key\", case when t = 'arxiv' then 'ok' when t <> 'doi' then 'unsupported' when coalesce(same, true) then 'ok' else 'failed' end status, case when t = 'arxiv' then 'arxiv-direct' when t = 'doi' and u is not null then case s when 'unpaywall' then 'unpaywall-live' else replace(s, '_', '-') || '-fallback' end else 'none' end \"mode\", case when t = 'arxiv' then true when t = 'doi' then u is not null else false end is_oa, case when t = 'arxiv' then 'https://arxiv.org/pdf/2101.' || k || '.pdf' when t = 'doi' then u end url from w left join b using (k)")
def open_access(spark, d):
    """Orders are wanted works, their line items the providers' answers, some of other works and some without an address."""
    k = F.col("o_orderkey")
    kind = F.when(k % 9 == 0, "arxiv").when(k % 17 == 0, "pmid").otherwise("doi")
    wanted = table(spark, d, "orders").select(k.alias("key"), kind.alias("type"), F.when(kind == "arxiv", F.concat(F.lit("2101."), k.cast("string"))).otherwise(F.concat(F.lit("10.1234/X"), k.cast("string"))).alias("value"))
    source = F.element_at(F.array(*[F.lit(s) for s in O.OA_SOURCES]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    doi = F.concat(F.when(F.col("l_returnflag") != "R", "https://doi.org/10.1234/x").otherwise("10.9999/x"), F.col("l_orderkey").cast("string"))
    answers = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), source.alias("source"), doi.alias("doi"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("https://h/"), F.col("l_partkey").cast("string"))).alias("url"))
    return O.resolve_open_access(wanted, answers)


@query("provider_locations", "select p_partkey \"key\", 'repository' kind, 'https://r/' || p_partkey || '.pdf' url, true pdf from part where p_size % 2 = 0 union all select p_partkey, 'other', 'https://r/' || p_partkey, false from part where p_size % 2 = 1 union all select p_partkey, 'best', 'http://b/' || p_size, false from part where p_size > 10 union all select p_partkey, 'link', 'https://l/x.PDF', true from part where p_size > 25")
def provider_locations(spark, d):
    """Parts as OpenAlex records: size decides which places are open."""
    k, n = F.col("p_partkey"), F.col("p_size")
    place = lambda is_oa, pdf, page, type_: F.struct(is_oa.alias("is_oa"), pdf.alias("pdf_url"), page.alias("landing_page_url"), F.struct(F.lit(type_).alias("type")).alias("source"))
    pdf = F.concat(F.lit("https://r/"), k.cast("string"), F.lit(".pdf"))
    first = place(F.lit(True), F.when(n % 2 == 0, pdf), F.concat(F.lit("https://r/"), k.cast("string")), "repository")
    closed = place(F.lit(False), pdf, pdf, "repository")
    best = F.when(n > 10, place(F.when(n % 3 == 0, True), F.lit("ftp://no"), F.concat(F.lit("http://b/"), n.cast("string")), "journal"))
    record = F.struct(F.array(first, closed).alias("locations"), best.alias("best_oa_location"), F.struct((n > 10).alias("is_oa"), F.when(n > 25, " https://l/x.PDF ").alias("oa_url")).alias("open_access"))
    return O.openalex_locations(table(spark, d, "part").select(k.alias("key"), F.to_json(record).alias("work")))


@query("identity_links", "with l as (select o_custkey a, o_orderkey % 100 b, ['cites', 'correction', 'likes'][(year(o_orderdate) % 3 + 1)::int] kind, o_orderstatus s from orders), k as (select *, 'w' || a fa, 'w' || b fb from l where s <> 'P' and a <> b and kind <> 'likes') select fa holder, case kind when 'cites' then 'relations' else 'lineage' end holds, fa from_object, fb to_object, kind, count(*) n from k group by all union all select fb, 'lineage', fa, fb, kind, count(*) from k where kind = 'correction' group by all")
def identity_links(spark, d):
    """Orders link customers to numbers: pending ones have no evidence, and one kind of link is not known."""
    from attesta.operators import identity as I

    kind = F.element_at(F.array(F.lit("cites"), F.lit("correction"), F.lit("likes")), (F.year("o_orderdate") % 3 + 1).cast("int"))
    name = lambda c: F.concat(F.lit("w"), c.cast("string"))
    links = table(spark, d, "orders").select(name(F.col("o_custkey")).alias("a"), name(F.col("o_orderkey") % 100).alias("b"), kind.alias("kind"), F.lit("s").alias("source"), F.lit("t").alias("queried_at"), F.array(F.lit("doi")).alias("match_fields"), F.array().cast("array<string>").alias("conflict_fields"), F.when(F.col("o_orderstatus") != "P", F.lit(True)).alias("human_confirmed"))
    return I.edges_of(links).groupBy("holder", "holds", "from_object", "to_object", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("work_objects", "with p as (select *, array_to_string(list_slice(string_split(array_to_string(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), ' '), ' '), 1, 6), '-') slug from part) select 'ro:work:' || case when p_size % 3 = 0 then '10.1234/' || p_partkey when slug <> '' then slug else 'untitled' end object_id, (p_size % 3 = 0)::int + (p_size % 5 = 0)::int n_identifiers, count(*) n from p group by 1, 2")
def work_objects(spark, d):
    from attesta.operators import identity as I

    k, n = F.col("p_partkey").cast("string"), F.col("p_size")
    works = table(spark, d, "part").select(F.when(n % 3 == 0, F.concat(F.lit(" DOI.org/10.1234/"), k)).alias("doi"), F.when(n % 5 == 0, F.concat(F.lit("arXiv:2101."), k, F.lit("v3"))).alias("arxiv"), F.col("p_name").alias("title"), F.array(F.lit("a")).alias("authors"), F.lit(2000).alias("year"), F.lit(None).cast("string").alias("container"))
    return I.objects(works).groupBy("object_id", F.size("identifiers").alias("n_identifiers")).agg(F.count(F.lit(1)).alias("n"))


@query("receipt_questions", "with c as (select l_orderkey k, l_returnflag r, l_linenumber n from lineitem), v as (select o_orderkey k, o_orderstatus <> 'P' known from orders) select kind, needs_human, count(*) n from (select 'unsupported_schema_version' kind, true needs_human from v where not known union all select case r when 'A' then 'contradicted_claim' when 'R' then 'unverifiable_claim' end, r = 'A' from c join v using (k) where known and r <> 'N' union all select 'query_failure', false from v where known) group by all")
def receipt_questions(spark, d):
    """Orders as receipts: line items are claims, pending orders receipts of another version."""
    from attesta.operators import identity as I

    status = F.when(F.col("l_returnflag") == "A", "contradicted").when(F.col("l_returnflag") == "R", "unverifiable").otherwise("supported")
    claims = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("c").alias("claim"), status.alias("support_status"))).alias("claims"))
    r = table(spark, d, "orders").join(claims, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    doc = F.to_json(F.struct(F.when(F.col("o_orderstatus") == "P", "2.0").otherwise("1.0").alias("schema_version"), "claims", F.array(F.lit("timeout")).alias("failures")))
    return I.open_questions(r.select(F.col("o_orderkey").alias("key"), doc.alias("receipt"))).groupBy("kind", "needs_human").agg(F.count(F.lit(1)).alias("n"))


@query("provider_target_comparison", "with r as (select o_custkey k, o_orderkey p, o_orderstatus s from orders), t as (select c_custkey k, case when c_custkey % 3 > 0 then 'F' end w from customer), f as (select k, min(s) l from r group by 1) select r.k \"key\", 'title' field, count(*) known, count(*) filter (lower(s) = lower(coalesce(w, l))) agree, array_to_string(list_sort(coalesce(list_distinct(list(p::varchar) filter (lower(s) <> lower(coalesce(w, l)))), [])), '|') conflicts from r join f on f.k = r.k left join t on t.k = r.k group by r.k")
def provider_target_comparison(spark, d):
    """A customer is a work, its orders the providers and their status the title; two customers in three have a target."""
    from attesta.operators import identity as I

    works = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").cast("string").alias("provider"), F.col("o_orderstatus").alias("title"))
    target = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 > 0, "f").alias("title"))
    return I.compare_works(works, target, ("title",)).withColumn("conflicts", F.array_join("conflicts", "|"))
