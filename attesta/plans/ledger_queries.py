"""Exports, imports, exact pooling and recomputed results over parts, events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import corpus, ledger
from attesta.plans.registry import query
from attesta.plans.statistics_queries import _ST, r6, studies
from attesta.store import table


@query("claim_graph_export", "with e as (select l_partkey claim, l_orderkey a, l_linenumber l, case when l_tax > 0.06 then 'contradicts' when l_tax > 0.03 then 'supports' else 'qualifies' end st, 'ev-' || left(sha256(l_partkey || chr(31) || l_orderkey || chr(31) || l_linenumber), 16) id from lineitem), g as (select claim, array_to_string(list_sort(list_distinct(list(id) filter (st = 'supports'))), ',') s, array_to_string(list_sort(list_distinct(list(id) filter (st = 'contradicts'))), ',') c, count(*) filter (st = 'qualifies') u from e group by 1) select p_partkey claim, p_brand status, coalesce(s, '') supported_by, coalesce(c, '') contradicted_by, coalesce(u, 0) uncertain from part left join g on claim = p_partkey")
def claim_graph_export(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("claim"), F.col("l_orderkey").alias("artifact"), F.col("l_linenumber").alias("locator"), F.when(F.col("l_tax") > 0.06, "contradicts").when(F.col("l_tax") > 0.03, "supports").otherwise("qualifies").alias("stance"))
    return ledger.export_graph(table(spark, d, "part").select(F.col("p_partkey").alias("claim"), F.col("p_brand").alias("status")), e)


@query("decision_ledger_export", "with e as (select *, lag(event_type) over (partition by user_id order by event_id) f from events), s as (select user_id, arg_min(event_type, event_id) first_state, arg_max(event_type, event_id) last_state, count(*) events, count(*) filter (f <> event_type) changes from e group by 1), c as (select user_id, arg_max(event_type, event_id) v from events where value > 95 group by 1) select user_id, first_state, last_state, events, changes, coalesce(v, last_state) verdict from s left join c using (user_id)")
def decision_ledger_export(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return ledger.export_ledger(e, e.where("value > 95").select("user_id", F.col("event_type").alias("verdict"), F.col("event_id").alias("seq")), "user_id", "event_id", "event_type")


@query("legacy_watch_import", "select 'w' || c_custkey watcher, '10.1234/x' || c_custkey item_key, case when c_custkey % 2 = 0 then 'retracted' else 'not_retracted' end status from customer where c_custkey % 5 > 0")
def legacy_watch_import(spark, d):
    k = F.col("c_custkey").cast("string")
    flag = F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false")
    other = F.when(F.col("c_custkey") % 5 == 0, F.when(F.col("c_custkey") % 2 == 0, "false").otherwise("true")).otherwise(flag)
    j = F.concat(F.lit('{"10.1234/x'), k, F.lit('": '), flag, F.lit(', "https://doi.org/10.1234/X'), k, F.lit('": '), other, F.lit("}"))
    return ledger.legacy_watch(table(spark, d, "customer").select(F.concat(F.lit("w"), k).alias("watcher"), j.alias("json")))


@query("watch_keys", "select doc_id, case doc_id % 3 when 0 then '10.1234/x' || doc_id when 1 then 'id' || doc_id else 'some title ' || doc_id end \"key\" from documents")
def watch_keys(spark, d):
    k = F.col("doc_id").cast("string")
    key = corpus.watch_key(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doi:10.1234/X"), k)), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" id"), k)), F.concat(F.lit("Some: Title "), k))
    return table(spark, d, "documents").select("doc_id", key.alias("key"))


@query("pool_exact", f"with {_ST}, m as (select analysis, count(*) k, sum(yi / vi) / sum(1 / vi) e from st group by 1) select m.analysis, any_value(k) k, round(any_value(e), 6) estimate, round(sum((yi - e) ** 2 / vi), 6) q from st join m using (analysis) group by 1")
def pool_exact(spark, d):
    return ledger.pool_exact(studies(spark, d), ["analysis"]).select("analysis", "k", r6("estimate").alias("estimate"), r6("q").alias("q"))


@query("result_checks", "select o_orderkey id, case o_orderkey % 3 when 0 then 'chi2' when 1 then 't' else 'other' end kind, case o_orderkey % 3 when 0 then round(exp(-(o_custkey % 9) / 2.0), 6) when 1 then round(1 - (o_custkey % 9) / sqrt(2 + (o_custkey % 9) ** 2), 6) end p, case o_orderkey % 3 when 0 then exp(-(o_custkey % 9) / 2.0) < 0.05 when 1 then 1 - (o_custkey % 9) / sqrt(2 + (o_custkey % 9) ** 2) < 0.05 end consistent, case when o_orderkey % 3 = 2 then 'unsupported kind' end error from orders")
def result_checks(spark, d):
    k = F.col("o_orderkey") % 3
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, "chi2").when(k == 1, "t").otherwise("other").alias("kind"), (F.col("o_custkey") % 9).cast("double").alias("stat"), F.lit(2.0).alias("df1"), F.lit(2.0).alias("df2"), F.lit("<").alias("relation"), F.lit("0.05").alias("printed"))
    return ledger.check_results(rows).withColumn("p", r6("p"))
