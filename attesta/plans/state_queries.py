"""Decision logs, claims, checklists and watch state over events, orders, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import state as S
from attesta.plans.registry import query
from attesta.store import table
from attesta.streaming import watch as N

ORDER = ["ts", "event_id"]
LEGAL = {(None, "view"), (None, "signup"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("purchase", "view"), ("signup", "view"), ("click", "view"), ("error", "view"), ("view", "error")}


def events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("decision_last_state", "select user_id, arg_max(event_type, (ts, event_id)) state, count(*) events from events group by 1")
def decision_last_state(spark, d):
    return S.last_state(events(spark, d), "user_id", ORDER, "event_type")


@query("previous_state", "select event_id, lag(event_type) over (partition by user_id order by ts, event_id) from_state from events")
def previous_state(spark, d):
    return S.with_previous(events(spark, d), "user_id", ORDER, "event_type").select("event_id", "from_state")


@query("illegal_transitions", "with p as (select *, lag(event_type) over (partition by user_id order by ts, event_id) f from events) select event_id, f from_state, event_type to_state from p where not (" + " or ".join(f"(f is not distinct from {'null' if a is None else repr(a)} and event_type = {b!r})" for a, b in sorted(LEGAL, key=str)) + ")")
def illegal_transitions(spark, d):
    return S.illegal_transitions(events(spark, d), "user_id", ORDER, "event_type", LEGAL).select("event_id", "from_state", F.col("event_type").alias("to_state"))


@query("seq_gaps", "with p as (select event_id, floor(value * 10)::bigint seq, max(floor(value * 10)::bigint) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) highest_before from events) select * from p where seq <= highest_before")
def seq_gaps(spark, d):
    e = events(spark, d).withColumn("seq", F.floor(F.col("value") * 10))
    return S.sequence_faults(e, "user_id", "event_id", "seq").select("event_id", "seq", "highest_before")


@query("effective_verdicts", "with c as (select o_custkey k, arg_max(o_orderstatus, o_orderkey) v, count(*) n from orders where o_totalprice > 200000 group by 1) select c_custkey k, coalesce(v, c_mktsegment) verdict, coalesce(n, 0) corrections from customer left join c on k = c_custkey")
def effective_verdicts(spark, d):
    c = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderkey").alias("seq"))
    return S.effective_verdict(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("verdict")), c, "k")


STANCE = {"purchase": "supports", "signup": "supports", "error": "contradicts"}


@query("claim_status", "with e as (select user_id % 400 claim, case when event_type in ('purchase', 'signup') and value > 40 then 'supports' when event_type = 'error' and value > 60 then 'contradicts' else 'qualifies' end st from events) select claim, case when bool_or(st = 'supports') and bool_or(st = 'contradicts') then 'contested' when bool_or(st = 'contradicts') then 'refuted' when bool_or(st = 'supports') then 'supported' else 'unresolved' end status, count(*) items from e group by 1")
def claim_status(spark, d):
    st = F.when(F.col("event_type").isin("purchase", "signup") & (F.col("value") > 40), "supports").when((F.col("event_type") == "error") & (F.col("value") > 60), "contradicts").otherwise("qualifies")
    return S.claim_status(events(spark, d).select((F.col("user_id") % 400).alias("claim"), st.alias("stance")), ["claim"])


@query("claim_demotion", "with c as (select p_partkey claim, case when p_size > 25 then 'supported' else 'unresolved' end status from part), h as (select a.claim src, b.claim dst from c a join c b on b.claim = a.claim * 2 and a.status = 'supported' and b.status = 'supported') select claim, case when claim in (select src from h union select dst from h) then 'contested' else status end status from c")
def claim_demotion(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("claim"), F.when(F.col("p_size") > 25, "supported").otherwise("unresolved").alias("status"))
    e = c.select(F.col("claim").alias("src"), (F.col("claim") * 2).alias("dst"), F.lit("contradicts").alias("relation"))
    return S.demoted(c, e)


@query("settled_claims", "with v as (select p_partkey claim, case p_size % 4 when 0 then 'supported' when 1 then 'contested' when 2 then null else 'refuted' end e, case p_size % 3 when 0 then 'supported' when 1 then 'unresolved' else 'refuted' end dv, p_size % 3 = 2 c from part) select claim, case when c then dv when e = 'supported' and dv <> 'supported' then 'unresolved' else coalesce(e, dv) end status from v")
def settled_claims(spark, d):
    p = F.col("p_size")
    e = F.when(p % 4 == 0, "supported").when(p % 4 == 1, "contested").when(p % 4 == 3, "refuted")
    dv = F.when(p % 3 == 0, "supported").when(p % 3 == 1, "unresolved").otherwise("refuted")
    return table(spark, d, "part").select(F.col("p_partkey").alias("claim"), S.settled_status(e, dv, p % 3 == 2).alias("status"))


@query("claim_anchors", "with e as (select l_partkey claim, case when l_tax > 0.07 then 'contradicts' when l_tax > 0.02 then 'supports' else 'qualifies' end st, l_discount < 0.09 r from lineitem) select claim, case when count(*) filter (st = 'contradicts') > 0 then 'conflicted' when count(*) filter (st = 'supports') > 0 and count(*) filter (not r) = 0 then 'eligible' else 'unsupported' end anchor from e group by 1")
def claim_anchors(spark, d):
    li = table(spark, d, "lineitem")
    st = F.when(F.col("l_tax") > 0.07, "contradicts").when(F.col("l_tax") > 0.02, "supports").otherwise("qualifies")
    return S.anchor_status(li.select(F.col("l_partkey").alias("claim"), st.alias("stance"), (F.col("l_discount") < 0.09).alias("resolved")), li.where("l_partkey is null"))


@query("dangling_edges", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size > 10)")
def dangling_edges(spark, d):
    return S.dangling(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", table(spark, d, "part").where("p_size > 10"), "p_partkey")


@query("duplicate_keys", "select md5(text) \"key\", count(*) n from documents group by 1 having count(*) > 1")
def duplicate_keys(spark, d):
    return S.duplicates(table(spark, d, "documents").select(F.md5("text").alias("key")), "key")


@query("rule_violations", "select 'works' \"table\", 'blank_title' \"rule\", doc_id::varchar \"key\" from documents where doc_id % 9 = 0 union all select 'artifacts', 'bad_digest', doc_id::varchar from documents where doc_id % 11 = 0 union all select 'lineage', 'self_loop', l_orderkey::varchar from lineitem where l_orderkey = l_partkey union all select 'evidence', 'bad_stance', event_id::varchar from events where event_type = 'view'")
def rule_violations(spark, d):
    docs = table(spark, d, "documents")
    works = docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, " ").otherwise("t").alias("title"))
    artifacts = docs.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "nope").otherwise(F.sha2("text", 256)).alias("sha256"))
    lineage = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("child"), F.col("l_partkey").alias("parent"), F.lit("used").alias("relation"))
    evidence = events(spark, d).select("event_id", F.when(F.col("event_type") == "view", "maybe").otherwise("supports").alias("stance"))
    return S.violations({"works": works, "artifacts": artifacts, "lineage": lineage, "evidence": evidence})


@query("artifact_admission", "with b as (select doc_id a, case when doc_id % 13 = 0 then 'bad' else sha256(text) end dg, doc_id % 5 = 0 old, doc_id % 15 = 0 clash from documents) select a artifact_id, case when dg = 'bad' or clash then 'rejected' when old then 'replayed' else 'accepted' end status, case when dg = 'bad' then 'bad_digest' when clash then 'collision' end error from b")
def artifact_admission(spark, d):
    docs = table(spark, d, "documents")
    b = docs.select(F.col("doc_id").alias("artifact_id"), F.when(F.col("doc_id") % 13 == 0, "bad").otherwise(F.sha2("text", 256)).alias("digest"))
    s = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("artifact_id"), F.when(F.col("doc_id") % 15 == 0, F.lit("0" * 64)).when(F.col("doc_id") % 13 == 0, "bad").otherwise(F.sha2("text", 256)).alias("digest"))
    return S.admission(b, s)


@query("batch_ingest", "select doc_id artifact_id from documents where doc_id % 7 > 0")
def batch_ingest(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("artifact_id"), F.sha2("text", 256).alias("digest"))
    return S.ingest(docs, docs.where("artifact_id % 7 = 0")).select("artifact_id")


@query("snapshot_digest", "with h as (select sha256(concat_ws(chr(31), c_acctbal_, c_custkey::varchar, c_mktsegment, c_name, c_nationkey::varchar)) h from (select *, 'x' c_acctbal_ from customer)), n as (select case when count(*) <= 256 * 4096 then 3 when count(*) <= 256 * 65536 then 4 else 5 end dep from h), l as (select left(h, dep) g, sha256(string_agg(h, '' order by h)) d, count(*) c from h, n group by 1), l4 as (select case when length(g) = 5 then left(g, 4) else g end g, case when length(any_value(g)) = 5 then sha256(string_agg(d, '' order by g)) else any_value(d) end d, sum(c) c from l group by case when length(g) = 5 then left(g, 4) else g end), l3 as (select left(g, 3) g, case when length(any_value(g)) = 4 then sha256(string_agg(d, '' order by g)) else any_value(d) end d, sum(c) c from l4 group by left(g, 3)), l2 as (select left(g, 2) k, sha256(string_agg(d, '' order by g)) d, sum(c) c from l3 group by 1), l1 as (select left(k, 1) g, sha256(string_agg(d, '' order by k)) d, sum(c) c from l2 group by 1) select sum(c)::bigint \"rows\", sha256(string_agg(d, '' order by g)) digest from l1")
def snapshot_digest(spark, d):
    return S.table_digest(table(spark, d, "customer").select(F.lit("x").alias("c_acctbal"), "c_custkey", "c_mktsegment", "c_name", "c_nationkey"))


@query("receipt_stances", "with v as (select l_orderkey k, count(*) t, count(*) filter (l_returnflag <> 'R') p, count(*) filter (l_returnflag = 'A' and l_linenumber = 1) n from lineitem group by 1) select k, case when n > 0 then 'contradicts' when p = t then 'supports' else 'qualifies' end stance from v")
def receipt_stances(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("t"), F.count_if(F.col("l_returnflag") != "R").alias("p"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)).alias("n"))
    return v.select("k", S.stance_of(F.lit("audit"), F.col("p"), F.col("n"), F.col("t")).alias("stance"))


_STAGES = ", ".join(f"('{s}', {i}, {str(s in S.HARD).lower()}, {str(s in S.WAIVABLE).lower()})" for i, s in enumerate(S.STAGES))
_CHECKED = f"st(stage, i, hard, soft) as (values {_STAGES}), p as (select p_partkey paper, stage, hard, soft, i, case when p_size % 15 <= i - 10 then 'unknown' when hash_ % 19 = 0 then 'mismatch' when hash_ % 13 = 0 then 'fail' when hash_ % 17 = 0 then 'skipped' when hash_ % 29 = 0 then 'blocked' else 'pass' end status, hash_ % 2 = 0 w from (select *, p_partkey * 31 + i * 7 hash_ from part, st))"


@query("checklist_verdict", f"with {_CHECKED}, a as (select paper, " + ", ".join(f"any_value(status) filter (stage = '{s}') \"{s}\"" for s in S.STAGES) + ", count(*) filter (status = 'mismatch') mm, count(*) filter (hard and status <> 'pass') bl, count(*) filter (not hard and status <> 'pass' and not (soft and status = 'skipped' and w)) gaps from p group by 1) select paper, case when mm > 0 then 'inconsistent' when bl > 0 then 'blocked' when gaps = 0 then 'reproducible' else 'partially-reproducible' end verdict, case when identity in ('fail', 'missing', 'blocked', 'mismatch') then null when \"code-link\" in ('fail', 'missing', 'blocked', 'mismatch') or \"repo-identity\" in ('fail', 'missing', 'blocked', 'mismatch') then 'no-code-found' when list_has_any([\"code-link\", \"repo-identity\", identity], ['skipped', 'unknown']) then null when dependencies in ('fail', 'missing', 'blocked') then 'environment-broken' when dependencies in ('skipped', 'unknown') then null when \"build-install\" in ('fail', 'missing', 'blocked') then 'environment-broken' when \"build-install\" in ('skipped', 'unknown') then null when \"smoke-run\" in ('fail', 'missing', 'blocked') then 'environment-broken' when \"smoke-run\" in ('skipped', 'unknown') then null when \"claimed-metrics\" <> 'pass' or \"measured-metrics\" <> 'pass' then 'runs' when \"metric-diff\" = 'pass' then 'numbers-reproduced' when \"metric-diff\" = 'fail' then 'direction-reproduced' else 'runs' end tier, mm::int contradictions, bl::int blocking, gaps::int gaps from a")
def checklist_verdict(spark, d):
    """Parts as papers; records of the last stages are missing where the size says so."""
    stages = spark.createDataFrame([(s, i) for i, s in enumerate(S.STAGES)], "stage string, i int")
    h = F.col("p_partkey") * 31 + F.col("i") * 7
    status = F.when(h % 19 == 0, "mismatch").when(h % 13 == 0, "fail").when(h % 17 == 0, "skipped").when(h % 29 == 0, "blocked").otherwise("pass")
    rows = table(spark, d, "part").crossJoin(F.broadcast(stages)).where("p_size % 15 > i - 10").select(F.col("p_partkey").alias("paper"), "stage", status.alias("status"), (h % 2 == 0).alias("waived"))  # fourteen rows a paper
    return S.checklist(rows).select("paper", "verdict", "tier", *[F.size(c).alias(c) for c in ("contradictions", "blocking", "gaps")])


@query("checklist_errors", f"with {_CHECKED}, e as (select paper, stage, status, w, p_size % 3 = 0 reasoned from p join part on p_partkey = paper) select paper, stage, 'waived_not_skipped' error from e where w and status <> 'skipped' union all select paper, stage, 'stage_not_waivable' from e where w and stage not in ({', '.join(repr(s) for s in S.WAIVABLE)}) union all select paper, stage, 'waived_without_reason' from e where w and not reasoned union all select p_partkey, 'magic', 'unknown_stage' from part where p_size = 7 union all select p_partkey, 'identity', 'duplicate_stage' from part where p_size = 9 union all select p_partkey, 'identity', 'invalid_status' from part where p_size = 9")
def checklist_errors(spark, d):
    stages = spark.createDataFrame([(s, i) for i, s in enumerate(S.STAGES)], "stage string, i int")
    h = F.col("p_partkey") * 31 + F.col("i") * 7
    status = F.when(F.col("p_size") % 15 <= F.col("i") - 10, "unknown").when(h % 19 == 0, "mismatch").when(h % 13 == 0, "fail").when(h % 17 == 0, "skipped").when(h % 29 == 0, "blocked").otherwise("pass")
    part = table(spark, d, "part")
    rows = part.crossJoin(F.broadcast(stages)).select(F.col("p_partkey").alias("paper"), "stage", status.alias("status"), (h % 2 == 0).alias("waived"), F.when(F.col("p_size") % 3 == 0, "no weights").otherwise(" ").alias("reason"))  # fourteen rows a paper
    none = F.lit(None).cast("string")
    more = part.where("p_size = 7").select(F.col("p_partkey").alias("paper"), F.lit("magic").alias("stage"), F.lit("pass").alias("status"), F.lit(False).alias("waived"), none.alias("reason"))
    again = part.where("p_size = 9").select(F.col("p_partkey").alias("paper"), F.lit("identity").alias("stage"), F.lit("fine").alias("status"), F.lit(False).alias("waived"), none.alias("reason"))
    return S.checklist_errors(rows.unionByName(more).unionByName(again))


# watch state


def observations(spark, d):
    status = F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type") == "purchase", "retracted").otherwise("not_retracted")
    return events(spark, d).select(F.lit("retraction").alias("watcher"), F.col("user_id").cast("string").alias("item_key"), F.col("event_id").alias("seq"), F.col("event_id").alias("arrival"), status.alias("status"), F.array().cast("array<string>").alias("signals"), F.lit(True).alias("signals_complete"), F.lit(False).alias("truncated"), F.lit(None).cast("string").alias("error"))


_OBS = "o as (select user_id::varchar item_key, event_id seq, case event_type when 'error' then 'unknown' when 'purchase' then 'retracted' else 'not_retracted' end status from events)"


@query("watch_final_state", f"with {_OBS}, k as (select *, lag(status) over (partition by item_key order by seq) p from o where status <> 'unknown') select a.item_key, arg_max(a.status, a.seq) current_status, any_value(c) confirmed, max(a.seq) applied, any_value(v) \"version\" from o a left join (select item_key, arg_max(status, seq) c, count(*) filter (p is distinct from status) v from k group by 1) b on a.item_key = b.item_key group by 1")
def watch_final_state(spark, d):
    return N.fold(observations(spark, d)).select("item_key", "current_status", "confirmed", "applied", "version")


@query("watch_late_replay", f"with {_OBS} select item_key, max(seq) applied, 0::bigint conflicts, count(*) replays from o group by 1")
def watch_late_replay(spark, d):
    o = observations(spark, d)
    again = o.withColumn("arrival", F.col("arrival") + 10_000_000)
    return N.fold(o.unionByName(again)).select("item_key", "applied", "conflicts", "replays")


@query("watch_reserved", "select event_id, coalesce(user_id % 3, 0) + row_number() over (partition by user_id order by event_id) seq from events")
def watch_reserved(spark, d):
    o = observations(spark, d).drop("seq")
    last = o.groupBy("watcher", "item_key").agg((F.first("item_key").cast("long") % 3).alias("reserved"))
    return N.reserve(o, last).select(F.col("arrival").alias("event_id"), "seq")


@query("watch_outbox", "select user_id::varchar item_key, event_id \"version\" from events where event_type = 'purchase' and event_id > user_id * 2")
def watch_outbox(spark, d):
    o = observations(spark, d).select("watcher", "item_key", (F.col("status") == "retracted").alias("changed"), F.col("seq").alias("version"))
    acked = o.select("watcher", "item_key", (F.col("item_key").cast("long") * 2).alias("version")).distinct()
    return N.unacknowledged(o, acked).select("item_key", "version")


@query("new_items_first_seen", "select user_id::varchar item_key from events group by 1")
def new_items(spark, d):
    return N.first_seen_stream(observations(spark, d)).select("item_key")


@query("retraction_status", "with s as (select user_id item, bool_or(event_type = 'purchase' and value > 90) f, bool_or(event_type = 'error' and value > 95) n, bool_and(value > 1) c from events group by 1) select item, case when f or n then 'retracted' when not f and c then 'not_retracted' else 'unknown' end status, not c partial_coverage from s")
def retraction_status(spark, d):
    t, v = F.col("event_type"), F.col("value")
    return N.retraction_status(events(spark, d).select(F.col("user_id").alias("item"), ((t == "purchase") & (v > 90)).alias("flag"), ((t == "error") & (v > 95)).alias("notice"), (v > 1).alias("complete")))


_UPDATES = ("Retraction", "withdrawal", "Removal", "expression_of_concern", "Expression-of-Concern", "erratum", "partial_retraction", "correction", "new_version")


@query("update_signals", "with u as (select event_id notice, user_id doi, lower([" + ", ".join(f"'{u}'" for u in _UPDATES) + "][(event_id % 9 + 1)::int]) t from events) select doi, array_to_string(list_sort(list_distinct(list(t || ':' || notice))), '|') signals, count(*) n from u where t in ('retraction', 'withdrawal', 'removal', 'expression_of_concern', 'expression-of-concern') group by 1")
def update_signals(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("notice"), F.col("user_id").alias("doi"), F.element_at(F.array(*[F.lit(u) for u in _UPDATES]), (F.col("event_id") % 9 + 1).cast("int")).alias("update_type"))
    return N.update_signals(e)


@query("signal_counts", "select event_type signal, count(*) n from events group by 1")
def signal_counts(spark, d):
    return events(spark, d).groupBy(F.col("event_type").alias("signal")).agg(F.count("*").alias("n"))
