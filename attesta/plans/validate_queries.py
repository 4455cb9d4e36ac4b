"""Lineage, ledgers and claim graphs made of orders and line items, checked rule by rule; manuscripts and their lint."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import lint, validate
from attesta.plans.registry import query
from attesta.store import table, written

# a customer's orders, each derived from the one before it, through an activity where it is finished

_CHAIN = "o as (select o_custkey \"doc\", o_orderkey k, o_orderstatus s, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) p, max(o_orderkey) over (partition by o_custkey) last, min(o_orderkey) over (partition by o_custkey) first_, o_totalprice v from orders)"


def chain(spark, d):
    """edges as inline_edges gives them, nodes and targets of every customer.

    Customers whose number is divisible by 11 close a cycle, those by 7 name something undeclared, those by 13 ask for
    what is not there.
    """
    w = Window.partitionBy("doc").orderBy("k")
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("doc"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    o = o.withColumn("p", F.lag("k").over(w))
    ends = o.groupBy("doc").agg(F.max("k").alias("last"), F.min("k").alias("first"))
    e = lambda c: F.concat(F.lit("e"), F.col(c).cast("string"))
    act = F.concat(F.lit("a"), F.col("k").cast("string"))
    none = F.lit(None).cast("string")
    row = lambda df, child, parent: df.select("doc", F.col("k").alias("n"), child.alias("child"), parent.alias("parent"), none.alias("activity"), none.alias("error"))
    linked = o.where("p is not null")
    edges = row(linked.where("s <> 'F'"), e("k"), e("p")).unionByName(row(linked.where("s = 'F'"), e("k"), act)).unionByName(row(linked.where("s = 'F'"), act, e("p")))
    cycles = ends.where("cast(doc as int) % 11 = 0 and first <> last").withColumn("k", F.col("last"))
    edges = edges.unionByName(row(cycles, e("first"), e("last")))
    loose = ends.where("cast(doc as int) % 7 = 0").withColumn("k", F.col("last"))
    edges = edges.unionByName(row(loose, e("first"), F.lit("nowhere")))
    nodes = o.select("doc", e("k").alias("id"), F.lit("entity").alias("kind")).unionByName(linked.where("s = 'F'").select("doc", act.alias("id"), F.lit("activity").alias("kind")))
    targets = ends.select("doc", F.when(F.col("doc").cast("int") % 13 == 0, "gone").otherwise(e("last")).alias("id"))
    return edges, nodes, targets


@query("lineage_trace", f"with {_CHAIN}, c as (select \"doc\", count(*) n, count(*) filter (p is not null and s = 'F') acts, any_value(first_) f, any_value(last) l from o group by 1) select \"doc\"::varchar \"doc\", case when \"doc\" % 13 = 0 then 'missing_input' when \"doc\" % 11 = 0 and f <> l then 'cycle_detected' when \"doc\" % 7 = 0 then 'broken_chain' else 'valid_dag' end status, case when \"doc\" % 13 = 0 then 0 else n - 1 + acts + case when \"doc\" % 7 = 0 then 1 else 0 end end::int ancestors, case when \"doc\" % 13 = 0 or \"doc\" % 7 = 0 or (\"doc\" % 11 = 0 and f <> l) then '' else 'e' || f end roots, case when \"doc\" % 13 = 0 or \"doc\" % 7 = 0 or (\"doc\" % 11 = 0 and f <> l) then 0 else n + acts end::int chain_length from c")
def lineage_trace(spark, d):
    t = validate.trace(*chain(spark, d))
    return t.select("doc", "status", F.size("ancestors").alias("ancestors"), F.array_join("roots", "|").alias("roots"), "chain_length")


_ITEMS = "i as (select l_orderkey o, l_linenumber s, l_returnflag r, l_linestatus u, l_suppkey p, row_number() over (partition by o_custkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) n, o_custkey \"doc\" from lineitem join orders on o_orderkey = l_orderkey)"


def ledgers(spark, d):
    """A customer is a ledger, its orders decisions, their line items the events; orders rest on the one before them and on
    the number before theirs, which may be no order."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey"), "o_orderstatus", "o_orderpriority")
    key = lambda c: F.col(c).cast("string")
    kind = F.when(F.col("o_orderpriority") < "2", "negative_result").otherwise("decision")
    title = F.concat(F.lit(" Order  "), key("o_orderkey"))
    verdict = F.when(F.col("o_orderstatus") == "F", "positive").when(F.col("o_orderstatus") == "O", "negative").otherwise("maybe")
    digest = F.when(F.col("o_orderkey") % 5 == 0, F.lit("0" * 64)).otherwise(validate.decision_digest(key("o_orderkey"), kind, F.lit("explore"), title))
    decisions = o.select("doc", key("o_orderkey").alias("id"), title.alias("title"), F.when(F.col("o_orderkey") % 3 == 0, title).otherwise(T.nfc_compact(title)).alias("normalized_title"), kind.alias("entry_kind"), F.lit("explore").alias("action"), digest.alias("decision_digest"), F.lit(None).cast("string").alias("initial_verdict"), verdict.alias("verdict"), F.lit(None).cast("string").alias("artifact"))
    lag = F.lag("o_orderkey").over(Window.partitionBy("doc").orderBy("o_orderkey"))
    two = o.withColumn("before", lag).select("doc", "o_orderkey", F.explode(F.array("before", F.col("o_orderkey") - 1)).alias("basis")).where("basis is not null")
    bases = two.select("doc", F.concat_ws("-", key("o_orderkey"), key("basis")).alias("n"), key("o_orderkey").alias("decision"), key("basis").alias("basis"), (F.col("o_orderkey") % 2 == 0).alias("has_receipt"))
    forks = o.select("doc", key("o_orderkey").alias("n"), key("o_orderkey").alias("decision"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") - 1).cast("string").alias("alternative"))
    i = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("doc").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # numbered once, for events and corrections
    i = written(i.select("doc", F.row_number().over(order).alias("n"), "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_linestatus"), "ledger-items")
    state = F.when(F.col("l_returnflag") == "A", "active").when(F.col("l_returnflag") == "R", "reopened").otherwise("pruned")
    events = i.select("doc", "n", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence"), key("l_orderkey").alias("decision"), F.lit(None).cast("string").alias("from_state"), state.alias("to_state"), F.when(F.col("l_suppkey") % 10 == 0, "superseded").otherwise("other").alias("reason"), (F.col("l_orderkey") - 1).cast("string").alias("alternative"), F.lit(None).cast("string").alias("caused_by"), F.when(F.col("l_linestatus") == "F", "positive").otherwise("never").alias("verdict_override"))
    corrections = events.where("reason = 'other' and n % 50 = 0").select("doc", "n", "sequence", "decision", F.lit("negative").alias("verdict"))
    uncertain = decisions.where("entry_kind = 'negative_result' and cast(id as bigint) % 3 = 0").select("doc", F.lit("unsupported_negative_result").alias("kind"), F.col("id").alias("subject"))
    return decisions, bases, forks, events, corrections, uncertain


_LEDGER = f"""
with d as (select o_custkey "doc", o_orderkey id, o_orderpriority < '2' neg, o_orderstatus s from orders),
b0 as (select "doc", id, unnest([lag(id) over (partition by "doc" order by id), id - 1]) basis from d),
b as (select *, id % 2 = 0 rec from b0 where basis is not null),
bk as (select distinct b."doc", b.id, b.basis, b.rec, x.neg, y.neg bneg from b join d x on x."doc" = b."doc" and x.id = b.id join d y on y."doc" = b."doc" and y.id = b.basis),
{_ITEMS},
e as (select *, o * 10 + s seq, case r when 'A' then 'active' when 'R' then 'reopened' else 'pruned' end st, row_number() over (partition by "doc", o order by n) en, p % 10 = 0 sup from i),
e2 as (select *, lag(st) over (partition by "doc", o order by n) bf, max(seq) over (partition by "doc" order by n rows between unbounded preceding and 1 preceding) top from e),
lost as (select * from e2 where sup and ("doc", o - 1) not in (select "doc", id from d)),
c as (select "doc", o id, n, seq, max(seq) over (partition by "doc" order by n rows between unbounded preceding and 1 preceding) top from e2 where not sup and n % 50 = 0),
f(rule, "doc", subject) as (
select 'normalized_title', "doc", id::varchar from d where id % 3 = 0
union all select 'decision_digest', "doc", id::varchar from d where id % 5 = 0
union all select 'illegal_verdict', "doc", id::varchar from d where s = 'P'
union all select distinct 'basis_names_unknown_decision', "doc", id || '-' || basis from b where ("doc", basis) not in (select "doc", id from d)
union all select 'fork_on_itself', "doc", id::varchar from d where id % 4 = 0
union all select 'fork_names_unknown_decision', "doc", id::varchar from d where id % 4 > 0 and ("doc", id - 1) not in (select "doc", id from d)
union all select distinct 'negative_result_on_a_result', "doc", id::varchar from bk where neg and bneg
union all select 'negative_result_without_basis', "doc", id::varchar from d where neg and ("doc", id) not in (select "doc", id from bk where not bneg)
union all select 'negative_result_without_receipt', "doc", id::varchar from d where neg and id % 3 > 0 and ("doc", id) not in (select "doc", id from bk where not bneg and rec)
union all select 'event_sequence', "doc", n::varchar from e2 where seq <= top
union all select 'illegal_first_state', "doc", n::varchar from e2 where en = 1 and st = 'reopened'
union all select 'state_before_differs', "doc", n::varchar from e2 where en > 1
union all select 'illegal_transition', "doc", n::varchar from e2 where en > 1 and not ((bf = 'active' and st = 'pruned') or (bf = 'pruned' and st = 'reopened') or (bf = 'reopened' and st = 'pruned'))
union all select 'decision_without_first_event', "doc", id::varchar from d where ("doc", id) not in (select "doc", o from e)
union all select 'illegal_verdict_override', "doc", n::varchar from e2 where u <> 'F'
union all select 'superseded_by_nothing', "doc", n::varchar from lost
union all select 'correction_sequence', "doc", n::varchar from c where seq <= top
union all select distinct 'verdict_differs_from_replay', d."doc", d.id::varchar from d join c on c."doc" = d."doc" and c.id = d.id where d.s <> 'O')
select rule, count(*) findings, count(distinct "doc") docs from f group by 1
"""


@query("ledger_check", _LEDGER)
def ledger_check(spark, d):
    f = validate.ledger_findings(*ledgers(spark, d))
    return f.groupBy("rule").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("doc").alias("docs"))


# claims are parts, evidence suppliers, a line item an edge between them; its line number is the graph


def graphs(spark, d):
    i = table(spark, d, "lineitem")
    doc, part, supplier = F.col("l_linenumber").alias("doc"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    claims = i.where("l_returnflag <> 'R'").select(doc, part.alias("id")).distinct().withColumn("text", F.concat(F.lit("Part  "), "id")).withColumn("normalized_text", F.when(F.col("id").cast("int") % 9 == 0, F.col("text")).otherwise(T.nfc_compact("text"))).withColumn("claim_digest", F.when(F.col("id").cast("int") % 10 == 0, F.sha2("text", 256)).otherwise(F.sha2(T.nfc_compact("text"), 256))).withColumn("status", F.lit("open"))
    evidence = i.where("l_suppkey % 3 > 0").select(doc, supplier.alias("id")).distinct().withColumn("verified", F.lit(True))
    n = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    edges = i.select(doc, n.alias("n"), part.alias("claim"), supplier.alias("evidence"), F.when(F.col("l_linestatus") == "F", "supports").otherwise("contradicts").alias("status"))
    relations = i.where("l_suppkey % 5 = 0").select(doc, n.alias("n"), part.alias("source"), (F.col("l_partkey") - F.col("l_suppkey") % 2).cast("string").alias("target"), F.lit("depends_on").alias("relation"), F.array(supplier).alias("evidence_refs"))
    return claims, evidence, edges, relations


_GRAPH = """
with i as (select l_linenumber g, l_partkey p, l_suppkey s, l_returnflag r, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) n from lineitem),
c as (select distinct g, p from i where r <> 'R'), e as (select distinct g, s from i where s % 3 > 0),
x as (select *, (g, p) in (select g, p from c) kc, (g, s) in (select g, s from e) ke, (g, p - s % 2) in (select g, p from c) kt from i),
f(rule, g, subject) as (
select distinct 'edge_of_unknown_claim', g, n from x where not kc
union all select distinct 'edge_from_unknown_evidence', g, n from x where not ke
union all select distinct 'relation_of_unknown_claim', g, n from x where s % 5 = 0 and not kc
union all select distinct 'relation_to_unknown_claim', g, n from x where s % 5 = 0 and not kt
union all select distinct 'relation_to_itself', g, n from x where s % 10 = 0
union all select distinct 'relation_names_unknown_evidence', g, n from x where s % 5 = 0 and not ke
union all select 'normalized_text', g, p::varchar from c where p % 9 = 0
union all select 'claim_digest', g, p::varchar from c where p % 10 = 0)
select rule, count(*) findings, count(distinct g) docs from f group by 1
"""


@query("claim_graph_check", _GRAPH.replace("l_quantity, l_extendedprice)", "l_quantity::varchar, l_extendedprice::varchar)"))
def claim_graph_check(spark, d):
    f = validate.graph_findings(*graphs(spark, d))
    return f.groupBy("rule").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("doc").alias("docs"))


@query("claim_anchor_states", "with i as (select o_custkey % 50 g, o_orderkey c, l_returnflag r, l_suppkey s from lineitem join orders on o_orderkey = l_orderkey), a as (select g, c, count(*) filter (r = 'A' and s % 4 > 0) yes, count(*) filter (r = 'R') no, count(*) filter (r = 'N') open from i group by 1, 2), o as (select o_custkey % 50 g, o_orderkey c, o_orderstatus s, o_orderkey % 31 = 0 doubt from orders) select o.g \"doc\", o.c::varchar claim, case when o.g % 10 = 0 then 'invalid_graph' when coalesce(no, 0) > 0 then 'conflicted' when coalesce(yes, 0) > 0 and open = 0 and not doubt and s <> 'P' then 'eligible' else 'unsupported' end anchor, coalesce(yes, 0)::bigint supporting, coalesce(no, 0)::bigint contradicting, coalesce(open, 0)::bigint unresolved from o left join a on a.g = o.g and a.c = o.c")
def claim_anchor_states(spark, d):
    """Orders are claims of fifty graphs, line items the edges from their suppliers, a quarter of whom are not verified; every
    tenth graph has one claim too many edges to."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("doc"), F.col("o_orderkey"), "o_orderstatus")
    claim = F.col("o_orderkey").cast("string")
    null = F.lit(None).cast("string")
    claims = o.select("doc", claim.alias("id"), F.lit("A claim.").alias("text"), null.alias("normalized_text"), null.alias("claim_digest"), F.when(F.col("o_orderstatus") == "P", "Unresolved").alias("status"))
    i = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    # joined once, for evidence and edges
    i = written(i.select("doc", "o_orderkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"), "anchor-items")
    supplier = F.col("l_suppkey").cast("string")
    evidence = i.select("doc", supplier.alias("id"), (F.col("l_suppkey") % 4 > 0).alias("verified")).distinct()
    status = F.when(F.col("l_returnflag") == "A", "Supports").when(F.col("l_returnflag") == "R", "refuted").otherwise("related")
    edges = i.select("doc", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]).alias("n"), claim.alias("claim"), supplier.alias("evidence"), status.alias("status"))
    wrong = o.where("doc % 10 = 0").groupBy("doc").agg(F.lit("x").alias("n"), F.lit("nobody").alias("claim"), F.lit("nothing").alias("evidence"), F.lit("supports").alias("status"))
    relations = spark.createDataFrame([], "doc long, n string, source string, target string, relation string, evidence_refs array<string>")
    doubts = o.where("o_orderkey % 31 = 0").select("doc", F.lit("unverifiable_claim").alias("kind"), claim.alias("subject"))
    return validate.anchors(claims, evidence, edges.unionByName(wrong), relations, doubts).select("doc", "claim", "anchor", "supporting", "contradicting", "unresolved")


# manuscripts: a part is a bundle of one file, whose pieces follow from the part's columns

_PIECES = [
    (r"p_size % 4 = 0", r"\documentclass[final]{article}"), (r"p_size % 4 = 1", r"\documentclass[10pt]{article}"), (r"p_partkey % 6 = 0", r"\usepackage[final]{microtype}"), (r"p_partkey % 7 = 0", r"\usepackage[preprint]{neurips}"),
    (r"p_partkey % 9 = 0", r"\cameraready"), (r"p_partkey % 8 = 0", r"% TODO hidden in a comment"), (r"p_partkey % 11 = 0", r"There is a TODO here."), (r"p_size % 5 = 0", r"\vspace{-3mm} tight"), (r"p_size % 5 = 1", r"\vspace{3mm} loose"),
    (r"p_partkey % 10 = 0", r"\section*{Acknowledgements}"), (r"p_partkey % 12 = 0", r"This was supported by NSF."), (r"p_partkey % 13 = 0", r"\verb|TODO ??| is fine"), (r"p_size % 6 = 0", r"See Figure ??."), (r"p_partkey % 3 = 0", r"\begin{abstract}Short.\end{abstract}"),
    (r"p_partkey % 14 = 0", r"\thanks{A. Uthor}"), (r"p_size % 7 = 0", r"\begin{tabular}{l} 0.91 \end{tabular}"), (r"p_size % 7 = 1", r"\begin{tabular}{l} 0.91 $\pm$ 0.02 \end{tabular}"), (r"p_partkey % 15 = 0", r"The method is universally superior."),
]
_BODY = "concat_ws(chr(10), " + ", ".join(f"case when {when} then '{piece}' end" for when, piece in _PIECES) + ")"
#: The same rules over the text without comments and inline verbatim, as DuckDB's patterns.
_RULES = [
    ("FINAL_MODE_IN_REVIEW", r"\\documentclass\s*\[[^\]]*final"), ("FINAL_MODE_IN_REVIEW", r"\\usepackage\s*\[[^\]]*preprint"), ("FINAL_MODE_IN_REVIEW", r"\\cameraready\b"), ("UNRESOLVED_TODO", r"\bTODO\b"), ("LAYOUT_TAMPER", r"\\vspace\{-\d"),
    ("BLIND_ACK_LEAK", r"(?i)\\section\*?\{acknowledg"), ("BLIND_FUNDING_LEAK", r"(?i)\bsupported\s+by\s+nsf\b"), ("UNRESOLVED_REFERENCE", r"\?\?"), ("BLIND_THANKS_LEAK", r"\\thanks\{[^}]"), ("OVERCLAIM_PHRASING", r"universally\s+superior"),
]
_CLEAN = f"m as (select p_partkey bundle, regexp_replace(regexp_replace({_BODY}, '%[^\\n]*', '', 'g'), '\\\\verb\\|[^|]*\\|', '', 'g') t from part)"


@query("lint_manuscripts", f"with {_CLEAN} select bundle, code, count(*) n from (" + " union all ".join(f"select bundle, '{code}' code from m where regexp_matches(t, '{p}')" for code, p in _RULES) + " union all select bundle, 'MISSING_ABSTRACT' from m where not contains(t, '\\begin{abstract}') union all select bundle, 'TABLE_MISSING_DISPERSION' from m where regexp_matches(t, 'tabular\\}\\{l\\} 0.91 .end')) group by 1, 2")
def lint_manuscripts(spark, d):
    body = F.concat_ws("\n", *[F.when(F.expr(when), F.lit(piece)) for when, piece in _PIECES])
    files = lint.masked_files(table(spark, d, "part").select(F.col("p_partkey").alias("bundle"), F.lit("main.tex").alias("path"), body.alias("text")))
    venues = files.select("bundle", F.array().cast("array<string>").alias("required_sections"), F.lit(False).alias("forbids_geometry"))
    found = lint.final_mode(files).unionByName(lint.blindness(files)).unionByName(lint.form(files, style=True)).unionByName(lint.structure(files, venues))
    return found.groupBy("bundle", "code").agg(F.count(F.lit(1)).alias("n"))


@query("lint_citations", "with c as (select distinct o_custkey b, 'k' || (o_orderkey % 30) e from orders), n as (select distinct o_custkey b, 'k' || (o_orderkey % 37) e, 'k' || ((o_orderkey % 37 + 1) % 37) p from orders where o_orderstatus <> 'O'), m as (select o_custkey b, 'k' || (o_orderkey % 37) e, count(*) n from orders where o_orderstatus <> 'O' group by 1, 2), h as (select distinct b from n), u as (with recursive r as (select b, e from c union select n.b, p from r join n on n.b = r.b and n.e = r.e) select * from r) select b bundle, 'UNDEFINED_CITATION' code, e detail from c where b in (from h) and (b, e) not in (select b, e from n) union all select distinct b, 'UNCITED_BIB_ENTRY', e from n where (b, e) not in (from u) union all select b, 'DUPLICATE_BIB_KEY', e from m where n > 1 union all select distinct b, 'MISSING_BIBLIOGRAPHY', 'citations without any entry' from c where b not in (from h) union all select distinct b, 'MISSING_BIBLIOGRAPHY_DIRECTIVE', '' from c where b in (from h)")
def lint_citations(spark, d):
    """A customer is a bundle: its orders are cited, and those not open have entries, each crossreferring to the next key."""
    o = table(spark, d, "orders")
    key = lambda n: F.concat(F.lit("k"), n.cast("string"))
    cites = o.groupBy(F.col("o_custkey").alias("bundle")).agg(F.array_join(F.array_sort(F.collect_set(key(F.col("o_orderkey") % 30))), ",").alias("keys"))
    files = lint.masked_files(cites.select("bundle", F.lit("main.tex").alias("path"), F.concat(F.lit("As in \\citep[p.~3]{"), "keys", F.lit("}.")).alias("text")))
    n = F.col("o_orderkey") % 37
    entry = F.concat(F.lit("@article{"), key(n), F.lit(",\n crossref = {"), key((n + 1) % 37), F.lit("}}\n"))
    bibs = o.where("o_orderstatus <> 'O'").groupBy(F.col("o_custkey").alias("bundle")).agg(F.array_join(F.collect_list(entry), "").alias("text")).withColumn("path", F.lit("refs.bib"))
    return lint.references(files, bibs).select("bundle", "code", "detail")


@query("lint_bindings", "with l as (select o_custkey b, o_orderkey k, case o_orderkey % 4 when 0 then 'CEG_CLAIM_TEXT_MISMATCH' when 1 then null when 2 then 'INVALID_CEG_BINDING' end code from orders) select b bundle, code, count(*) n from l where code is not null and b % 5 > 0 group by 1, 2 union all select b, 'UNVERIFIED_CEG_ANCHOR', 1 from l where b % 5 = 0 and k % 4 < 3 group by 1")
def lint_bindings(spark, d):
    """A customer is a bundle of one line an order: statements of other numbers, true ones, ones bound to nothing, and untagged ones;
    every fifth bundle has no graph."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("bundle"), F.col("o_orderkey").alias("k"))
    k = F.col("k").cast("string")
    line = F.when(F.col("k") % 4 == 0, F.concat(F.lit("It \\emph{gains} 3\\% % ark:claim=c"), k)).when(F.col("k") % 4 == 1, F.concat(F.lit("It gains 2 percent. % ark:claim=c"), k)).when(F.col("k") % 4 == 2, F.concat(F.lit("It gains 2\\% % ark:claim=x"), k)).otherwise("Plain prose.")
    files = lint.masked_files(o.groupBy("bundle").agg(F.array_join(F.collect_list(line), "\n").alias("text")).withColumn("path", F.lit("main.tex")))
    graph = files.where("bundle % 5 > 0").select("bundle", F.lit(0).alias("dangling"), F.lit(0).alias("errors"))
    anchors = o.select("bundle", F.concat(F.lit("c"), k).alias("claim"), F.lit("eligible").alias("anchor"), F.lit("It gains 2%").alias("text"))
    return lint.bindings(files, graph, anchors).groupBy("bundle", "code").agg(F.count(F.lit(1)).alias("n"))
