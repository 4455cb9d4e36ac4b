"""Documents of provenance, decisions and claims checked as tables: every rule is a query for the rows that break it.

Many documents are checked at once: each table has a column `doc`, and findings are (doc, rule, subject). A document
without findings is valid. Graph questions are asked of all documents together, nodes being pairs of document and id.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import nfc_compact
from attesta.operators.graph import closure, reachable
from attesta.operators.lineage import cyclic
from attesta.store import written

_GAP = "\x1f"


def _node(of: str) -> Column:
    return F.concat_ws(_GAP, F.col("doc").cast("string"), of)


def _doc(node: str) -> Column:
    return F.substring_index(node, _GAP, 1)


def _id(node: str) -> Column:
    return F.substring_index(node, _GAP, -1)


def _say(rows: DataFrame, rule: str, subject: str) -> DataFrame:
    return rows.select(F.col("doc").cast("string").alias("doc"), F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))


def _all(found: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found).distinct()


def _unknown(rows: DataFrame, key: str, known: DataFrame, id_: str = "id") -> DataFrame:
    """Rows whose key is no id of their document (a null or empty key is none)."""
    ids = known.select(F.col("doc").alias("_d"), F.col(id_).alias("_i")).distinct()
    return rows.join(ids, (F.col("doc") == F.col("_d")) & (F.col(key) == F.col("_i")), "left_anti")


def _not_in(column: str | Column, values: Iterable[str]) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return ~F.coalesce(c.isin(*values), F.lit(False))


def _doubled(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy("doc", key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _bad_name(key: str) -> Column:
    """No id: null, empty or with blanks around it."""
    return F.col(key).isNull() | (F.trim(key) == "") | (F.trim(key) != F.col(key))


def _on_cycles(edges: DataFrame) -> DataFrame:
    """(doc, id) of the nodes on or between cycles of edges (doc, child, parent)."""
    return cyclic(edges.select(_node("child").alias("child"), _node("parent").alias("parent"))).select(_doc("node").alias("doc"), _id("node").alias("id"))


def _rising(rows: DataFrame, order: str, number: str) -> DataFrame:
    """Rows whose number does not exceed all before it in their document."""
    top = F.max(number).over(Window.partitionBy("doc").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_top", top).where(F.col(number) <= F.coalesce("_top", F.lit(0))).drop("_top")


# provenance

#: Relations of an inline edge that run from an activity to what it made, and those that run to the source (fixed values).
MADE = ("generated", "produces", "produced")
CAME_FROM = ("derived_from", "used", "extracted_from", "recomputed_from", "verified_by", "")


def inline_edges(raw: DataFrame) -> DataFrame:
    """raw (doc, n, and any of child_id, parent_id, source_id, target_id, derived_id, entity_id, used_id, type, activity_id)
    -> doc, n, child, parent, activity, error.

    Five forms are read: child and parent; source and target of a relation that makes; source and target of one that
    comes from; derived or entity with a source; derived or entity with what it used. error: unsupported_type,
    unrecognised_form or empty_endpoint, else null.
    """
    has = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in raw.columns else F.lit(None).cast("string") for c in ("child_id", "parent_id", "source_id", "target_id", "derived_id", "entity_id", "used_id", "type", "activity_id")}
    kind = F.lower(F.coalesce(has["type"], F.lit("")))
    plain, pair, derived = has["child_id"].isNotNull() | has["parent_id"].isNotNull(), has["source_id"].isNotNull() & has["target_id"].isNotNull(), has["derived_id"].isNotNull() | has["entity_id"].isNotNull()
    made, came = kind.isin(*MADE), kind.isin(*CAME_FROM)
    child = F.when(plain, has["child_id"]).when(pair & made, has["target_id"]).when(pair & came, has["source_id"]).when(~pair & derived, F.coalesce(has["derived_id"], has["entity_id"]))
    parent = F.when(plain, has["parent_id"]).when(pair & made, has["source_id"]).when(pair & came, has["target_id"]).when(~pair & derived, F.coalesce(has["source_id"], has["used_id"]))
    error = F.when(~plain & pair & ~made & ~came, "unsupported_type").when(~plain & ~pair & ~derived, "unrecognised_form").when(child.isNull() | parent.isNull(), "empty_endpoint")
    return raw.select("doc", "n", child.alias("child"), parent.alias("parent"), has["activity_id"].alias("activity"), error.alias("error"))


def _has_upstream_entity(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """(node) of every node from which another entity is reached through activities alone. edges: child, parent; kinds: node, kind."""
    kind = lambda c: kinds.select(F.col("node").alias(c), F.col("kind").alias(f"{c}_kind"))
    e = written(edges.join(kind("child"), "child", "left").join(kind("parent"), "parent", "left").where("child <> parent"), "typed-edges")
    direct = e.where("parent_kind = 'entity'").select(F.col("child").alias("node")).distinct()
    through = e.where("parent_kind = 'activity'").select("child", "parent")
    reached = closure(through).select("start", F.col("ancestor").alias("node"))
    return direct.unionByName(reached.join(direct, "node", "left_semi").select(F.col("start").alias("node"))).distinct()


def trace(edges: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """The lineage of a target in each document, from edges as inline_edges gives them.

    nodes (doc, id, kind entity or activity): what a document declares, none where it declares nothing; targets (doc,
    id). -> doc, target, status, ancestors (sorted ids), roots, chain_length. A target that is no node is missing_input;
    a cycle upstream of it comes before a broken_chain, an edge with an empty or undeclared end anywhere in the
    document; what is left is a valid_dag. Roots are upstream entities without an entity above them, seen through
    activities. chain_length counts the target and its ancestors (0 unless valid): it is no depth. Edges of an
    unsupported form are broken. A target's ancestors are gathered into one row.
    """
    whole = edges.where("child is not null and parent is not null")
    declares = nodes.where("kind = 'entity'").select("doc").distinct().withColumn("declares", F.lit(True))
    ends = whole.select("doc", F.explode(F.array("child", "parent")).alias("id")).unionByName(edges.where("activity is not null").select("doc", F.col("activity").alias("id")))
    undeclared = _unknown(ends, "id", nodes).join(declares, "doc", "left_semi").select("doc")
    broken = undeclared.unionByName(edges.where("error is not null").select("doc")).distinct().withColumn("broken", F.lit(True))
    seen = nodes.join(declares, "doc", "left_semi").select("doc", "id", "kind").unionByName(ends.join(declares, "doc", "left_anti").select("doc", "id", F.lit("entity").alias("kind")))
    # of documents that declare activities alone, other nodes are entities
    kinds = seen.join(nodes.where("kind = 'activity'").select("doc", "id", F.lit(True).alias("act")), ["doc", "id"], "left")
    kinds = written(kinds.select("doc", "id", F.when(F.col("act"), "activity").otherwise(F.col("kind")).alias("kind")).distinct(), "trace-nodes")
    links = written(whole.select(_node("child").alias("child"), _node("parent").alias("parent")).distinct(), "trace-edges")
    t = targets.select("doc", F.trim("id").alias("id"))
    most = links.select(_doc("child").alias("d"), F.explode(F.array("child", "parent")).alias("node")).distinct().groupBy("d").count().agg(F.max("count")).first()[0] or 1
    reached, loops = reachable(links, t.select(_node("id").alias("node")), most)
    looped = loops.withColumn("looped", F.lit(True))
    typed = kinds.select(_node("id").alias("node"), "kind")
    above = _has_upstream_entity(links, typed).withColumn("above", F.lit(True))
    marked = reached.join(typed.withColumnRenamed("node", "ancestor"), "ancestor", "left").join(above.withColumnRenamed("node", "ancestor"), "ancestor", "left")
    is_root = (F.col("kind") == "entity") & F.col("above").isNull()
    per = marked.groupBy("start").agg(F.array_sort(F.collect_set(_id("ancestor"))).alias("ancestors"), F.array_sort(F.collect_set(F.when(is_root, _id("ancestor")))).alias("roots"))
    own = t.withColumn("start", _node("id")).join(typed.withColumnRenamed("node", "start"), "start", "left").join(per, "start", "left").join(looped, "start", "left").join(broken, "doc", "left").join(above.withColumnRenamed("node", "start"), "start", "left")
    status = F.when(F.col("kind").isNull(), "missing_input").when(F.col("looped"), "cycle_detected").when(F.col("broken"), "broken_chain").otherwise("valid_dag")
    none = F.array().cast("array<string>")
    out = own.withColumn("status", status).withColumn("ancestors", F.when(status == "missing_input", none).otherwise(F.coalesce(F.array_remove("ancestors", F.col("id")), none)))
    roots = F.when(F.size(F.coalesce("roots", none)) > 0, F.col("roots")).when((F.col("kind") == "entity") & F.col("above").isNull(), F.array("id")).otherwise(none)
    valid = F.col("status") == "valid_dag"
    return out.select("doc", F.col("id").alias("target"), "status", "ancestors", F.when(valid, roots).otherwise(none).alias("roots"), F.when(valid, F.size("ancestors") + 1).otherwise(0).alias("chain_length"))


#: Statuses of a receipt whose lineage is no valid chain (fixed values).
INVALID_TOPOLOGY = ("cycle_detected", "broken_chain")


def receipt_findings(receipts: DataFrame, entities: DataFrame, activities: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """What is wrong in lineage receipts.

    receipts (doc, receipt_id, receipt_digest, target, topology, verification, content, roots array), entities (doc, id,
    type, sha256), activities (doc, id, script), edges (doc, n, type used, generated or derived_from, source, target,
    activity), steps (doc, n, number, activity, inputs array, outputs array). Where a document's ids are not sound, or
    its target is missing, only that is said of it.
    """
    ids = [
        _say(entities.where(_bad_name("id")), "bad_entity_id", "id"), _say(_doubled(entities, "id"), "duplicate_entity_id", "id"),
        _say(activities.where(_bad_name("id")), "bad_activity_id", "id"), _say(_doubled(activities, "id"), "duplicate_activity_id", "id"),
        _say(activities.join(entities.select("doc", "id"), ["doc", "id"], "left_semi"), "activity_is_entity", "id"),
    ]
    unsound = _all(ids)
    lost = _unknown(receipts.where("topology <> 'missing_input'"), "target", entities)
    refused = unsound.select("doc").unionByName(lost.select(F.col("doc").cast("string").alias("doc"))).distinct()
    r = receipts.join(refused, "doc", "left_anti")
    named = r.where(~F.col("receipt_id").eqNullSafe(F.concat(F.lit("rec-"), F.left(F.lower("receipt_digest"), F.lit(32)))))
    empty = (F.size(F.coalesce("roots", F.array())) == 0) & ~F.coalesce("has_steps", F.lit(False))
    r = r.join(steps.select("doc").distinct().withColumn("has_steps", F.lit(True)), "doc", "left")
    missing = r.where(F.col("topology") == "missing_input").where((F.col("verification") != "missing_input") | (F.col("content") != "unchecked") | ~empty)
    # ends of edges, and the graph that sound ones make
    e = edges.join(refused, "doc", "left_anti")
    act, ent = activities.select("doc", "id"), entities.select("doc", "id")
    loose = _unknown(e.where("type in ('used', 'generated')"), "source", act).unionByName(_unknown(e.where("type in ('used', 'generated')"), "target", ent))
    loose = loose.unionByName(_unknown(e.where("type = 'derived_from'"), "source", ent)).unionByName(_unknown(e.where("type = 'derived_from'"), "target", ent)).unionByName(_unknown(e.where("type = 'derived_from' and coalesce(activity, '') <> ''"), "activity", act))
    scripts = activities.join(refused, "doc", "left_anti").where("coalesce(script, '') <> ''")
    no_script = _unknown(scripts, "script", entities.where("type = 'code_file'"))
    loose_docs = loose.select("doc").unionByName(no_script.select("doc")).distinct()
    ok = e.join(loose.select("doc", "n").distinct(), ["doc", "n"], "left_anti")
    up = [ok.where("type = 'used'").select("doc", F.col("source").alias("child"), F.col("target").alias("parent")), ok.where("type = 'generated'").select("doc", F.col("target").alias("child"), F.col("source").alias("parent")), ok.where("type = 'derived_from'").select("doc", F.col("source").alias("child"), F.col("target").alias("parent"))]
    up += [ok.where("type = 'derived_from' and coalesce(activity, '') <> ''").select("doc", F.col("source").alias("child"), F.col("activity").alias("parent")), scripts.join(no_script.select("doc", "id"), ["doc", "id"], "left_anti").select("doc", F.col("id").alias("child"), F.col("script").alias("parent"))]
    up = written(_all(up), "receipt-edges")
    loops = _on_cycles(up).select("doc").distinct()
    text = lambda df: df.select(F.col("doc").cast("string").alias("doc")).distinct()
    r = r.withColumn("doc", F.col("doc").cast("string"))
    flagged = lambda df, flag: text(df).withColumn(flag, F.lit(True))
    r = r.join(flagged(loops, "looped"), "doc", "left").join(flagged(loose_docs, "loose"), "doc", "left")
    bad, valid = r.where(F.col("topology").isin(*INVALID_TOPOLOGY)), r.where("topology = 'valid_dag'")
    matrix = [
        (bad.where("topology = 'cycle_detected' and looped is null"), "cycle_declared_without_one"), (bad.where("topology = 'broken_chain' and loose is null"), "break_declared_without_one"),
        (bad.where("verification <> topology"), "verification_differs_from_topology"), (bad.where("content <> 'unchecked'"), "content_of_invalid_topology"), (bad.where(~empty), "roots_or_steps_of_invalid_topology"),
        (valid.where("loose"), "valid_despite_broken_reference"), (valid.where("looped"), "valid_despite_cycle"),
        (valid.where("content in ('hash_mismatch', 'missing_artifact') and verification <> content"), "verification_hides_content"),
        (valid.where("verification = 'intact' and content <> 'fully_verified'"), "intact_without_verified_content"), (valid.where("content = 'fully_verified' and verification <> 'intact'"), "verified_content_not_intact"),
    ]
    found = [*ids, _say(lost, "target_missing", "target"), _say(named, "receipt_id_differs_from_digest", "receipt_id"), _say(missing, "missing_input_with_content", "target"), *[_say(df, rule, "target") for df, rule in matrix]]
    # the closure of the target
    vd = valid.select("doc", "target", "content", "roots")
    most = declared_nodes(ent, act)
    reached, _ = reachable(up.select(_node("child").alias("child"), _node("parent").alias("parent")), vd.select(F.concat_ws(_GAP, "doc", "target").alias("node")), most)
    inside = reached.select(F.col("ancestor").alias("node")).unionByName(vd.select(F.concat_ws(_GAP, "doc", "target").alias("node"))).distinct()
    declared = ent.withColumn("kind", F.lit("entity")).unionByName(act.withColumn("kind", F.lit("activity"))).withColumn("doc", F.col("doc").cast("string")).join(vd.select("doc"), "doc", "left_semi").withColumn("node", F.concat_ws(_GAP, "doc", "id"))
    found.append(_say(declared.join(inside, "node", "left_anti"), "outside_the_target_s_closure", "id"))
    s = steps.withColumn("doc", F.col("doc").cast("string")).join(vd.select("doc"), "doc", "left_semi")
    expected = F.row_number().over(Window.partitionBy("doc").orderBy("n"))
    found.append(_say(s.withColumn("_e", expected).where("number is null or number <> _e"), "step_number", "n"))
    acts = act.withColumn("doc", F.col("doc").cast("string"))
    found += [_say(_unknown(s, "activity", acts), "step_of_unknown_activity", "activity"), _say(_doubled(s, "activity"), "two_steps_of_an_activity", "activity"), _say(_unknown(acts.join(vd.select("doc"), "doc", "left_semi"), "id", s, "activity"), "activity_without_step", "id")]
    sides = up_sides(ok)
    both = s.join(sides, ["doc", "activity"], "left")
    none = F.array().cast("array<string>")
    for side, edge in (("inputs", "used"), ("outputs", "generated")):
        found.append(_say(both.where(F.array_sort(F.coalesce(side, none)) != F.coalesce(edge, none)), f"step_{side}_differ_from_edges", "activity"))
        found.append(_say(_unknown(s.select("doc", F.explode(side).alias("id")), "id", ent.withColumn("doc", F.col("doc").cast("string"))), f"step_{side}_unknown", "id"))
    above = _has_upstream_entity(up.select(_node("child").alias("child"), _node("parent").alias("parent")), declared.select("node", "kind"))
    roots = declared.where("kind = 'entity'").join(inside, "node", "left_semi").join(above, "node", "left_anti").groupBy("doc").agg(F.array_sort(F.collect_set("id")).alias("want"))
    want = F.when(F.col("content").isin("hash_mismatch", "missing_artifact"), none).otherwise(F.coalesce("want", none))
    found.append(_say(vd.join(roots, "doc", "left").where(F.coalesce("roots", none) != want), "roots_differ", "target"))
    hashed = entities.withColumn("doc", F.col("doc").cast("string")).withColumn("node", F.concat_ws(_GAP, "doc", "id")).join(inside, "node", "left_semi").where("coalesce(sha256, '') = ''")
    found.append(_say(hashed.join(vd.where("content = 'fully_verified'").select("doc"), "doc", "left_semi"), "verified_without_hash", "id"))
    return _all(found)


def declared_nodes(entities: DataFrame, activities: DataFrame) -> int:
    """The most nodes that any document declares."""
    return entities.select("doc").unionByName(activities.select("doc")).groupBy("doc").count().agg(F.max("count")).first()[0] or 1


def up_sides(edges: DataFrame) -> DataFrame:
    """doc, activity, used and generated: what each activity's sound edges name, sorted."""
    by = edges.where("type in ('used', 'generated')").groupBy(F.col("doc").cast("string").alias("doc"), F.col("source").alias("activity"))
    return by.agg(*[F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("target")))).alias(t) for t in ("used", "generated")])


# decisions

#: Verdicts, states and their legal steps, and reasons of a step (fixed values).
DECISION_VERDICTS = ("positive", "negative", "inconclusive", "unverifiable")
STEPS = {None: ("active", "pruned"), "active": ("pruned",), "pruned": ("reopened",), "reopened": ("pruned",)}
PRUNE_REASONS = ("resource_exhausted", "superseded", "contradicted", "out_of_scope", "duplicate", "external_constraint", "investigator_error", "other")
REOPEN_REASONS = ("new_evidence", "scope_change", "investigator_reconsideration", "error_correction", "other")


def decision_digest(id_: Column, kind: Column, action: Column, title: Column) -> Column:
    """SHA-256 of the decision's canonical JSON: keys sorted, no blanks."""
    action = F.when(kind == "negative_result", F.coalesce(action, F.lit("negative_result"))).otherwise(action)
    return F.sha2(F.to_json(F.struct(F.coalesce(action, F.lit("")).alias("action"), kind.alias("entry_kind"), id_.alias("id"), nfc_compact(title).alias("title"))), 256)


def _marked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with `rules`, the names of those of these rules that a row breaks."""
    return rows.withColumn("rules", F.array_compact(F.array(*[F.when(hit, F.lit(rule)) for rule, hit in rules.items()])))


def _told(marked: DataFrame, subject: str) -> DataFrame:
    return marked.select(F.col("doc").cast("string").alias("doc"), F.explode("rules").alias("rule"), F.col(subject).cast("string").alias("subject"))


def _with_decision(rows: DataFrame, key: str, d: DataFrame) -> DataFrame:
    """rows with {key}_known (null where the key is no decision of the document) and {key}_kind."""
    return rows.join(d.select("doc", F.col("id").alias(key), F.lit(True).alias(f"{key}_known"), F.col("entry_kind").alias(f"{key}_kind")), ["doc", key], "left")


def _event_findings(events: DataFrame, d: DataFrame) -> DataFrame:
    """What is wrong in the order of events, in what they name, and in each decision's path through the states.

    Events and decisions are dealt by document once; whether a decision is known, its state before and the greatest number
    before follow from windows inside the document.
    """
    null = F.lit(None).cast("string")
    doc = F.col("doc").cast("string").alias("doc")
    rows = events.select(doc, "decision", F.col("n"), "sequence", "from_state", "to_state", "verdict_override", F.lit(False).alias("own"))
    rows = rows.unionByName(d.select(doc, F.col("id").alias("decision"), null.alias("from_state"), null.alias("to_state"), null.alias("verdict_override"), F.lit(True).alias("own")), allowMissingColumns=True)
    before = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    path = Window.partitionBy("doc", "decision").orderBy("own", "n")
    all_ = path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_top", F.max("sequence").over(before)).withColumns({"_known": F.max("own").over(all_), "_events": F.count_if(~F.col("own")).over(all_), "_n": F.row_number().over(path), "_before": F.lag("to_state").over(path)})
    legal = F.lit(False)
    for state, after in STEPS.items():
        legal = legal | (F.col("to_state").isin(*after) & (F.col("_n") == 1 if state is None else (F.col("_n") > 1) & (F.col("_before") == state)))
    event, first, wrong = ~F.col("own"), F.col("_n") == 1, ~F.coalesce(legal, F.lit(False))
    known = event & F.col("_known")
    rules = {
        "event_sequence": event & (F.col("sequence") <= F.coalesce("_top", F.lit(0))), "event_of_unknown_decision": event & ~F.col("_known"),
        "first_event_has_a_state_before": known & first & F.col("from_state").isNotNull(), "illegal_first_state": known & first & wrong,
        "state_before_differs": known & ~first & ~F.col("from_state").eqNullSafe(F.col("_before")), "illegal_transition": known & ~first & wrong,
        "illegal_verdict_override": known & F.col("verdict_override").isNotNull() & _not_in("verdict_override", DECISION_VERDICTS), "decision_without_first_event": F.col("own") & (F.col("_events") == 0),
    }
    bits = reduce(Column.bitwiseOR, [F.when(hit, 1 << i).otherwise(0) for i, hit in enumerate(rules.values())])
    # a finding is told once, and these rules only here
    by = rows.select("doc", F.when(F.col("own"), F.col("decision")).otherwise(F.col("n").cast("string")).alias("subject"), bits.alias("bits")).where("bits > 0").groupBy("doc", "subject").agg(F.bit_or("bits").alias("bits"))
    return by.select("doc", F.explode(F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) > 0, rule) for i, rule in enumerate(rules)]))).alias("rule"), "subject")


def ledger_findings(decisions: DataFrame, bases: DataFrame, forks: DataFrame, events: DataFrame, corrections: DataFrame, uncertainties: DataFrame) -> DataFrame:
    """What is wrong in decision ledgers.

    decisions (doc, id, title, normalized_title, entry_kind, action, decision_digest, initial_verdict, verdict, artifact),
    bases (doc, n, decision, basis, has_receipt), forks (doc, n, decision, alternative), events (doc, n, sequence, decision,
    from_state, to_state, reason, alternative, caused_by, verdict_override), corrections (doc, n, sequence, decision,
    verdict), uncertainties (doc, kind, subject). Of repeated ids the first title by name stands.
    """
    rest = [c for c in decisions.columns if c not in ("doc", "id")]
    one = decisions.groupBy("doc", "id").agg(F.min(F.struct(*rest)).alias("x"), F.count(F.lit(1)).alias("times")).select("doc", "id", "times", "x.*")
    real, title = F.col("id") != "", F.coalesce("title", F.lit(""))
    judged = _marked(one, {
        "duplicate_decision": F.col("times") > 1,
        "normalized_title": real & ~F.col("normalized_title").eqNullSafe(nfc_compact(title)),
        "decision_digest": real & ~F.col("decision_digest").eqNullSafe(decision_digest(F.col("id"), F.col("entry_kind"), F.col("action"), title)),
        "illegal_initial_verdict": real & F.col("initial_verdict").isNotNull() & _not_in("initial_verdict", DECISION_VERDICTS), "illegal_verdict": real & F.col("verdict").isNotNull() & _not_in("verdict", DECISION_VERDICTS),
    })
    judged = written(judged.select("doc", "id", "rules", "entry_kind", "initial_verdict", "verdict", (F.coalesce("artifact", F.lit("")) != "").alias("shown")), "ledger-decisions")
    d, first = judged.where("coalesce(id, '') <> ''"), F.coalesce("initial_verdict", "verdict", F.lit("inconclusive"))
    found = [_told(judged, "id")]
    links = {}
    for name, rows, other in (("basis", bases, "basis"), ("fork", forks, "alternative")):
        both = _with_decision(_with_decision(rows, "decision", d), other, d)
        links[name] = written(_marked(both, {f"{name}_of_unknown_decision": F.col("decision_known").isNull(), f"{name}_names_unknown_decision": F.col(f"{other}_known").isNull(), f"{name}_on_itself": F.col("decision") == F.col(other)}), "ledger-links")
        found.append(_told(links[name], "n"))
    negative = d.where("entry_kind = 'negative_result'")
    known = links["basis"].where("decision_known and basis_known and decision_kind = 'negative_result'")
    sound = known.where("basis_kind = 'decision'")
    found += [_say(known.where("basis_kind <> 'decision'"), "negative_result_on_a_result", "decision"), _say(_unknown(negative, "id", sound, "decision"), "negative_result_without_basis", "id")]
    shown = sound.where("has_receipt").select("doc", F.col("decision").alias("id")).unionByName(negative.where("shown").select("doc", "id")).unionByName(uncertainties.where("kind = 'unsupported_negative_result'").select("doc", F.col("subject").alias("id")))
    found.append(_say(_unknown(negative, "id", shown), "negative_result_without_receipt", "id"))
    told = _event_findings(events, d)
    ev = events.join(d.select("doc", F.col("id").alias("decision")), ["doc", "decision"], "left_semi")
    found.append(_say(_unknown(ev.where("caused_by is not null"), "caused_by", d), "cause_unknown", "n"))
    replaced = written(_with_decision(ev.where("reason = 'superseded'").select("doc", "n", "decision", "alternative"), "alternative", d), "ledger-superseded")
    lost = replaced.where("alternative_known is null or alternative = decision").select("doc", "n")
    chains = replaced.join(lost, ["doc", "n"], "left_anti").select("doc", F.col("decision").alias("child"), F.col("alternative").alias("parent"))
    found += [_say(lost, "superseded_by_nothing", "n"), _say(_on_cycles(chains), "supersession_cycle", "id")]
    # corrections: their order and what the last one leaves
    found += [_say(_unknown(corrections, "decision", d), "correction_of_unknown_decision", "n"), _say(_rising(corrections, "n", "sequence"), "correction_sequence", "n"), _say(corrections.where(_not_in("verdict", DECISION_VERDICTS)), "illegal_corrected_verdict", "n")]
    last = corrections.where("coalesce(verdict, '') <> ''").groupBy("doc", F.col("decision").alias("id")).agg(F.max_by("verdict", "n").alias("corrected"))
    replay = d.join(last, ["doc", "id"], "left").where(F.coalesce("verdict", first) != F.coalesce("corrected", first))
    return _all([*found, _say(replay, "verdict_differs_from_replay", "id")]).unionByName(told)


# claims

#: Words for a claim's support, and relations that depend (fixed values).
SUPPORTS = ("supported", "supports", "support", "verified_by")
CONTRADICTS = ("contradicted", "contradicts", "refuted", "refutes")
DEPENDS = ("depends_on", "entails", "refines")


def graph_findings(claims: DataFrame, evidence: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """What is wrong in claim-evidence graphs.

    claims (doc, id, text, normalized_text, claim_digest; the last two may be null), evidence (doc, id), edges (doc, n,
    claim, evidence, status), relations (doc, n, source, target, relation, evidence_refs array).
    """
    return _all(_graph_rules(claims, evidence, edges, relations))


def _graph_rules(claims: DataFrame, evidence: DataFrame, edges: DataFrame, relations: DataFrame) -> list[DataFrame]:
    """The findings of each rule on its own. Claims and evidence are grouped by id and judged once; edges and relations are
    joined once with each of what they name."""
    text, told = nfc_compact(F.coalesce("text", F.lit(""))), lambda c: F.coalesce(c, F.lit(False))
    bad = told(_bad_name("id"))
    own = claims.groupBy("doc", "id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(told(F.col("normalized_text").isNotNull() & (F.col("normalized_text") != text))).alias("differs"), F.bool_or(told(F.col("claim_digest").isNotNull() & (F.col("claim_digest") != F.sha2(text, 256)))).alias("forged")
    )
    own = written(_marked(own, {"bad_claim_id": bad | told(F.col("id").rlike(r"[\r\n]")), "duplicate_claim": F.col("n") > 1, "normalized_text": F.col("differs"), "claim_digest": F.col("forged")}).select("doc", "id", "rules"), "graph-claims")
    shown = written(_marked(evidence.groupBy("doc", "id").agg(F.count(F.lit(1)).alias("n")), {"bad_evidence_id": bad, "duplicate_evidence": F.col("n") > 1}).select("doc", "id", "rules"), "graph-evidence")
    known = lambda rows, key, ids: rows.join(ids.select("doc", F.col("id").alias(key), F.lit(True).alias(f"{key}_known")), ["doc", key], "left")
    lost = lambda key: F.col(f"{key}_known").isNull()
    ends = known(known(edges.select("doc", "n", "claim", "evidence"), "claim", own), "evidence", shown)
    pairs = known(known(relations.select("doc", "n", "source", "target", "relation"), "source", own), "target", own)
    pairs = written(_marked(pairs, {"relation_of_unknown_claim": lost("source"), "relation_to_unknown_claim": lost("target"), "relation_to_itself": (F.col("source") == F.col("target")) & F.col("relation").isin(*DEPENDS, "contradicts")}), "graph-relations")
    loops = pairs.where(F.col("relation").isin(*DEPENDS) & (F.col("source") != F.col("target")) & ~lost("source") & ~lost("target"))
    return [
        _told(own, "id"), _told(shown, "id"), _told(_marked(ends, {"edge_of_unknown_claim": lost("claim"), "edge_from_unknown_evidence": lost("evidence")}), "n"), _told(pairs, "n"),
        _say(_unknown(relations.select("doc", "n", F.explode("evidence_refs").alias("ref")), "ref", shown), "relation_names_unknown_evidence", "n"),
        _say(_on_cycles(loops.select("doc", F.col("source").alias("child"), F.col("target").alias("parent"))), "dependency_cycle", "id"),
    ]


def dangling_edges(edges: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(doc, n) of support edges without their claim or evidence."""
    return _unknown(edges, "claim", claims).select("doc", "n").unionByName(_unknown(edges, "evidence", evidence).select("doc", "n")).distinct()


def anchors(claims: DataFrame, evidence: DataFrame, edges: DataFrame, relations: DataFrame, uncertainties: DataFrame) -> DataFrame:
    """What each claim may be bound to: doc, claim, anchor, text, supporting, contradicting, unresolved.

    claims (..., status), evidence (..., verified: null counts as verified), uncertainties (doc, kind, subject). A graph
    with any finding has invalid claims only; then contradiction makes a claim conflicted, and support without open
    edges, uncertainty or an unsettled status makes it eligible; what is left is unsupported.
    """
    # of findings only their documents count, so no subject is carried along
    wrong = reduce(DataFrame.unionByName, [rule.select("doc").distinct() for rule in _graph_rules(claims, evidence, edges, relations)]).distinct().withColumn("wrong", F.lit(True))
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    met = edges.withColumn("s", status).join(evidence.select("doc", F.col("id").alias("evidence"), F.coalesce("verified", F.lit(True)).alias("verified")), ["doc", "evidence"])
    yes, no = F.col("s").isin(*SUPPORTS), F.col("s").isin(*CONTRADICTS)
    by = met.groupBy("doc", F.col("claim").alias("id")).agg(F.count_if(yes & F.col("verified")).alias("supporting"), F.count_if(no).alias("contradicting"), F.count_if(~yes & ~no).alias("unresolved"))
    opposed = relations.where("relation = 'contradicts'").select("doc", F.explode(F.array("source", "target")).alias("id"))
    doubt = lambda kinds: uncertainties.where(F.col("kind").isin(*kinds)).select("doc", F.col("subject").alias("id"))
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    c = claims.join(by, ["doc", "id"], "left").join(flag(opposed.unionByName(doubt(["unresolved_contradiction"])), "opposed"), ["doc", "id"], "left")
    c = c.join(flag(doubt(["unverifiable_claim", "missing_receipt", "ambiguous_locator", "generic_uncertainty"]), "doubted"), ["doc", "id"], "left").withColumn("_doc", F.col("doc").cast("string")).join(wrong.withColumnRenamed("doc", "_doc"), "_doc", "left")
    text = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), r"\.+$", ""))
    n = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    conflicted = (n("contradicting") > 0) | F.col("opposed") | status.isin("conflicted", "contested", "contradicted", "refuted")
    eligible = (n("supporting") > 0) & (text != "") & (n("unresolved") == 0) & F.col("doubted").isNull() & ~status.isin("unverifiable", "unresolved", "out_of_scope")
    anchor = F.when(F.col("wrong"), "invalid_graph").when(F.coalesce(conflicted, F.lit(False)), "conflicted").when(eligible, "eligible").otherwise("unsupported")
    return c.select("doc", F.col("id").alias("claim"), anchor.alias("anchor"), text.alias("text"), n("supporting").alias("supporting"), n("contradicting").alias("contradicting"), n("unresolved").alias("unresolved"))
