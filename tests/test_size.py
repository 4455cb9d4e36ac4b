"""Steps whose cost must not outgrow their input: what plans exchange and copy, and the results beside a plain count."""

import random
from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from attesta.functions import tex
from attesta.functions import text as T
from attesta.operators import corpus, forum, lint, state, validate
from attesta.plans import registry
from tests.oracle import rows_of, rows_of_sql


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_conditions_are_dealt_before_they_are_grouped(spark):
    rows = [(p, n, "c", "u", v) for p in range(20) for n in "xy" for v in (1.0, 1.0 + p % 3 * (n == "x"), None)]
    found = forum.same_condition_conflicts(spark.createDataFrame(rows, "paper int, name string, context string, unit string, value double"))
    assert sorted(map(tuple, found.collect())) == [(p, "x", "c", "u", 2) for p in range(20) if p % 3]
    lines = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x or "Repartition" in x]
    assert "Repartition" in lines[-1]  # nothing is gathered before rows are dealt


def test_context_of_checks_without_copies(spark):
    whole = ("d", "g", "t", "a", "c")

    def row(check, argument, kind="ci_consistency", unit="x", **other):
        return check, kind, argument, "extracted", "number", "n", unit, {**dict(zip(forum.AXES, whole, strict=True)), **other}

    rows = [row(1, "estimate"), row(1, "lower", group="h"), row(1, "reported", group="h"), row(2, "estimate"), row(2, "lower", group="h"), row(2, "reported", group="i"), row(3, "reported"), row(3, "reported", timepoint=None)]
    rows += [row(4, "estimate"), row(4, "lower", unit=None), row(5, "mean1", "effect_size"), row(5, "sd1", "effect_size", group="h"), row(5, "n1", "effect_size"), (6, "t_p", "x", "lost", "number", "n", "x", dict(zip(forum.AXES, whole, strict=True)))]
    kinds = "check_id int, kind string, argument string, status string, type string, name string, unit string, context struct<" + ", ".join(f"`{a}`: string" for a in forum.AXES) + ">"
    found = forum.context_errors(spark.createDataFrame(rows, kinds))
    assert sorted(map(tuple, found.collect())) == [(1, "inputs_differ_in_group"), (2, "inputs_differ_in_group"), (2, "reported_differs_in_group"), (3, "reported_differs_in_timepoint"), (4, "units_differ"), (5, "groups_differ_within_n1"), (6, "no_usable_number")]
    assert "Expand" not in plan(found)  # before: a copy of every input for each of 17 counts


def test_a_paper_is_one_row_of_its_checklist(spark):
    rng = random.Random(1)
    stages = [*state.STAGES, "magic", None]
    rows = [(p, rng.choice(stages), rng.choice([*state.STATUSES, "odd", None]), rng.choice([True, False, None]), rng.choice([" ", "why", None])) for p in range(60) for _ in range(12)]
    df = spark.createDataFrame(rows, "paper int, stage string, status string, waived boolean, reason string")
    counts, want = Counter((p, s) for p, s, *_ in rows), set()
    for p, s, status, waived, reason in rows:
        hits = {"unknown_stage": s not in state.STAGES, "duplicate_stage": counts[p, s] > 1, "invalid_status": status not in state.STATUSES, "waived_not_skipped": waived and status not in ("skipped", None), "stage_not_waivable": waived and s is not None and s not in state.WAIVABLE, "waived_without_reason": waived and not (reason or "").strip()}
        want |= {(p, s, rule) for rule, hit in hits.items() if hit}
    found = state.checklist_errors(df)
    got = list(map(tuple, found.collect()))
    assert len(got) == len(set(got)) and set(got) == want
    assert "Window" not in plan(found)  # before: every record sorted by paper and stage, and the errors made distinct twice
    first: dict = {}
    for p, s, status, waived, _ in rows:
        if s in state.STAGES:
            first[p, s] = min(first.get((p, s), (status or "", bool(waived))), (status or "", bool(waived)))
    verdicts = state.checklist(df)
    for r in verdicts.collect():
        status = {s: first.get((r.paper, s), ("unknown", False)) for s in state.STAGES}
        status = {s: (x or "unknown", w) for s, (x, w) in status.items()}
        assert r.contradictions == [s for s in state.STAGES if status[s][0] == "mismatch"]
        assert r.blocking == [s for s in state.HARD if status[s][0] != "pass"]
        assert r.gaps == [s for s in state.STAGES if s not in state.HARD and status[s][0] != "pass" and not (s in state.WAIVABLE and status[s] == ("skipped", True))]
    assert plan(verdicts).count("Exchange") <= 1 and "collect_list" not in plan(verdicts)


def test_texts_are_inverted_in_their_own_row(spark):
    texts = [(1, "b a b"), (1, "c a"), (2, ""), (3, None), (4, " ".join(f"w{i % 700}" for i in range(20_000)))]
    df = spark.createDataFrame(texts, "id int, text string").select("id", F.filter(F.split("text", " "), lambda x: x != "").alias("words"))
    index = corpus.inverted_indexes(df)
    back = index.select("id", "index", T.rebuild_abstract(F.col("index")).alias("text"))
    assert "Exchange" not in plan(back)  # before: two of every word, and texts of one id were mixed
    rows = back.collect()
    assert sorted((r.id, r.text or "") for r in rows) == sorted((i, t or "") for i, t in texts)
    assert next(r["index"] for r in rows if r.text == "b a b") == {"a": [1], "b": [0, 2]}


def test_events_are_dealt_once(spark):
    rng = random.Random(2)
    rows = [(doc, n, rng.randint(0, 9), rng.choice("abx"), rng.choice([None, "active"]), rng.choice(["active", "pruned", "reopened"]), rng.choice([None, "positive", "never"])) for doc in range(6) for n in range(1, 12)]
    events = spark.createDataFrame(rows, "doc int, n int, sequence int, decision string, from_state string, to_state string, verdict_override string")
    decisions = [(doc, i) for doc in range(6) for i in "abc"]
    want, top, last = set(), {}, {}
    for doc, n, sequence, decision, before, state_, override in rows:
        rules = {"event_sequence": sequence <= top.get(doc, 0), "event_of_unknown_decision": decision == "x"}
        top[doc] = max(top.get(doc, sequence), sequence)
        if decision != "x":
            was, new = last.get((doc, decision)), (doc, decision) not in last
            wrong = state_ not in validate.STEPS[was]
            rules |= {"first_event_has_a_state_before": new and before is not None, "illegal_first_state": new and wrong, "state_before_differs": not new and before != was, "illegal_transition": not new and wrong, "illegal_verdict_override": override == "never"}
            last[doc, decision] = state_
        want |= {(str(doc), rule, str(n)) for rule, hit in rules.items() if hit}
    want |= {(str(doc), "decision_without_first_event", i) for doc, i in decisions if (doc, i) not in last}
    found = validate._event_findings(events, spark.createDataFrame(decisions, "doc int, id string"))
    got = list(map(tuple, found.collect()))
    assert len(got) == len(set(got)) and set(got) == want
    assert plan(found).count("Exchange hashpartitioning") == 1  # before: a join and a sort of all events for nearly every rule


def test_claims_edges_and_evidence_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    seen = lambda rows, kinds: (df := spark.createDataFrame(rows, kinds)).mapInArrow(counted, df.schema)
    claims = seen([(1, "a", "A", "B", None), (1, "a", "A", None, "x"), (1, " b", "B", None, None), (2, "c", "C", None, None)], "doc int, id string, text string, normalized_text string, claim_digest string")
    evidence = seen([(1, "e"), (1, "e"), (2, "f")], "doc int, id string")
    edges = seen([(1, "n1", "a", "f", "supports"), (2, "n2", "a", "f", "supports"), (2, "n3", "c", "f", "supports")], "doc int, n string, claim string, evidence string, status string")
    none = spark.createDataFrame([], "doc int, n string, source string, target string, relation string, evidence_refs array<string>")
    found = sorted(map(tuple, validate.graph_findings(claims, evidence, edges, none).collect()))
    assert found == sorted([("1", "normalized_text", "a"), ("1", "claim_digest", "a"), ("1", "duplicate_claim", "a"), ("1", "bad_claim_id", " b"), ("1", "duplicate_evidence", "e"), ("1", "edge_from_unknown_evidence", "n1"), ("2", "edge_of_unknown_claim", "n2")])
    assert read.value == 4 + 3 + 3  # before: claims for each of nine rules, edges for each of two


def test_files_are_masked_once(monkeypatch):
    texts = pd.Series([r"\author{A. Uthor} \cite{a}", "% \\author{B}\n\\author{C}", None, r"\au\verb|x|thor{D}"])
    seen, real = [], tex.masked
    monkeypatch.setattr(tex, "masked", lambda text: seen.append(text) or real(text))
    read = tex.lexed.func(pd.Series(["main.tex"] * 4), texts)
    assert len(seen) == 4  # before: once for the text and once more for the authors
    assert read["authors"].tolist() == [["A. Uthor"], ["C"], [], ["D"]]
    assert read["clean"].tolist() == [texts[0], "\n\\author{C}", None, r"\author{D}"]


def test_works_without_doi_are_not_joined_by_it(spark, monkeypatch):
    plans, keep = {}, corpus.written
    monkeypatch.setattr(corpus, "written", lambda df, what: (plans.setdefault(what, plan(df)), keep(df, what))[1])
    rows = [(i, None if i % 3 else f"10.1000/{i % 2}", f"title {i}", ["a"], 2020) for i in range(12)]
    found = corpus.deduplicate(spark.createDataFrame(rows, "pos long, doi string, title string, authors array<string>, year int"))
    assert {r["pos"]: (r["fate"], r["of"]) for r in found.collect()} == {i: ("duplicate_doi", i % 2 * 3) if i in (6, 9) else ("kept", None) for i in range(12)}
    assert "LeftOuter" not in plans["dedup-works"]  # before: all works without a DOI met in one task


def test_panels_are_turned_in_their_own_row(spark, tmp_path):
    """Keys that repeat, are negative or null, and prices that are null, as SQL has them; panels without a tie."""
    rng = random.Random(4)
    keys = [k for k in range(300) if k % 7] + [600, 600, 600, 601, 603, 604, 604, 605, -1, -2, -5, -7, -6, -8, 1, None, None] + [900] * 50 + [901]
    rows = [(k, None if k in (33, 39) else rng.uniform(900, 500_000)) for k in keys]
    path = f"{tmp_path}/orders.parquet"
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").write.parquet(path)
    found = registry.queries()["derangement"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{path}/*.parquet'")
    cols, want = rows_of_sql(con, registry.oracles()["derangement"])
    assert sorted(found.columns) == cols and rows_of(found) == want and len(want) > 60
    assert "Join" not in plan(found) and "Python" not in plan(found) and plan(found).count("Exchange hashpartitioning") == 1  # before: two joins and a call of Python a panel


def test_rules_on_whole_bundles_send_no_table_to_all_tasks(spark):
    call = lambda name, arg: (1, name, [], [arg] if arg else [], None)
    rows = [(1, "a.tex", [call("begin", "abstract"), call("section", "My LIMITATIONS"), call("bibliography", "x,y")]), (1, "b.tex", [call("usepackage", "a, geometry")]), (2, "a.tex", [call("section", None), call("bibliography", "../z")]), (3, "a.tex", []), (4, "a.tex", [call("paragraph", "abstract")])]
    files = spark.createDataFrame(rows, "bundle int, path string, calls array<struct<line:int,name:string,options:array<string>,args:array<string>,includes:string>>")
    venues = spark.createDataFrame([(1, ["Limitations", "Ethics"], True), (2, ["Limitations"], True), (3, [], False), (9, ["Limitations"], True)], "bundle int, required_sections array<string>, forbids_geometry boolean")
    tree = spark.createDataFrame([(1, "x.bib", False), (1, "l", True), (2, "l", True), (3, "l", True), *[(3, f"{i}.bib", False) for i in range(33)]], "bundle int, path string, link boolean")
    shape, bibs = lint.structure(files, venues), lint.bibliographies(files, tree)
    told = lambda df: sorted((r["bundle"], r["path"], r["code"], r["detail"]) for r in df.collect())
    assert told(shape) == [(1, None, "FORBIDDEN_PACKAGE", "geometry"), (1, None, "MISSING_REQUIRED_SECTION", "Ethics"), (2, None, "MISSING_ABSTRACT", ""), (2, None, "MISSING_REQUIRED_SECTION", "Limitations"), (3, None, "MISSING_ABSTRACT", "")]
    assert sorted(((r["bundle"], r["path"] or "", r["code"], r["detail"]) for r in bibs.collect())) == [(1, "y.bib", "MISSING_BIBLIOGRAPHY", "y.bib"), (2, "../z.bib", "UNSAFE_BIB_PATH", "../z"), (3, "", "INCOMPLETE_COVERAGE", "33 bibliographies"), (3, "l", "UNSAFE_BIB_SYMLINK", "l")]
    assert "Join" not in plan(shape) + plan(bibs)  # before: joins whose sides were broadcast by the bytes of a compressed file
