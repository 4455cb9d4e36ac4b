"""Lineage, receipts, ledgers, claim graphs, links and lint on small documents worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import tex
from attesta.functions import text as T
from attesta.operators import forum, graph, identity, lint, state, validate
from attesta.sources import documents as docs

EDGE = "doc string, n int, child string, parent string, activity string, error string"


def trace(spark, edges, nodes, targets):
    e = spark.createDataFrame([(d, i, c, p, None, None if c and p else "empty_endpoint") for i, (d, c, p) in enumerate(edges)], EDGE)
    t = validate.trace(e, spark.createDataFrame(nodes, "doc string, id string, kind string"), spark.createDataFrame(targets, "doc string, id string"))
    return {r["doc"]: (r["status"], r["ancestors"], r["roots"], r["chain_length"]) for r in t.collect()}


def test_trace_precedence(spark):
    """missing before cycle before broken before valid; roots through activities; a lone target is its own root."""
    ent = lambda d, *ids: [(d, i, "entity") for i in ids]
    got = trace(
        spark,
        [("ok", "t", "act"), ("ok", "act", "a"), ("ok", "t", "b"), ("cyc", "t", "a"), ("cyc", "a", "b"), ("cyc", "b", "a"), ("cyc", "t", "nowhere"), ("brk", "t", "a"), ("brk", "x", None), ("mis", "a", "b"), ("und", "t", "ghost"), ("free", "t", "a"), ("far", "t", "a"), ("far", "y", "z"), ("far", "z", "y")],
        [*ent("ok", "t", "a", "b"), ("ok", "act", "activity"), *ent("cyc", "t", "a", "b"), *ent("brk", "t", "a", "x"), *ent("mis", "a", "b"), *ent("und", "t"), *ent("one", "t"), *ent("far", "t", "a", "y", "z")],
        [(d, "t") for d in ("ok", "cyc", "brk", "mis", "und", "free", "one", "far")],
    )
    assert got["ok"] == ("valid_dag", ["a", "act", "b"], ["a", "b"], 4)
    assert got["cyc"][0] == "cycle_detected" and got["cyc"][2:] == ([], 0)
    assert got["brk"] == ("broken_chain", ["a"], [], 0) and got["und"][0] == "broken_chain"
    assert got["mis"] == ("missing_input", [], [], 0)
    assert got["free"] == ("valid_dag", ["a"], ["a"], 2) and got["one"] == ("valid_dag", [], ["t"], 1)
    assert got["far"][0] == "valid_dag"  # a cycle that the target does not reach


def test_edge_forms(spark):
    rows = [(1, "a", "b", None, None, None, None, None, None), (2, None, None, "act", "e", None, None, None, "generated"), (3, None, None, "e", "s", None, None, None, None), (4, None, None, "s", None, "d", None, None, None), (5, None, None, None, None, None, "e", "u", None), (6, None, None, "a", "b", None, None, None, "likes"), (7, *[None] * 8), (8, "a", " ", *[None] * 6)]
    raw = spark.createDataFrame([("d", *r) for r in rows], "doc string, n int, child_id string, parent_id string, source_id string, target_id string, derived_id string, entity_id string, used_id string, type string")
    got = {r["n"]: (r["child"], r["parent"], r["error"]) for r in validate.inline_edges(raw).collect()}
    assert got == {1: ("a", "b", None), 2: ("e", "act", None), 3: ("e", "s", None), 4: ("d", "s", None), 5: ("e", "u", None), 6: (None, None, "unsupported_type"), 7: (None, None, "unrecognised_form"), 8: ("a", None, "empty_endpoint")}


@pytest.mark.parametrize("seed", [1, 2])
def test_full_closure_is_breadth_first(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)} | {(100 + i, 101 + i) for i in range(37)}
    want = {}
    for start in {n for e in edges for n in e}:
        front, depth, seen = {start}, 0, {start}
        while front:
            depth += 1
            front = {b for a, b in edges if a in front} - seen
            seen |= front
            want |= {(start, n): depth for n in front}
    df = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "child string, parent string")
    assert {(int(r["start"]), int(r["ancestor"])): r["depth"] for r in graph.closure(df).collect()} == want
    some = spark.createDataFrame([("3",), ("100",)], "node string")
    reached, looped = graph.reachable(df, some, 70)
    assert {(int(r["start"]), int(r["ancestor"])) for r in reached.collect()} == {k for k in want if k[0] in (3, 100)}
    loops = {n for a, b in edges for n in (a, b) if any(x == n or (x, n) in want for x in [b2 for a2, b2 in edges if a2 == n])}
    assert {int(r["start"]) for r in looped.collect()} == {s for s in (3, 100) if s in loops or any((s, n) in want for n in loops)}
    assert {(int(r["start"]), int(r["ancestor"])): r["depth"] for r in graph.closure(df, some).collect()} == {k: v for k, v in want.items() if k[0] in (3, 100)}


def receipt(spark, receipts, entities, activities, edges, steps):
    f = validate.receipt_findings(
        spark.createDataFrame(receipts, "doc string, receipt_id string, receipt_digest string, target string, topology string, verification string, content string, roots array<string>"),
        spark.createDataFrame(entities, "doc string, id string, type string, sha256 string"),
        spark.createDataFrame(activities, "doc string, id string, script string"),
        spark.createDataFrame(edges, "doc string, n int, type string, source string, target string, activity string"),
        spark.createDataFrame(steps, "doc string, n int, number int, activity string, inputs array<string>, outputs array<string>"),
    )
    out: dict[str, set] = {}
    for r in f.collect():
        out.setdefault(r["doc"], set()).add((r["rule"], r["subject"]))
    return out


def test_receipts(spark):
    digest = "ab" * 32
    name = "rec-" + digest[:32]
    good = lambda d, **x: tuple(({"doc": d, "id": name, "dig": digest, "t": "out", "top": "valid_dag", "ver": "intact", "con": "fully_verified", "roots": ["raw"]} | x).values())
    receipts = [good("ok"), good("roots", roots=[]), good("name", id="rec-x"), good("cyc", top="cycle_detected", ver="cycle_detected", con="unchecked", roots=[]), good("hash"), good("out"), good("step"), good("gone", t="none"), good("miss", t="x", top="missing_input", ver="missing_input", con="unchecked", roots=[]), good("loose"), good("mat", con="hash_mismatch", roots=[]), good("twice")]
    ents, acts, edges, steps = [], [], [], []
    for r in receipts:
        d = r[0]
        ents += [(d, "raw", "data", None if d == "hash" else "h"), (d, "out", "data", "h"), (d, "code", "code_file", "h")]
        acts.append((d, "run", "code"))
        edges += [(d, 1, "used", "run", "raw", None), (d, 2, "generated", "run", "out", None)]
        steps.append((d, 1, 1, "run", ["raw"], ["out"]))
    receipts = [(*r[:7], ["code", "raw"] if r[7] == ["raw"] else r[7]) for r in receipts]
    ents += [("out", "alone", "data", "h"), ("twice", "raw", "data", "h")]
    edges += [("loose", 3, "used", "run", "ghost", None)]
    steps = [s if s[0] != "step" else ("step", 1, 2, "run", ["out"], ["out"]) for s in steps if s[0] not in ("cyc", "miss")]
    ents, acts, edges = ([x for x in rows if x[0] != "miss"] for rows in (ents, acts, edges))
    got = receipt(spark, receipts, ents, acts, edges, steps)
    assert "ok" not in got and "miss" not in got
    assert got["roots"] == {("roots_differ", "out")} and got["name"] == {("receipt_id_differs_from_digest", "rec-x")}
    assert got["cyc"] == {("cycle_declared_without_one", "out")} and got["hash"] == {("verified_without_hash", "raw")}
    assert got["out"] == {("outside_the_target_s_closure", "alone")} and got["twice"] == {("duplicate_entity_id", "raw")}
    assert got["step"] == {("step_number", "1"), ("step_inputs_differ_from_edges", "run")}
    assert got["gone"] == {("target_missing", "none")} and ("valid_despite_broken_reference", "out") in got["loose"]
    assert got["mat"] == {("verification_hides_content", "out"), ("intact_without_verified_content", "out")}


def test_supersession_and_dependency_cycles(spark):
    dec = [("d", x, x, x, "decision", "explore", None, None, "positive", None) for x in "abc"]
    decisions = spark.createDataFrame(dec, "doc string, id string, title string, normalized_title string, entry_kind string, action string, decision_digest string, initial_verdict string, verdict string, artifact string").withColumn("decision_digest", validate.decision_digest(F.col("id"), F.col("entry_kind"), F.col("action"), F.col("title")))
    none = lambda schema: spark.createDataFrame([], schema)
    ev = [("d", i, i, x, None if y is None else "active", "active" if y is None else "pruned", "other" if y is None else "superseded", y, None, None) for i, (x, y) in enumerate([("a", None), ("b", None), ("c", None), ("a", "b"), ("b", "a"), ("c", "c")], 1)]
    events = spark.createDataFrame(ev, "doc string, n int, sequence int, decision string, from_state string, to_state string, reason string, alternative string, caused_by string, verdict_override string")
    f = validate.ledger_findings(decisions, none("doc string, n string, decision string, basis string, has_receipt boolean"), none("doc string, n string, decision string, alternative string"), events, none("doc string, n int, sequence int, decision string, verdict string"), none("doc string, kind string, subject string"))
    assert {(r["rule"], r["subject"]) for r in f.collect()} == {("supersession_cycle", "a"), ("supersession_cycle", "b"), ("superseded_by_nothing", "6")}
    claims = spark.createDataFrame([("g", x, f"Claim {x}", None, None) for x in "pqr"], "doc string, id string, text string, normalized_text string, claim_digest string")
    rel = spark.createDataFrame([("g", 1, "p", "q", "depends_on", ["e"]), ("g", 2, "q", "p", "refines", []), ("g", 3, "r", "p", "contradicts", [])], "doc string, n int, source string, target string, relation string, evidence_refs array<string>")
    f = validate.graph_findings(claims, spark.createDataFrame([("g", "e")], "doc string, id string"), none("doc string, n int, claim string, evidence string, status string"), rel)
    assert {(r["rule"], r["subject"]) for r in f.collect()} == {("dependency_cycle", "p"), ("dependency_cycle", "q")}


def test_links_and_receipts(spark):
    links = [("a", "b", "cites", "s", "t", ["x"], [], True), ("a", "b", "retraction", "s", "t", ["x"], [], False), ("a", "a", "cites", "s", "t", [], [], True), ("a", "b", "hates", "s", "t", [], [], True), ("a", "b", "cites", None, "t", [], [], True)]
    df = spark.createDataFrame(links, "a string, b string, kind string, source string, queried_at string, match_fields array<string>, conflict_fields array<string>, human_confirmed boolean")
    assert sorted(str(r["error"]) for r in identity.checked_links(df).collect()) == ["None", "None", "missing_evidence", "same_object", "unknown_kind"]
    assert sorted((r["holder"], r["holds"], r["from_object"], r["to_object"]) for r in identity.edges_of(df).collect()) == [("a", "lineage", "a", "b"), ("a", "relations", "a", "b"), ("b", "lineage", "a", "b")]
    r = spark.createDataFrame([("k", '{"schema_version": "1.0", "sources": [{"source": "x", "coverage": ""}], "claims": [{"claim": "c", "support_status": "out_of_scope"}, {"claim": "d", "support_status": "supported"}], "conflicts": ["y"]}'), ("old", '{"schema_version": "0.9", "sources": [{"source": "z", "status": "ok"}], "conflicts": ["y"]}')], "key string, receipt string")
    assert sorted(map(tuple, identity.open_questions(r).collect())) == [("k", "c", "out_of_scope_claim", False), ("k", "y", "receipt_conflict", True), ("old", "unsupported schema_version", "unsupported_schema_version", True)]
    assert sorted(map(tuple, identity.observations(r).collect()), key=str) == [("k", "x", "", "skipped", None, None), ("old", "z", "", "ok", None, None)]
    w = spark.createDataFrame([("https://doi.org/10.1/A", "arXiv:2101.00001v2.pdf", "T", ["a"], 2000, None), (None, None, "One two, three four five six seven", None, None, "V"), (None, None, "!!", None, None, None)], "doi string, arxiv string, title string, authors array<string>, year int, container string")
    assert [(x["object_id"], len(x["identifiers"])) for x in identity.objects(w).collect()] == [("ro:work:10.1/a", 2), ("ro:work:one-two-three-four-five-six", 0), ("ro:work:untitled", 0)]


def test_providers(spark):
    epmc = '{"resultList": {"result": [{"doi": "10.1/X", "isOpenAccess": "N", "fullTextUrlList": {"fullTextUrl": [{"url": "https://no"}]}}, {"doi": "10.1/X", "isOpenAccess": "Y", "fullTextUrlList": {"fullTextUrl": [{"availabilityCode": "S", "documentStyle": "pdf", "url": "https://paid"}, {"availabilityCode": "OA", "documentStyle": "html", "url": "https://page"}, {"availabilityCode": "F", "documentStyle": "pdf", "url": "https://pdf"}]}}]}}'
    got = forum.europe_pmc_locations(spark.createDataFrame([("k", epmc)], "key string, answer string")).collect()
    assert [tuple(r) for r in got] == [("k", "10.1/X", "https://pdf", "https://page")]
    s2 = '{"externalIds": {"DOI": "10.1/x"}, "openAccessPdf": {"url": "https://pdf"}, "url": "ftp://no"}'
    assert [tuple(r) for r in forum.semantic_scholar_locations(spark.createDataFrame([("k", s2), ("n", '{"doi": "10.1/y"}')], "key string, paper string")).collect()] == [("k", "10.1/x", "https://pdf", "https://pdf")]


def bundle(spark, files):
    return lint.masked_files(spark.createDataFrame(files, "bundle string, path string, text string")).cache()


def codes(df):
    return sorted((r["bundle"], r["line"], r["code"], r["severity"]) for r in df.collect())


def test_lint_of_files(spark):
    text = "\\documentclass[10pt, Final]{a}\n\\usepackage[final]{microtype, neurips}\n\\usepackage[final=false]{x}\n% \\cameraready\n\\author{Jane Roe}\n\\thanks{X}\nWe thank. Supported by NSF.\nOur code is at https://github.com/jroe/x .\nSee https://github.com/other/y .\n\\verb|TODO| \\vspace{-2pt}\nFIXME ??\n"
    f = bundle(spark, [("b", "m.tex", text), ("c", "m.tex", "\\author{Anonymous}\n\\begin{verbatim}\nTODO ??\n\\end{verbatim}\n\\begin{tabular}{l}\n1.5\n\\end{tabular}\n\\begin{tabular}{l}\n1.5 $\\pm$ 1\n\\end{tabular}")])
    assert codes(lint.final_mode(f)) == [("b", 1, "FINAL_MODE_IN_REVIEW", "error"), ("b", 2, "FINAL_MODE_IN_REVIEW", "error")]
    assert codes(lint.blindness(f)) == [("b", 5, "BLIND_AUTHOR_LEAK", "error"), ("b", 6, "BLIND_THANKS_LEAK", "error"), ("b", 7, "BLIND_FUNDING_LEAK", "error"), ("b", 8, "BLIND_URL_LEAK", "error"), ("b", 9, "BLIND_URL_LEAK", "warning")]
    assert codes(lint.form(f)) == [("b", 10, "LAYOUT_TAMPER", "error"), ("b", 11, "UNRESOLVED_REFERENCE", "error"), ("b", 11, "UNRESOLVED_TODO", "warning"), ("c", 5, "TABLE_MISSING_DISPERSION", "warning")]


def test_lint_of_references(spark):
    f = bundle(spark, [("b", "m.tex", "\\cite{a, b}\n\\ref{x} \\cref{y,z} \\label{y}\n\\bibliography{r}"), ("n", "m.tex", "\\citep[p.~2]{q}"), ("s", "m.tex", "\\nocite{*} \\bibitem{k} text \\cite{k}")])
    bibs = spark.createDataFrame([("b", "r.bib", "@article{a, crossref = {p}}\n@book{p, xdata={g}}\n@misc{g,}\n@misc{u,}\n@misc{u,}"), ("s", "r.bib", "@misc{never,}")], "bundle string, path string, text string")
    got = {(r["bundle"], r["code"], r["detail"]) for r in lint.references(f, bibs).collect()}
    assert got == {("b", "UNDEFINED_CITATION", "b"), ("b", "UNRESOLVED_REFERENCE", "x"), ("b", "UNRESOLVED_REFERENCE", "z"), ("b", "UNCITED_BIB_ENTRY", "u"), ("b", "DUPLICATE_BIB_KEY", "u"), ("n", "MISSING_BIBLIOGRAPHY", "citations without any entry")}
    assert {r["code"] for r in lint.references(f, bibs, style=True).where("detail = 'u'").collect()} == {"UNCITED_BIBLIOGRAPHY_ENTRY", "DUPLICATE_BIB_KEY"}


def test_lint_of_trees(spark):
    deep = [("d", f"f{i}.tex", f"\\input{{f{i + 1}}}") for i in range(19)] + [("d", "f19.tex", "end")]
    many = [("m", "main.tex", " ".join(f"\\input{{p{i}}}" for i in range(70)))] + [("m", f"p{i}.tex", "x") for i in range(70)]
    f = bundle(spark, [("c", "main.tex", "\\input{a}\n\\include{../up}\n\\input{gone}\n% \\input{hidden}"), ("c", "a.tex", "\\input{b.tex}"), ("c", "b.tex", "\\input{./a}"), *deep, *many])
    entries = spark.createDataFrame([("c", "main.tex"), ("d", "f0.tex"), ("m", "main.tex")], "bundle string, path string")
    got = {(r["bundle"], r["code"], r["detail"]) for r in lint.includes(f, entries).collect()}
    assert got == {("c", "UNSAFE_INCLUDE_PATH", "../up.tex"), ("c", "MISSING_INCLUDE", "gone.tex"), ("c", "INCLUDE_CYCLE", "a.tex"), ("c", "INCLUDE_CYCLE", "b.tex"), *(("d", "INCOMPLETE_COVERAGE", f"depth {i}") for i in (17, 18, 19)), ("m", "INCOMPLETE_COVERAGE", "71 files")}
    f = bundle(spark, [("x", "m.tex", "\\addbibresource{../a.bib}\n\\bibliography{there,gone}"), ("y", "m.tex", "none")])
    tree = spark.createDataFrame([("x", "there.bib", False), ("x", "link", True), ("y", "link", True), *(("y", f"{i}.bib", False) for i in range(40))], "bundle string, path string, link boolean")
    assert {(r["bundle"], r["code"], r["detail"]) for r in lint.bibliographies(f, tree).collect()} == {("x", "UNSAFE_BIB_PATH", "../a.bib"), ("x", "MISSING_BIBLIOGRAPHY", "gone.bib"), ("y", "UNSAFE_BIB_SYMLINK", "link"), ("y", "INCOMPLETE_COVERAGE", "40 bibliographies")}


def test_includes_of_all_forms(spark):
    main = "\n".join([r"\input{sec/a}", r"\include{sec/gone1}", r"\input sec/gone2", r'\input "sec/gone3.tex"', r"\subfile*[x=1]{gone4}", r"\import{sec/}{gone5}", r"\import*{sec}{b.tex}", r"\includegraphics[width=1]{../out.png}", r"\inputminted{py}{/abs.py}", r"\import{/etc/}{x}", r"\input{glyphtounicode}", r"\input{sec/../there}", r"\lstinputlisting{any/where.py}"])
    a = "\n".join([r"\input{b}", r"\subimport{deep/}{gone6}", r"\import{deep}{gone7}", r"\input{../../up}", r"\inputs{no}"])
    f = bundle(spark, [("t", "main.tex", main), ("t", "sec/a.tex", a), ("t", "sec/b.tex", "end"), ("t", "there.tex", "end")])
    got = {(r["path"], r["line"], r["code"], r["detail"]) for r in lint.includes(f, spark.createDataFrame([("t", "main.tex")], "bundle string, path string")).collect()}
    lost = {("main.tex", i, "MISSING_INCLUDE", d) for i, d in ((2, "sec/gone1.tex"), (3, "sec/gone2.tex"), (4, "sec/gone3.tex"), (5, "gone4.tex"), (6, "sec/gone5.tex"))} | {("sec/a.tex", i, "MISSING_INCLUDE", d) for i, d in ((2, "sec/deep/gone6.tex"), (3, "deep/gone7.tex"))}
    assert got == lost | {("main.tex", 8, "UNSAFE_INCLUDE_PATH", "../out.png"), ("main.tex", 9, "UNSAFE_INCLUDE_PATH", "/abs.py"), ("main.tex", 10, "UNSAFE_INCLUDE_PATH", "/etc/x.tex"), ("sec/a.tex", 4, "UNSAFE_INCLUDE_PATH", "../../up.tex")}


def test_references_without_semicolon():
    page = "<h1>a&amp;b &amp</h1><p>c &lt; &am</p>"
    assert docs.html_segments(page, closed=True) == [("html:block=1", "a&b &amp", "a&b &amp"), ("html:block=2", "c < &am", "a&b &amp")]
    assert docs.html_segments(page)[0] == ("html:block=1", "a&b &", "a&b &")


def test_body_pages_of_every_bundle(spark):
    pages = spark.createDataFrame([("under", 1, "a"), ("under", 2, "References\n[1]"), ("shared", 1, "a"), ("shared", 2, "b\nReferences"), ("bare", 1, "a"), ("bare", 2, "b"), ("bare", 3, "c")], "bundle string, page int, text string")
    assert {tuple(r) for r in lint.body_pages(pages).collect()} == {("under", 1), ("shared", 2), ("bare", 3)}


def test_page_limits_has_a_row_a_part(spark):
    from attesta.plans import registry

    rows = registry.queries()["page_limits"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count() == len({r["p_partkey"] for r in rows})
    assert {r["code"] for r in rows} == {None, "PDF_PAGE_LIMIT_EXCEEDED"}


def test_lint_of_pages_and_sections(spark):
    venues = spark.createDataFrame([(b, ["Limitations"], True, 2) for b in ("ok", "over", "shared", "gone", "bad")], "bundle string, required_sections array<string>, forbids_geometry boolean, max_pages int")
    reads = spark.createDataFrame([("ok", "ok"), ("over", "ok"), ("shared", "ok"), ("gone", "missing"), ("bad", "failed")], "bundle string, status string")
    pages = spark.createDataFrame([("ok", 1, "prose"), ("ok", 2, "prose"), ("ok", 3, "Page 3 of 9\n7. References\n[1]"), ("over", 1, "a"), ("over", 2, "a"), ("over", 3, "a"), ("shared", 1, "a"), ("shared", 2, "a"), ("shared", 3, "Real prose.\nReferences\n[1]")], "bundle string, page int, text string")
    assert codes(lint.page_limits(reads, pages, venues)) == [("bad", 1, "PDF_CHECK_FAILED", "error"), ("gone", 1, "MISSING_PDF", "error"), ("over", 1, "PDF_PAGE_LIMIT_EXCEEDED", "error"), ("shared", 1, "PDF_PAGE_LIMIT_EXCEEDED", "error")]
    f = bundle(spark, [("ok", "m.tex", "\\begin{abstract}a\\end{abstract}\\section{Limitations of it}"), ("over", "m.tex", "\\section*{Abstract}\\usepackage{geometry, x}")])
    assert [x[2] for x in codes(lint.structure(f, venues))] == ["FORBIDDEN_PACKAGE", "MISSING_REQUIRED_SECTION"]


def test_lint_of_bindings(spark):
    f = bundle(spark, [("g", "m.tex", "It gains 3\\%. % ark:claim=a\nIt loses 3%. % ark:claim=a\nx % ark:claim=zz\nIt improves by 4 points."), ("n", "m.tex", "y % ark:claim=a\n50% off")])
    graphs = spark.createDataFrame([("g", 2, 1)], "bundle string, dangling int, errors int")
    anchors = spark.createDataFrame([("g", "a", "eligible", "It gains 3%")], "bundle string, claim string, anchor string, text string")
    assert codes(lint.bindings(f, graphs, anchors)) == [("g", 1, "CEG_DANGLING_EDGES", "error"), ("g", 1, "CEG_SEMANTIC_ERROR", "error"), ("g", 2, "CEG_CLAIM_TEXT_MISMATCH", "warning"), ("g", 3, "INVALID_CEG_BINDING", "error"), ("n", 1, "UNVERIFIED_CEG_ANCHOR", "warning")]
    strict = codes(lint.bindings(f, graphs, anchors, strict=True))
    assert ("g", 1, "CEG_CLAIM_TEXT_MISMATCH", "error") in strict and ("g", 4, "UNGROUNDED_QUANT_CLAIM", "error") in strict and ("n", 1, "UNGROUNDED_QUANT_CLAIM", "error") in strict
    used = {c for c in lint.CODES}
    assert len(used) == 36


def test_checklist(spark):
    full = {s: "pass" for s in state.STAGES}
    papers = {
        "all": full, "waived": full | {"model-weights": "skipped!"}, "unwaived": full | {"model-weights": "skipped"}, "mismatch": full | {"dataset": "mismatch"}, "nocode": full | {"code-link": "missing"}, "broken": full | {"build-install": "fail"},
        "direction": full | {"metric-diff": "fail"}, "runs": full | {"measured-metrics": "unknown"}, "unchecked": {k: v for k, v in full.items() if k != "smoke-run"}, "stranger": full | {"identity": "fail"}, "wrongrepo": full | {"repo-identity": "mismatch"},
    }
    rows = [(p, s, v.rstrip("!"), v.endswith("!")) for p, stages in papers.items() for s, v in stages.items()]
    got = {r["paper"]: (r["verdict"], r["tier"]) for r in state.checklist(spark.createDataFrame(rows, "paper string, stage string, status string, waived boolean")).collect()}
    assert got == {
        "all": ("reproducible", "numbers-reproduced"), "waived": ("reproducible", "numbers-reproduced"), "unwaived": ("partially-reproducible", "numbers-reproduced"), "mismatch": ("inconsistent", "numbers-reproduced"), "nocode": ("blocked", "no-code-found"),
        "broken": ("blocked", "environment-broken"), "direction": ("partially-reproducible", "direction-reproduced"), "runs": ("partially-reproducible", "runs"), "unchecked": ("blocked", None), "stranger": ("blocked", None), "wrongrepo": ("inconsistent", "no-code-found"),
    }


def test_statements_and_footnotes():
    same = [("It improves accuracy by 3%", r"It \textbf{improves} accuracy by $3\%$ \cite{a}."), ("A beats B by 40 ms", "A beats B by 40 milliseconds"), ("p <= 0.05 holds", r"$p \leq 0.05$ holds")]
    other = [("It improves by 3%", "It reduces by 3%"), ("A beats B by 4", "B beats A by 4"), ("x is not y", "x is y"), ("gain of 3%", "gain of 3 ms"), ("a is 3 while b is 4", "a is 3 and b is 4"), (r"\sqrt{40} wins", "40 wins"), ("falls by -2", "falls by 2")]
    assert not any(tex.says_otherwise(a, b) for a, b in same) and all(tex.says_otherwise(a, b) for a, b in other)
    assert tex.paired_footnotes("One a\\footnotemark[2]. Two b\\footnotemark. % \\footnotetext{no}\n\\footnotetext[2]{first} \\footnotetext{second {x}} \\footnotetext{third}") == [("first", "One a."), ("second {x}", "Two b."), ("third", "Two b.")]
    assert tex.paired_footnotes("\\footnotetext{alone}") == [("alone", None)]
    assert tex.masked("a \\verb|%x| b % c\n\\begin{verbatim}\n%in\n\\end{verbatim} 5\\% x") == "a  b \n\\begin{verbatim}\n\n\\end{verbatim} 5\\% x"


def test_unclosed_html():
    page = "<p>one<p>two</p><ul><li>a<p>in<li>b</ul><p>tail <b>x</b><table id=t><tr><td>a<td>b<tr><td>c</table><h2>H</h2></div><script>no<p>no</script><pre> y\n z"
    assert docs.html_segments(page) == [("html:block=1", "one", ""), ("html:block=2", "two", ""), ("html:block=3", "in", ""), ("html:block=4", "tail x", ""), ("html:id=t", "; | a | b ; | c", ""), ("html:block=6", "H", "H"), ("html:block=7", "y z", "H")]
    with pytest.raises(ValueError, match="little"):
        docs.parse_html(b"<p>short</p>", article=True)
    body = b"<h1>Title</h1><p>" + b"word " * 200 + b"</p>"
    with pytest.raises(ValueError, match="section"):
        docs.parse_html(body, article=True)
    with pytest.raises(ValueError, match="challenge"):
        docs.parse_html(b"<p>Just a moment</p><h2>Results</h2>" + body, article=True)
    assert len(docs.parse_html(b"<h2>Methods</h2>" + body, article=True)) == 3


def test_columns(spark):
    d = spark.createDataFrame([('x {"a": {"b": 1}} {"c": 2}', 'set {x} then {"k": [1]} end', "none {")], "a string, b string, c string").select(*[T.first_json_object(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(d) == ('{"a": {"b": 1}}', '{"k": [1]}', None)
    d = spark.createDataFrame([('{"b":1, "a":"é"}', "no", "e\u0301  x ")], "a string, b string, c string").select(T.canonical_json("a"), T.canonical_json("b"), T.nfc_compact("c")).first()
    assert tuple(d) == ('{"a":"é","b":1}', None, "\u00e9 x")
