"""Hand-checked values and invariants of the operators outside the llm package."""

import io
import random
import subprocess
import sys
import zipfile
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import special
from attesta.functions import text as T
from attesta.operators import cohort, corpus, deliberate, graph, lineage, meta, recompute
from attesta.operators.components import connected_components
from attesta.sources import documents as docs
from attesta.sources import markup
from attesta.streaming import watch

ROOT = Path(__file__).resolve().parent.parent


def test_tails():
    assert special.t_p(2.0, 30) == pytest.approx(0.05462504496298312, abs=1e-14)
    assert special.chi2_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert special.f_p(4.0, 1, 10) == pytest.approx(special.t_p(2.0, 10), abs=1e-13)
    assert special.normal_p(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert special.power_t(0.5, 64, 64) == pytest.approx(0.8014596, abs=1e-5)
    assert special.required_n(0.5) == 64
    assert np.isnan(special.t_p(1.0, 0)) and np.isnan(special.chi2_p(-1.0, 2))


@settings(max_examples=40, deadline=None)
@given(st.floats(0.1, 50), st.floats(0.1, 50), st.floats(1e-3, 0.999))
def test_beta_is_symmetric(a, b, x):
    assert special.beta_inc(a, b, x) + special.beta_inc(b, a, 1 - x) == pytest.approx(1, abs=1e-9)


def studies(spark, rows):
    return spark.createDataFrame([("a", str(i), y, v) for i, (y, v) in enumerate(rows)], "analysis string, study_id string, yi double, vi double")


def test_meta(spark):
    s = studies(spark, [(0.2, 0.05), (0.5, 0.05), (0.8, 0.05)])
    h = meta.heterogeneity(s, ["analysis"]).first()
    assert (h["q"], h["df"], h["i2"], h["tau2"]) == (pytest.approx(3.6), 2, pytest.approx(1.6 / 3.6), pytest.approx(0.04))
    p = meta.pool(s, ["analysis"], random=True).first()
    assert p["estimate"] == pytest.approx(0.5) and p["se"] == pytest.approx(0.03**0.5)
    assert meta.leave_one_out(s, ["analysis"]).count() == 3
    assert meta.trim_and_fill(s, ["analysis"]).first()["missing"] == 0
    assert meta.trim_and_fill(studies(spark, [(0.2, 0.05)]), ["analysis"]).first()["missing"] is None


def test_rounding(spark):
    d = spark.createDataFrame([("0.05", 0.0549, True), ("0.05", 0.055, False), ("0.050", 0.0506, False), ("0.05", 0.045, True), ("junk", 0.1, None)], "p string, r double, ok boolean")
    assert all(x[0] == x[1] for x in d.select(recompute.p_matches(F.col("p"), F.col("r")), "ok").collect())


def records(spark, ratings):
    return spark.createDataFrame([(i, "s", "a", r) for i, r in enumerate(ratings)], "id long, status string, area string, ratings array<double>")


def test_cohort(spark):
    r = cohort.venue_summary(cohort.scored(records(spark, [[2.0] * 4, [3.0, 4.0, 5.0]]))).first()
    assert (r["scored"], r["unanimous"], r["unanimous_share"]) == (2, 1, 0.5)
    r = cohort.venue_summary(cohort.scored(records(spark, [[0.0, 0.0, 2.0], []]))).first()
    assert (r["reviews"], r["mean_of_means"], r["anomalies"], r["submissions"]) == (1, 2.0, 2, 2)
    slots = spark.createDataFrame([("4;6;;8;nan;x",)], "s string").select(cohort.parse_slots(F.col("s")).alias("a"), cohort.parse_slots(F.col("s"), True).alias("b")).first()
    assert slots["a"] == [4, 6, 8] and slots["b"] == [4, 6, None, 8, None, None]
    s = spark.createDataFrame([("Not accepted",), ("Accept (Oral)",), (None,), ("Desk rejected",)], "s string").select(cohort.classify_status(F.col("s"))).collect()
    assert [x[0] for x in s] == ["unknown", "accepted", "unknown", "rejected_or_unaccepted"]


def test_diamonds_and_cycles(spark):
    edges = [(f"{i}{a}", f"{i - 1}{b}") for i in range(1, 26) for a in "xy" for b in "xy"]
    e = spark.createDataFrame(edges, "child string, parent string")
    assert graph.closure(e, spark.createDataFrame([("25x",)], "node string")).count() == 50
    assert lineage.levels(e).agg(F.max("level")).first()[0] == 25
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "a")], "child string, parent string")
    assert {r[0] for r in lineage.cyclic(loop).collect()} == {"a", "b", "c"}


def test_components_of_a_chain(spark):
    n = 200
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    got = connected_components(spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7, 7)], "u long, v long")).collect()
    assert {r["label"] for r in got if r["node"] < n} == {0} and len(got) == n + 2
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_merge_is_order_free(spark):
    rows = [("l1", "k", "Title", 2001, 5, 0.5), ("l2", "k", "Title!", 2000, 9, None), ("l1", None, "x", 1, 1, 1.0)]
    schema = "layer string, key string, title string, year int, citations int, relevance double"
    a, b = (corpus.merge_layers(spark.createDataFrame(r, schema), "key").collect() for r in (rows, rows[::-1]))
    assert a == b and a[0]["title"] == "Title!" and a[0]["layers"] == ["l1", "l2"]


def test_deduplicate(spark):
    rows = [(1, "10.1000/a", "One title", ["Doe, A"], 2000), (2, "doi:10.1000/A", "Other", ["Roe, B"], 2001), (3, None, "One Title", ["doe a"], None), (4, None, "one title", ["Poe, C"], 2000), (5, None, None, [], None)]
    got = {r["pos"]: (r["fate"], r["of"]) for r in corpus.deduplicate(spark.createDataFrame(rows, "pos long, doi string, title string, authors array<string>, year int")).collect()}
    assert got == {1: ("kept", None), 2: ("duplicate_doi", 1), 3: ("duplicate_title", 1), 4: ("candidate", 1), 5: ("kept", None)}


def test_deduplicate_is_first_come(spark):
    """Against a walk through the works in order: chains, hot titles, missing years and authors, repeated positions of a class."""
    rng = random.Random(7)
    rows = [(i, f"10.1000/{rng.randrange(12)}" if rng.random() < 0.3 else None, rng.choice(["One title", "other  TITLE", "", None]), rng.sample(["Doe A", "Roe B", "Poe C", "王"], rng.randint(0, 2)), rng.choice([None, 2000, 2001])) for i in range(160)]
    want, seen, kept = {}, {}, {}
    for pos, doi, title, authors, year in rows:
        if doi in seen:
            want[pos] = ("duplicate_doi", seen[doi])
            continue
        if doi:
            seen[doi] = pos
        t = (title or "").lower().split()
        if not t:
            want[pos] = ("kept", None)
            continue
        before = kept.setdefault(tuple(t), [])
        same = [p for p, a, y in before if set(a) & set(authors) and (y is None or year is None or y == year)]
        want[pos] = ("duplicate_title", same[0]) if same else ("candidate", before[0][0]) if before else ("kept", None)
        if not same:
            before.append((pos, authors, year))
    got = corpus.deduplicate(spark.createDataFrame(rows, "pos long, doi string, title string, authors array<string>, year int")).collect()
    assert {r["pos"]: (r["fate"], r["of"]) for r in got} == want and len(got) == len(rows)


def test_identifiers(spark):
    cases = {"https://doi.org/10.1234/AB.": ("doi", "10.1234/ab"), "arXiv:2101.00001v3": ("arxiv", "2101.00001v3"), "PMID: 77": ("pmid", "77"), "nothing": ("unknown", None), "W123": ("openalex", "W123"), "https://openalex.org/A5023888391": ("openalex", "A5023888391"), "PMID:123456789": ("pmid", "123456789"), "123456": ("pmid", "123456"), "doi:10.1/x": ("unknown", None), None: ("unknown", None)}
    d = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.identifier(F.col("s")).alias("i")).collect()
    assert all((r["i"]["type"], r["i"]["value"]) == cases[r["s"]] for r in d)


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 6).flatmap(lambda n: st.lists(st.lists(st.integers(0, 20), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_derangement(w):
    from itertools import permutations

    w = np.array(w, float)
    to = deliberate.best_derangement(w)
    best = max(sum(w[i, p[i]] for i in range(len(w))) for p in permutations(range(len(w))) if all(i != x for i, x in enumerate(p)))
    assert sorted(to) == list(range(len(w))) and all(i != x for i, x in enumerate(to)) and w[np.arange(len(w)), to].sum() == pytest.approx(best)


def observation(seq, status, signals=(), complete=True, arrival=None):
    return {"watcher": "w", "item_key": "k", "seq": seq, "arrival": arrival if arrival is not None else seq, "status": status, "signals": list(signals), "signals_complete": complete, "truncated": False, "error": None}


OBS = "watcher string, item_key string, seq long, arrival long, status string, signals array<string>, signals_complete boolean, truncated boolean, error string"


def test_watch_rules():
    s = watch.blank()
    assert watch.step(s, observation(1, "not_retracted", ["a"])) == ("applied", True)
    assert watch.step(s, observation(5, "unknown")) == ("applied", False) and s["current"] == "unknown" and s["confirmed"] == "not_retracted"
    assert watch.step(s, observation(3, "retracted", ["b"])) == ("applied", True) and s["current"] == "unknown" and s["confirmed"] == "retracted" and s["signals"] == ["a", "b"]
    assert watch.step(s, observation(2, "not_retracted"))[0] == "stale_ignored" and watch.step(s, observation(4, "unknown"))[0] == "stale_ignored"
    assert s["applied"] == 5 and s["version"] == 2


def by_hand(rows):
    """Requests served one after the other: outcomes by arrival, and the state of each key."""
    states, commits, boxes, out = {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: r["arrival"]):
        k = r["item_key"]
        s, seen, box = states.setdefault(k, watch.blank()), commits.setdefault(k, {}), boxes.setdefault(k, [])
        if r.get("op", "commit") == "reserve":
            s["reserved"] += 1
            out[r["arrival"]] = [("reserved", s["reserved"], s["version"])]
        elif r.get("op") == "drain":
            out[r["arrival"]] = [("delta", q, v) for q, v in box]
            box.clear()
        else:
            what = (r["status"], tuple(sorted(set(r["signals"]))), r["signals_complete"], r["truncated"], r["error"])
            if r["seq"] in seen:
                outcome = "replayed" if seen[r["seq"]] == what else "conflict"
                s["replays" if outcome == "replayed" else "conflicts"] += 1
            else:
                seen[r["seq"]] = what
                outcome, changed = watch.step(s, r)
                if changed:
                    box.append((r["seq"], s["version"]))
            out[r["arrival"]] = [(outcome, r["seq"], s["version"])]
    return out, states


def test_outbox_takes_each_change_once(spark, tmp_path):
    rows = [("w", f"k{i}", True, v) for i in range(20) for v in (1, 2)]
    out = spark.createDataFrame(rows + [("w", "no", False, 1)], "watcher string, item_key string, changed boolean, version long")
    for part in (out.where("version = 1"), out, out):
        watch.drain(part, str(tmp_path / "outbox"))
    assert sorted((r["item_key"], r["version"]) for r in spark.read.parquet(str(tmp_path / "outbox")).collect()) == sorted((k, v) for _, k, _, v in rows)


def requests(rng, n):
    """Commits with replays and conflicts of numbers of any age, reservations and drains."""
    rows = []
    for arrival in range(n):
        r = observation(rng.randrange(n // 2), rng.choice(["retracted", "not_retracted", "unknown"]), rng.sample("abc", rng.randrange(3)), rng.random() < 0.5, arrival) | {"item_key": rng.choice("kl"), "op": rng.choice(["commit"] * 6 + ["reserve", "drain"])}
        before = [x for x in rows if x["item_key"] == r["item_key"] and x["op"] == "commit"]
        if before and rng.random() < 0.3:
            r = rng.choice(before) | {"arrival": arrival}
        rows.append(r if r["op"] == "commit" else r | {"seq": None})
    return rows


def test_stream_serves_as_one_by_one_and_restarts(spark, tmp_path):
    rows = requests(random.Random(2), 60)
    schema = OBS + ", op string"
    want, _ = by_hand(rows)
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in (rows[:20], rows[20:40], rows[40:]):  # each time a new query goes on from the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = watch.serve(source()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r["arrival"], []).append((r["outcome"], r["seq"], r["version"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert {x[0] for v in got.values() for x in v} == {"reserved", "delta", "applied", "replayed", "conflict", "stale_ignored"}


def test_batch_is_as_one_by_one(spark):
    """Replays and conflicts of numbers of any age, without a map in any task."""
    rows = [r for r in requests(random.Random(5), 400) if r["op"] == "commit"]
    _, states = by_hand(rows)
    got = watch.fold(spark.createDataFrame(rows, OBS + ", op string")).collect()
    assert {r["item_key"]: (r["current_status"], r["confirmed"], r["signals"], r["applied"], r["version"], r["stale"], r["replays"], r["conflicts"]) for r in got} == {k: (s["current"], s["confirmed"], s["signals"], s["applied"], s["version"], s["stale"], s["replays"], s["conflicts"]) for k, s in states.items()}
    assert watch.fold(spark.createDataFrame([], OBS)).count() == 0


def _zip(**files):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return buf.getvalue()


def test_parsers(spark):
    html = b"<h1>Methods</h1><script>x</script><p id='a'>One  two</p><table><tr><td>1</td><td>2</td></tr></table>"
    assert docs.parse_html(html) == [("html:block=1", "Methods", "Methods"), ("html:id=a", "One two", "Methods"), ("html:block=3", "; | 1 | 2", "Methods")]
    jats = b"<!DOCTYPE a><article><front><article-title>T</article-title></front><body><sec><title>R</title><p id='p1'>Text<list><list-item><p>in</p></list-item></list></p><table-wrap><label>Tab 1</label><table><tr><td>1</td><td>2</td></tr></table></table-wrap></sec></body></article>"
    given = lambda *contents: spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(contents)], "document_id string, content binary")
    read = lambda df: sorted((r["document_id"], r["locator"], r["text"], r["section"]) for r in df.where("status = 'ok'").collect())
    assert read(markup.article_segments(given(jats))) == sorted([("0", "xml:block=1", "T", ""), ("0", "xml:id=p1", "Textin", "R"), ("0", "xml:block=3", "in", "R"), ("0", "xml:block=4", "Tab 1 ; 1 | 2", "R")])
    bad = (b"<article/>", b"<a", b"<!DOCTYPE a [<!ENTITY x 'y'>]><article><body>&x;</body></article>", b"<article><body> </body></article>", b"<book><body>x</body></book>", b"")
    assert {(r["document_id"], r["status"]) for r in markup.article_segments(given(*bad)).collect()} == {(str(i), "failed") for i in range(len(bad))}
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "<w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl>"
    word = _zip(**{"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'})
    assert read(markup.word_segments(given(word))) == [("0", "docx:paragraph=1", "Hi", ""), ("0", "docx:paragraph=2", "c1", ""), ("0", "docx:table=1", "c1 |", "")]
    book = '<workbook xmlns:r="u"><sheets><sheet name="Main" r:id="i2"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="i2" Target="worksheets/s.xml"/></Relationships>'
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c><c/></row><row r="2"/></sheetData></worksheet>'
    made = lambda **more: _zip(**({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": "<sst><si><t>Name</t></si></sst>", "xl/worksheets/s.xml": sheet} | more))
    out = made(**{"xl/_rels/workbook.xml.rels": rels.replace("worksheets", "../..")})
    got = markup.workbook_segments(given(made(), out, _zip(**{"../x": "y"}), b"junk"))
    assert read(got) == [("0", "xlsx:sheet=Main:row=1", "A1=Name | B1=2 [formula=1+1; cached value only] | C1=in | ?=", "Main")]
    assert {r["document_id"]: r["error"] for r in got.where("status = 'failed'").collect()} == {"1": "a sheet outside the archive", "2": "archive member outside its root", "3": "File is not a zip file"}
    assert docs.parse_tex(b"\\section{Intro}\nWord 1 % gone\n\n\\begin{abstract}A\n\nb\\end{abstract} \\begin{table*}x\\end{table*}") == [("tex:block=1", "\\section{Intro} Word 1", "Intro"), ("tex:abstract=1", "\\begin{abstract}A b\\end{abstract}", "Intro"), ("tex:table=1", "\\begin{table*}x\\end{table*}", "Intro")]
    assert docs.parse_bibliography(b"@article{a, title={x}}\n  @book{b,\n y=1}\n") == [("bib:entry=a", "@article{a, title={x}}", "Bibliography"), ("bib:entry=b", "@book{b, y=1}", "Bibliography")]
    assert [x[0] for x in docs.parse_bibliography(b"\\bibitem{k} foo\n\\bibitem[z]{l} bar\\end{thebibliography}")] == ["bib:entry=k", "bib:entry=l"] and docs.parse_bibliography(b"\nplain")[0][0] == "bib:line=2"
    assert docs.parse_bibliography(b"@a{k, note={mail @me{x, } here},\n url={http://x/@b{c,}}}\n@string{z = {q}}\n@b{l,}")[0][1] == "@a{k, note={mail @me{x, } here}, url={http://x/@b{c,}}}"
    got = docs.segments(spark.createDataFrame([("a", "txt", b"x\n\ny"), ("b", "docx", b"junk"), ("c", "exe", b""), ("d", "txt", None)], "document_id string, suffix string, content binary")).collect()
    assert {(r["document_id"], r["status"], r["locator"]) for r in got} == {("a", "ok", "text:line=1"), ("a", "ok", "text:line=3"), ("b", "failed", None), ("c", "failed", None)}


def test_runs_without_llm(tmp_path):
    """Nothing outside imports the llm package: the rest loads with both taken away."""
    import shutil

    for name in ("attesta", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    n, ops = out.stdout.split()
    assert int(n) > 100 and ops == "False"
    for path in (ROOT / "attesta").rglob("*.py"):
        if "llm" not in path.parts:
            assert "attesta.llm" not in path.read_text(), path
