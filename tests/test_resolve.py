"""Resolution, merging, order statistics and schemas against brute force."""

import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from attesta.functions import schema
from attesta.operators import cohort, resolve, selection

WORKS = "layer string, doi string, openalex string, title string, year int, citations long, relevance double, authors array<string>, abstract string, cited array<string>"


def judged(records, ids):
    """One batch: records {name: (title, authors, year)}, ids [(name, kind, value)] with values that are normal already."""
    by_kind = {k: {v for _, kk, v in ids if kk == k} for k in {k for _, k, _ in ids}}
    holders = {(k, v): {n for n, kk, vv in ids if (kk, vv) == (k, v)} for _, k, v in ids}
    groups = [{n} for n in records]
    for own in holders.values():
        met = [g for g in groups if g & own]
        groups = [g for g in groups if g not in met] + [set().union(*met)]
    shared = sorted({k for (k, _), own in holders.items() if len(own) > 1})
    against = sorted(k for k, v in by_kind.items() if len(v) > 1)
    titles, authors, years = ([r[i] for r in records.values()] for i in range(3))
    same = [all(titles) and len(set(titles)) == 1, all(authors) and len({frozenset(a) for a in authors}) == 1, all(years) and len(set(years)) == 1]
    near = any(x and y and len(set(x.split()) & set(y.split())) >= 0.5 * len(set(x.split()) | set(y.split())) for x, y in combinations(titles, 2)) or any(set(x) & set(y) for x, y in combinations(authors, 2))
    if against:
        verdict = "CONFLICT"
    elif shared and len(groups) == 1:
        verdict = "EXACT"
    elif len(records) == 1:
        verdict = "EXACT" if ids else "UNRESOLVED"
    else:
        verdict = "STRONG_MATCH" if same[0] and same[1] else "CANDIDATE" if near else "UNRESOLVED"
    match = sorted({*shared, *(n for n, on in zip(("title", "authors", "year"), same, strict=True) if on)})
    conflict = sorted({*against, *(n for n, v in (("title", titles), ("year", years)) if len({x for x in v if x}) > 1)})
    return verdict, match, conflict, bool(shared) and len(groups) > 1


def test_resolution(spark):
    rng = random.Random(4)
    rows, ids, want = [], [], {}
    for batch in range(150):
        own = {f"r{i}": (rng.choice(["deep nets", "deep nets", "deep nets again", "日本 語", "other words here", None]), rng.choice([["ann"], ["ann"], ["bo", "cy li"], ["bo"], []]), rng.choice([2000, 2000, 2001, None])) for i in range(rng.randrange(1, 5))}
        links = [(n, k, rng.choice("12" if rng.random() < 0.2 else "1")) for n in own for k in ("pmid", "isbn", "x") if rng.random() < 0.15]
        want[batch] = judged(own, links)
        rows += [(batch, n, "Work", t and f" {t.upper()}! ", [a.title() for a in au] or None, y) for n, (t, au, y) in own.items()]
        ids += [(batch, n, k, v) for n, k, v in links]
    got = resolve.resolve(spark.createDataFrame(rows, "batch long, record string, object_type string, title string, authors array<string>, year int"), spark.createDataFrame(ids, "batch long, record string, kind string, value string")).collect()
    found = {r["batch"]: (r["verdict"], r["match_fields"], r["conflict_fields"], r["partial"]) for r in got}
    assert {b: (found[b], want[b]) for b in want if found[b] != want[b]} == {}
    assert {v[0] for v in want.values()} == {"CONFLICT", "EXACT", "STRONG_MATCH", "CANDIDATE", "UNRESOLVED"}


def test_merging_does_not_depend_on_order(spark):
    """An id joins its DOI until a second DOI comes up for it; both ways round, and over several ids."""
    rows = [
        ("a", "10.1/X", "https://openalex.org/W1", "Short", 2001, 5, None, ["x"], None, None), ("b", None, "W1", "Longer title", 2000, 7, 0.5, ["x", "y"], " ", ["q"]), ("b", "doi:10.1/x", "W2", None, None, None, 0.7, None, "abs", None), ("c", None, "W2", "T", 2005, None, None, ["z"], "abstract", None),
        ("a", "10.1/p", "W3", "P", 1999, None, None, None, None, None), ("a", "10.1/q", "W3", "Q", 1999, None, None, None, None, None), ("a", None, "W3", "R", 1998, None, None, None, None, None), ("a", None, None, "Only a Title", 1990, 1, None, None, None, None), ("d", None, None, "only a title!", 1990, 2, None, None, None, None), ("a", None, " ", " ", 1990, None, None, None, None, None),
    ]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        seen.add(repr(sorted(map(tuple, resolve.merge_candidates(spark.createDataFrame(rows, WORKS)).collect()), key=repr)))
    assert len(seen) == 1
    got = {r["key"]: r for r in resolve.merge_candidates(spark.createDataFrame(rows, WORKS)).collect()}
    assert set(got) == {"doi:10.1/x", "doi:10.1/p", "doi:10.1/q", "openalex:W3", "title:only a title#1990"}
    x = got["doi:10.1/x"]
    assert (x["title"], x["year"], x["citations"], x["relevance"], x["authors"], x["abstract"], x["cited"], x["layers"], x["merged"], x["openalex"]) == ("Longer title", 2000, 7, 0.7, ["x", "y"], "abstract", ["q"], ["a", "b", "c"], 4, "W1")
    assert resolve.unidentifiable(spark.createDataFrame(rows, WORKS)).first()["skipped"] == 1


def test_order_statistics(spark):
    """Against sorting, with ties, both infinities, subnormals and null groups; and one group of a million."""
    rng = random.Random(3)
    groups = {"a": [rng.random() for _ in range(501)], "b": [1.0] * 40 + [2.0] * 41, None: [float("inf"), -1e308, 1e308, 5e-324, 0.0, -5e-324], "d": [7.0], "e": [rng.choice([1e-300, 1e300, 3.0]) for _ in range(200)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)], "g string, v double")
    middle = lambda vs: (sorted(vs)[(len(vs) - 1) // 2] + sorted(vs)[len(vs) // 2]) / 2
    assert {r["g"]: r["median"] for r in selection.medians(df, ["g"], "v").collect()} == {g: middle(vs) for g, vs in groups.items()}
    got = {(r["g"], r["p"]): r["value"] for r in selection.nearest_ranks(df, ["g"], "v", [0.1, 0.75]).collect()}
    assert got == {(g, p): sorted(vs)[round((len(vs) - 1) * p)] for g, vs in groups.items() for p in (0.1, 0.75)}
    many = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003 / 3.0).alias("v"))
    assert selection.medians(many, [], "v").first()[0] == pytest.approx(many.agg(F.median("v")).first()[0])


def test_first_rows_of_a_hot_key(spark):
    rows = spark.range(1_000_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string"))).alias("k"), (F.col("id") * 7 % 1_000_003).alias("n"))
    got = cohort.first_seen(rows, "k", ["n"])
    want = rows.groupBy("k").agg(F.min("n").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_schema_keywords(spark):
    """Each keyword on documents that keep and break it."""
    cases = [
        ({"type": "integer"}, [3, 3.0, -1], [(3.5, "type"), ("3", "type"), (True, "type"), (None, "type")]), ({"type": ["string", "null"]}, ["", None], [(1, "type"), ([], "type")]), ({"enum": [1, "a", None, [1], {"b": 2}]}, [1, 1.0, "a", None, [1], {"b": 2}], [(True, "enum"), ("1", "enum"), ([1, 1], "enum")]),
        ({"const": "x"}, ["x"], [("X", "const")]), ({"minLength": 2, "maxLength": 3, "pattern": "^[a-zé]"}, ["éé", "abc", 7], [("a", "minLength"), ("abcd", "maxLength"), ("1ab", "pattern")]), ({"minimum": 1, "exclusiveMaximum": 3}, [1, 2.99, "x"], [(0, "minimum"), (3, "exclusiveMaximum")]),
        ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[1], [{"a": 1, "b": 2}, {"b": 1, "a": 2}], {}], [([], "minItems"), ([1, 2, 3], "maxItems"), ([{"a": 1, "b": 2}, {"b": 2, "a": 1}], "uniqueItems")]), ({"minProperties": 1}, [{"a": None}, []], [({}, "minProperties")]), ({"required": ["a"]}, [{"a": None}, []], [({"b": 1}, "required:a")]),
        ({"properties": {"a": {"type": "null"}}, "patternProperties": {"^x": {"type": "string"}}, "additionalProperties": False}, [{"a": None, "xy": ""}], [({"b": 1}, "additionalProperties:b"), ({"x": 1}, "type"), ({"a": 1}, "type")]), ({"additionalProperties": {"maximum": 1}}, [{"q": 1}], [({"q": 2}, "maximum")]),
        ({"propertyNames": {"pattern": "^[a-z]+$"}}, [{"ab": 1}], [({"A": 1}, "pattern")]), ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["s", 6], [(1, "anyOf")]), ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, [1], [(6, "oneOf")]), ({"not": {"type": "array"}}, [{}], [([], "not")]), ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1], [(3, "maximum")]),
        ({"if": {"required": ["k"]}, "then": {"required": ["v"]}, "else": {"maxProperties": 1}}, [{"k": 1, "v": 1}, {"x": 1}], [({"k": 1}, "required:v"), ({"x": 1, "y": 2}, "maxProperties")]), ({"$ref": "#/$defs/t", "$defs": {"t": {"properties": {"k": {"items": {"$ref": "#/$defs/n"}}}}, "n": {"type": "number"}}}, [{"k": [1, 2]}, {"k": "no"}], [({"k": [1, "x"]}, "type")]),
    ]
    for one, good, bad in cases:
        rows = [(json.dumps(d), None) for d in good] + [(json.dumps(d), rule) for d, rule in bad]
        got = spark.createDataFrame(rows, "d string, want string").select("d", "want", schema.findings(F.col("d"), one).alias("f")).collect()
        assert all([x["rule"] for x in r["f"]] == ([r["want"]] if r["want"] else []) for r in got), (one, got)
    tree = {"type": "object", "properties": {"sub": {"$ref": "#"}}, "required": ["n"]}
    deep = lambda k: {"n": 0, **({"sub": deep(k - 1)} if k else {})}
    f = schema.findings(F.col("d"), tree, most_refs=3)
    got = spark.createDataFrame([(json.dumps(deep(3)),), (json.dumps(deep(4)),), ("{no",), (None,)], "d string").select(f.alias("f")).collect()
    assert [None if r["f"] is None else [tuple(x) for x in r["f"]] for r in got] == [[], [("sub/sub/sub/sub", "$ref")], [("<root>", "json")], None]
    other = schema.findings(F.col("d"), {"$ref": "urn:x/part.json#/definitions/p"}, {"part.json": {"definitions": {"p": {"type": "string"}}}})
    assert [len(r[0]) for r in spark.createDataFrame([('"s"',), ("1",)], "d string").select(other).collect()] == [0, 1]


def test_schema_parses_a_text_once(spark):
    one = {"type": "object", "required": ["a"], "properties": {"a": {"type": "object", "properties": {"b": {"type": "integer"}}}}}
    found = spark.range(1).select(schema.findings(F.col("id").cast("string"), one).alias("f"))
    assert found._jdf.queryExecution().analyzed().toString().count("parse_json") == 1


def test_similar_titles_by_brute_force(spark):
    from attesta.operators import corpus

    rng = random.Random(5)
    titles = [" ".join(rng.sample("a b c d e f g h i j k l".split(), rng.randint(1, 9))) for _ in range(150)]
    sets = [frozenset(x.split()) for x in titles]
    first = {w: i for i, w in reversed(list(enumerate(sets)))}
    for least in (0.5, 0.7):
        want = {(first[w], i) for i, w in enumerate(sets) if first[w] < i}
        want |= {(a, b) for w, a in first.items() for x, b in first.items() if a < b and len(w & x) >= least * len(w | x)}
        got = corpus.similar_titles(spark.createDataFrame(list(enumerate(titles)), "id long, title string"), least).select("a", "b").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_similar_titles_pairs_with_too_few_words_left_are_not_dealt(spark):
    """Two titles that share only the last word of their prefixes go no further than the join."""
    from attesta.operators import corpus

    plan = corpus.similar_titles(spark.createDataFrame([(1, "a b c")], "id long, title string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "least(ra" in plan


def test_schema_casts_only_what_is_asked_for(spark):
    """Strings are not cast to numbers, nor the other way round: before, every value was cast to both."""
    plan = lambda one: spark.range(1).select(schema.findings(F.col("id").cast("string"), one).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert "variant_get" not in plan({"type": "string"}) and plan({"minimum": 1}).count("variant_get") == 1
    one = {"type": ["integer", "string", "boolean", "null", "array"], "minimum": 2, "maxLength": 1, "maxItems": 1}
    texts = ['"5"', '"55"', "1", "-3", "2.5", "true", "null", "[1]", "[1,2]", "{}"]
    found = [[r["rule"] for r in x["f"]] for x in spark.createDataFrame([(t,) for t in texts], "d string").select(schema.findings(F.col("d"), one).alias("f")).collect()]
    assert found == [[], ["maxLength"], ["minimum"], ["minimum"], ["type"], [], [], [], ["maxItems"], ["type"]]
