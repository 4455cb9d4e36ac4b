"""Ranked search, language-model scores and the filter audit against brute force, and on awkward rows."""

import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.llm import audit, lexical, ppm
from tests.llm.test_operators import DATA, LONG, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11


def ranked(docs, items, most):
    """docs [(doc_id, text)], items [(item_id, text)]: rows of search by the formula, document by document."""
    counted = [(d, c) for d, t in docs for c in [Counter(TERM.findall((t or "").translate(LOWER)))] if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, own in terms.items():
        found = []
        for d, c in counted:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(heapq.nsmallest(most, found, key=lambda x: x[:3]))]
    return sorted(out, key=repr)


def test_search(spark, monkeypatch):
    rng = random.Random(2)
    words = ["Alpha", "beta", "GAMMA", "über", "日本", "x1", "of", "the", "ÀB", "don't", "e-mail"]
    docs = [(rng.randrange(-40, 400), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for _ in range(900)] + [(7, "hot copy alpha")] * 300 + [(None, "hot copy alpha"), (None, None), (1000, "!!! ---")]
    items = [(i, " ".join(rng.choice([*words, "absent"]) for _ in range(rng.randrange(0, 8)))) for i in range(30)] + [(3, "copy"), (None, "alpha Beta"), (50, None), (51, "absent")]
    for window, postings, block in ((64, 1 << 20, 200_000), (8192, 40, 20)):
        monkeypatch.setattr(lexical, "WINDOW", window)
        monkeypatch.setattr(lexical, "POSTINGS", postings)
        monkeypatch.setattr(lexical, "BLOCK", block)
        got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), 20)
        assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items, 20)


def test_scores_are_whole_numbers_beyond_64_bits():
    lengths = np.array([1, 1 << 60], np.int64)
    got = lexical._values(np.array([3, 1 << 31], np.int64), lengths, 40, 1 << 61)
    assert got.tolist() == [3_000_000_000 // (3000 + 20 * 50), (1_000_000_000 << 31) // ((1000 << 31) + 20 * (50 + 50 * 40 * (1 << 60) // (1 << 61)))]


def test_search_awkward(spark):
    items = spark.createDataFrame([(1, "word same here", "z"), (2, "日本語", None)], "item_id long, text string, score string")
    rows = [(r["doc_id"], r["text"]) for r in awkward(spark).collect()]
    assert sorted(map(tuple, lexical.search(awkward(spark), items).collect()), key=repr) == ranked(rows, [(1, "word same here"), (2, "日本語")], 50)
    assert lexical.search(empty(spark), items).count() == 0 and lexical.search(awkward(spark), items.limit(0)).count() == 0


# 12


class Partial:
    """The same model symbol by symbol: counts of contexts in dictionaries, none left out."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for t in texts:
            s = [ppm.START] * ppm.ORDER + list(t) + [ppm.END]
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.counts[tuple(s[i - k : i])][s[i]] += 1

    def p(self, before, symbol):
        excluded, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            seen = self.counts.get(tuple(before[len(before) - k :]))
            if seen is None:
                continue
            left = {x: n for x, n in seen.items() if x not in excluded}
            if left:
                escape = len(left) if len(seen) < ppm.KINDS else 0
                if symbol in left:
                    return p * left[symbol] / (sum(left.values()) + escape)
                p *= escape / (sum(left.values()) + escape)
            excluded |= set(seen)
        return p / (ppm.KINDS - len(excluded))


def trie_of(texts, nodes=63):
    codes = np.concatenate([np.zeros(0, np.int64), *(c for t in texts for c in ppm.grams(t))])
    least = len(codes) / 2**nodes

    def levels(shift):
        out = []
        for k in range(ppm.ORDER + 1):
            code, n = np.unique((codes & ppm._level(k)) >> shift, return_counts=True)
            out.append((code[n >= least], n[n >= least]))
        return out

    return ppm.Trie(levels(0), levels(ppm.BITS))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12), max_size=5), st.binary(max_size=8))
def test_trie_is_ppm(texts, text):
    brute, trie = Partial(texts), trie_of(texts)
    s = [ppm.START] * ppm.ORDER + list(text) + [ppm.END]
    want = [math.log10(brute.p(s[:i], s[i])) for i in range(ppm.ORDER, len(s))]
    assert np.concatenate(list(ppm.grams(text))).shape == (len(want),)
    assert trie.logs(np.concatenate(list(ppm.grams(text)))).tolist() == pytest.approx(want)


def test_probabilities_add_up():
    """Of all 257 symbols after any context, also where rare nodes are left out and where every symbol has been seen."""
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcab ") for _ in range(200)) for _ in range(20)]
    for trie in (trie_of(texts), trie_of(texts, 9), trie_of(texts, 6), trie_of([bytes(range(256)) * 3]), trie_of([])):
        for before in (b"", b"a", b"abca", b"zzzz", b"\x00\x01\x02\x03", b"cab "):
            s = [ppm.START] * ppm.ORDER + list(before)
            high = 0
            for x in s[-ppm.ORDER :]:
                high = high << ppm.BITS | x
            assert (10 ** trie.logs(np.array([high << ppm.BITS | x for x in range(ppm.KINDS)], np.int64))).sum() == pytest.approx(1)


def test_pieces_of_long_texts(monkeypatch):
    text = bytes(random.Random(3).randbytes(1000))
    whole = np.concatenate(list(ppm.grams(text)))
    for piece in (1, 3, 4, 7, 1000, 1001):
        monkeypatch.setattr(ppm, "PIECE", piece)
        assert np.concatenate(list(ppm.grams(text))).tolist() == whole.tolist()


def unigrams(docs, held):
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), ""] for i, t in enumerate(t for _, t in docs)}
    learned = Counter(w for i, (d, _) in enumerate(docs) if d is not None and not held(d) for w in tokens[i])
    n, v = sum(learned.values()), len(learned)
    return [(d, len(tokens[i]), sum(learned[w] > 0 for w in tokens[i]), n, sum(math.log10((learned[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])) for i, (d, _) in enumerate(docs)]


def held(d):
    return zlib.crc32(str(d).encode()) % 10 == 0


@pytest.mark.parametrize("words", [17, 6])
def test_lm_scores(spark, monkeypatch, words):
    """Counts and base of every row by hand, the score by the model symbol by symbol; with most words joined, too."""
    monkeypatch.setattr(ppm, "WORDS", words)
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5))) for _ in range(200)]
    docs = [(i, " ".join(rng.choice(vocabulary[: 20 + i]).title() for _ in range(rng.randrange(0, 40)))) for i in range(120)] + [(5, "same row")] * 40 + [(None, "no id"), (None, None), (500, None), (501, "")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_tokens string").repartition(3)
    model = ppm.fit(df, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0)
    got = ppm.score(df, model).collect()
    want = unigrams(docs, held)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted((d or -1, a, b, c, round(e, 6)) for d, a, b, c, e in want)
    brute = Partial([(t or "").translate(LOWER).encode() for d, t in docs if d is not None and not held(d)])
    for r in got[::7]:
        s = [ppm.START] * ppm.ORDER + list((r["text"] or "").translate(LOWER).encode()) + [ppm.END]
        assert r["score"] == pytest.approx(sum(math.log10(brute.p(s[:i], s[i])) for i in range(ppm.ORDER, len(s))))


@pytest.mark.parametrize("nodes", [0, 6])
def test_lm_keeps_rare_grams(spark, monkeypatch, nodes):
    """Grams below the share that is sent to every task count in full, also where only the scored texts have them."""
    monkeypatch.setattr(ppm, "NODES", nodes)
    monkeypatch.setattr(ppm, "HELD", 16)
    rng = random.Random(8)
    docs = [(i, "".join(rng.choice("aabc é") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    other = spark.createDataFrame([*docs, (60, "zzz never met abc"), (61, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ppm.score(other, ppm.fit(df, F.col("doc_id") < 50)).collect()}
    brute = Partial([t.encode() for i, t in docs if i < 50])
    for i, t in [*docs, (60, "zzz never met abc"), (61, "")]:
        s = [ppm.START] * ppm.ORDER + list(t.encode()) + [ppm.END]
        assert got[i] == pytest.approx(sum(math.log10(brute.p(s[:j], s[j])) for j in range(ppm.ORDER, len(s))))


def test_lm_held_out(spark):
    """Held-out texts take under 3 bits a byte, texts of shuffled bytes far more, and both scores agree on which are odd."""
    out = ppm.op12_lm_scoring(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.octet_length("text").alias("b")), "doc_id").collect()
    assert len(out) == 200 and len({r["train_tokens"] for r in out}) == 1
    rate = lambda rows: -sum(r["score"] for r in rows) / math.log10(2) / sum(r["b"] + 1 for r in rows)
    assert rate([r for r in out if r["held_out"]]) < 3.2 and rate([r for r in out if not r["held_out"]]) < 3


def test_lm_awkward(spark):
    rows = awkward(spark)
    model = ppm.fit(rows, F.lit(True))
    got = ppm.score(rows, model).collect()
    assert len(got) == 11 and {r["n_tokens"] for r in got if not r["text"]} == {1} and {r["n_tokens"] for r in got if r["text"] == LONG} == {60_001}
    none = ppm.fit(empty(spark), F.lit(True))
    assert ppm.score(empty(spark), model).count() == 0
    assert {round(r["score"], 6) for r in ppm.score(rows, none).collect() if not r["text"]} == {round(-math.log10(257), 6)}


# 13


def audited(docs, labels):
    """docs [(doc_id, text, lang)], labels [(doc_id, quality, toxic)]: rows of the audit, order by order and step by step."""
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        rows.append((lang or "", {f for f in fails if fails[f]}, d in good and d is not None, d in toxic and d is not None))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, lines = [r for r in rows if r[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                lines.append((part, "".join(order), k + 1, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(9)
    texts = ["", None, "a b c", "HOT " * 120, " ".join(map(str, range(150))), " ".join(map(str, range(150))) + " #", "x " * 100 + "$"] + [" ".join(rng.choice(["ab", "CD", "e|f", str(rng.random())]) for _ in range(rng.choice([5, 99, 100, 130]))) for _ in range(40)]
    docs = [(rng.choice([*range(90), None]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(400)] + [(3, "hot row", "en")] * 200
    labels = [(rng.choice([*range(90), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    got = audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")))
    assert sorted(map(tuple, got.collect())) == audited(docs, labels)
    assert got.count() == 3 * 600


def test_audit_awkward(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in awkward(spark).collect()]
    assert sorted(map(tuple, audit.audit(awkward(spark), labels).collect())) == audited(rows, [])
    assert audit.audit(empty(spark), labels).count() == 0
