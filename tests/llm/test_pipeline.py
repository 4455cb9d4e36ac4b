"""The pipeline's stages on awkward rows and on the smallest tables, against brute force."""

import random
import re

import corpus_pipeline
from attesta.llm import langid, mixing, pieces, shingles
from attesta.store import table
from tests.llm.test_operators import DATA, awkward, brute_fingerprint, empty

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_awkward_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == COLUMNS, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert "token_ids" in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).columns


def test_stages_on_all_rows(spark):
    docs = table(spark, DATA, "documents")
    kept = corpus_pipeline.language_id(spark, docs, DATA)
    model = langid.fit_on(docs)
    _, _, rejected = model.predict([r["text"] for r in docs.orderBy("doc_id").select("text").collect()])
    assert kept.count() == int((~rejected).sum()) >= 0.99 * docs.count()

    one = {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, kept, DATA).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    groups: list[list[tuple[int, str]]] = []
    for row in rows:
        near = [g for g in groups if any(row[1] == x[1] or similarity(row[1], x[1]) >= 0.8 for x in g)]
        groups = [g for g in groups if g not in near] + [[row, *(x for g in near for x in g)]]
    assert one == {min(g)[0] for g in groups}

    more = table(spark, DATA.replace("0.001", "0.01"), "documents")
    texts = {r["doc_id"]: r for r in corpus_pipeline.secret_scans(spark, more, DATA).collect()}
    had = 0
    for r in more.collect():
        clean = re.sub(r'(?i)(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", r["text"])
        had += clean != r["text"]
        assert texts[r["doc_id"]]["text"] == clean and texts[r["doc_id"]]["n_chars"] == (len(clean) if clean != r["text"] else r["n_chars"])
    assert had > 0

    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, quality=mixing.label_weights(table(spark, DATA, "labels"))).collect()}
    rows = [r["doc_id"] for r in corpus_pipeline.mixing_sources(spark, docs, DATA).collect()]
    assert {i: rows.count(i) for i in taken} == taken

    last = corpus_pipeline.sentencepiece(spark, docs, DATA).collect()
    m = pieces.load()
    assert len(last) == docs.count() and all(r["round_trip"] for r in last)
    assert {r["doc_id"]: r["n_tokens"] for r in last} == {r["doc_id"]: len(m.encode(r["text"])) // 4 for r in docs.collect()}


def similarity(a, b):
    def grams(text):
        w = text.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}

    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_near_dedup_by_similarity(spark):
    """The stage as run: no two documents of similarity 0.8 stay, at any bit distance, and no other goes."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for i in range(40):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 9):
            other = list(base)
            for k in range(edits):
                other[20 * k + rng.randrange(15)] = word()
            texts.append(" ".join(other))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = {r["doc_id"] for r in stage(spark, docs, DATA).collect()}
    near = {i: [j for j in range(i - i % 7, i - i % 7 + 7) if j != i and similarity(texts[i], texts[j]) >= 0.8] for i in range(len(texts))}
    assert any((brute_fingerprint(texts[i]) ^ brute_fingerprint(texts[j])).bit_count() > 3 for i in near for j in near[i])
    groups, left = [], set(near)
    while left:
        group, front = set(), [min(left)]
        while front:
            i = front.pop()
            if i not in group:
                group.add(i)
                front += near[i]
        left -= group
        groups.append(group)
    assert kept == {min(g) for g in groups}


def test_similar_texts_in_blocks(spark):
    """Links between blocks of a cluster too; repeated keys and texts without a word."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(30)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "text_key long, text string")
    for least, count in ((0.8, 29), (1.0, 0)):
        links = [(r["u"], r["v"]) for r in shingles.similar_texts(rows, least=least, block=3000).collect()]
        seen, front = set(), [0]
        while front:
            i = front.pop()
            seen.add(i)
            front += [b if a == i else a for a, b in links if i in (a, b) and (b if a == i else a) not in seen]
        assert len(seen) == count + 1
    few = spark.createDataFrame([(1, "one text only"), (1, "one text only"), (2, None), (3, " ")], rows.schema)
    assert shingles.similar_texts(few).count() == 0


def test_fingerprints_propose_and_bands_complete(spark):
    """Links come from fingerprints within three bits too: without bands the closest copies are still found."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(3000)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(word() for _ in range(50))]
    rows = spark.createDataFrame(list(enumerate(texts)), "text_key long, text string")
    before, shingles.bands = shingles.bands, lambda grams: [int(grams[0]) % 1000 + len(grams)] if len(grams) else []
    try:
        bits = [shingles.sketch(t)[0] for t in texts]
        assert 0 < (bits[0] ^ bits[1]).bit_count() <= 3 or bits[0] == bits[1]
    finally:
        shingles.bands = before
    links = [(r["u"], r["v"]) for r in shingles.similar_texts(rows).collect()]
    assert {tuple(sorted(x)) for x in links} == {(0, 1)}


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 150 and set(out.columns) >= {"doc_id", "token_ids", "n_tokens"}
