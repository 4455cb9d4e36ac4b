"""Ranked lexical search by windowed bucket scoring.

Documents are tokenised once into an inverted index of the query terms: each row is a window of up to 8,192
documents that follow each other in one task's input, numbered in order of doc_id, with postings (number, tf)
term by term. A window is scored query by query: the postings of its terms are scattered into an array of one
score a document, small enough for the cache, and into a bitset of occupied places; the occupied places are then
harvested into the query's heap of best documents. Tasks keep their heaps from window to window, and only what
is left in them at the end is exchanged. Queries go in blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.arrow import pieces, small_batches
from attesta.llm.words import utf8, word_pieces
from attesta.store import spread, table, written

#: Documents of a window; a window also ends before it holds more postings than this by more than one document's.
WINDOW, POSTINGS = 1 << 13, 1 << 20
#: (query, term) pairs of a block of queries, on average.
BLOCK = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for UTF-8 bytes: what is in no term becomes a space, A-Z become a-z.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
INDEX = "ids array<long>, lengths binary, terms array<int>, sizes array<int>, slots binary, tfs binary, n_docs long, n_terms long"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text (null: none)."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")), F.lit(f"({TERM})"), 1))


def _counted(text: str | None, vocabulary: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Terms of the whole text with repeats, and occurrences of those in the vocabulary."""
    n, found = 0, Counter()
    for words in word_pieces(utf8(text).translate(_BYTES)):
        n += len(words)
        found.update(words)
    return n, {vocabulary[w]: found[w] for w in found.keys() & vocabulary.keys()}


def _window(docs: list[tuple[int | None, int, dict[int, int]]]) -> list:
    """One row of the index from (doc_id, terms with repeats, occurrences by term); null ids come last."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    terms = np.array([t for _, _, tf in docs for t in tf], np.int64)
    tfs = np.array([x for _, _, tf in docs for x in tf.values()], np.uint32)
    slots = np.repeat(np.arange(len(docs)), [len(tf) for _, _, tf in docs]).astype(np.uint16)
    order = np.argsort(terms, kind="stable")
    kinds, sizes = np.unique(terms, return_counts=True)
    lengths = np.array([n for _, n, _ in docs], np.int64)
    return [[d for d, _, _ in docs], lengths.tobytes(), kinds.tolist(), sizes.tolist(), slots[order].tobytes(), tfs[order].tobytes(), len(docs), int(lengths.sum())]


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs (doc_id, text) -> windows of all documents that have a term, with postings of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of one block of queries
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("slots", pa.binary()), ("tfs", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings = [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(_window(held), schema, strict=True)], schema=schema)
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                n, found = _counted(text.as_py(), shared.value)
                if not n:
                    continue
                if held and (len(held) == WINDOW or postings + len(found) > POSTINGS):
                    yield row()
                    held, postings = [], 0
                held.append((doc_id, n, found))
                postings += len(found)
        if held:
            yield row()

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, INDEX)


def _values(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturation of each posting, in integers: 10^9 tf div (1000 tf + 20 m)."""
    whole = 50 * n_docs * lengths if 50 * n_docs * int(lengths.max(initial=0)) < 1 << 63 else np.array([50 * n_docs * x for x in lengths.tolist()], object)
    m = 50 + (whole // n_terms).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Scorer:
    """Best documents of every query of a block, over the windows it has seen."""

    def __init__(self, queries: list[list[int]], weights: dict[int, int], n_docs: int, n_terms: int, most: int):
        self.queries = [[t for t in q if weights.get(t, 0) > 0] for q in queries]
        self.weights, self.n_docs, self.n_terms, self.most = weights, n_docs, n_terms, most
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in queries]  # (score, id known, -id): the least is the worst
        self.scores, self.occupied = np.zeros(WINDOW, np.int64), np.zeros(WINDOW // 64, np.uint64)

    def window(self, row: dict) -> None:
        if not row["terms"]:
            return
        ids, lengths = row["ids"], np.frombuffer(row["lengths"], np.int64)
        slots, sizes = np.frombuffer(row["slots"], np.uint16).astype(np.int64), np.array(row["sizes"], np.int64)
        ends, kinds = np.cumsum(sizes), np.array(row["terms"], np.int64)
        owner = np.repeat(np.arange(len(kinds)), sizes)
        gains = _values(np.frombuffer(row["tfs"], np.uint32).astype(np.int64), lengths[slots], self.n_docs, self.n_terms)
        gains *= np.array([self.weights.get(t, 0) for t in kinds.tolist()], np.int64)[owner]
        # the bits that a term sets, word by word of the bitset
        words = slots >> 6
        runs = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])])
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), runs)
        words, last = words[runs], np.searchsorted(runs, ends)
        at = {t: (int(e - s), int(e), int(a), int(b)) for t, s, e, a, b in zip(kinds.tolist(), sizes, ends, np.r_[0, last[:-1]], last, strict=True)}
        for q, heap in zip(self.queries, self.heaps, strict=True):
            hit = False
            for t in q:
                if t in at:
                    hit = True
                    a, b, c, d = at[t]
                    self.scores[slots[a:b]] += gains[a:b]  # a term has one posting a document
                    self.occupied[words[c:d]] |= bits[c:d]
            if hit:
                self._harvest(heap, ids)

    def _harvest(self, heap: list[tuple[int, int, int]], ids: list[int | None]) -> None:
        """Move what is better than the heap's worst into it, and clear the window."""
        used = np.flatnonzero(self.occupied)
        places = (used[:, None] * 64 + np.arange(64)).ravel()
        places = places[np.unpackbits(self.occupied[used].view(np.uint8), bitorder="little").astype(bool)]
        got = self.scores[places]
        better = got >= heap[0][0] if len(heap) == self.most else got > 0
        found, got = places[better], got[better]
        if len(found) > self.most:  # the first in order of score, then of id, which is that of places
            least = np.partition(got, -self.most)[-self.most]
            first = np.r_[np.flatnonzero(got > least), np.flatnonzero(got == least)][: self.most]
            found, got = found[first], got[first]
        for place, score in zip(found.tolist(), got.tolist(), strict=True):
            doc = ids[place]
            entry = (score, int(doc is not None), -(doc or 0))
            if len(heap) < self.most:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        self.scores[places] = 0
        self.occupied[used] = 0


def _block(docs: DataFrame, pairs: list, most: int) -> DataFrame | None:
    """pairs (item_id, term) of one block of queries -> item_id, doc_id, score: the best of each task."""
    spark = docs.sparkSession
    names, vocabulary, queries = {}, {}, []
    for item, term in pairs:
        if item not in names:
            names[item] = len(names)
            queries.append([])
        queries[names[item]].append(vocabulary.setdefault(term.encode("utf-8", "surrogatepass"), len(vocabulary)))
    index = written(build_index(docs, vocabulary), "lexical-index")
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return None
    df = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes")).collect()  # at most the block's terms
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df}
    shared = spark.sparkContext.broadcast((queries, weights))  # one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value, n_docs, n_terms, most)
        for batch in batches:
            for row in batch.to_pylist():
                scorer.window(row)
        for i, heap in enumerate(scorer.heaps):
            if heap:
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(heap), pa.int32()), pa.array([-d if known else None for _, known, d in heap], pa.int64()), pa.array([s for s, _, _ in heap], pa.int64())], ["item", "doc_id", "score"])

    with small_batches(spark, 1):  # a row is a window
        best = written(index.drop("n_docs", "n_terms").mapInArrow(run, "item int, doc_id long, score long"), "lexical-best")
    items = spark.createDataFrame([(i, name) for name, i in names.items()], "item int, item_id long")
    return best.join(F.broadcast(items), "item").select("item_id", "doc_id", "score")  # items of one block


def search(docs: DataFrame, items: DataFrame, most: int = 50) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank (from 1), doc_id, score: the `most` best documents of each item.

    Equal scores go by ascending doc_id, null ids last. Null and empty texts, and texts without a term, are no
    documents; null or empty items find nothing. Rows of one item_id (null is one too) are one item with the
    terms of all; repeated documents rank each. Very long texts are counted whole, piece by piece. An empty table gives
    no rows. Only the columns named are read.
    """
    pairs = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of(F.col("text"))).alias("term")).distinct(), "lexical-items")
    blocks = max(1, -(-pairs.count() // BLOCK))
    found = []
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "term").collect()
        found += [x for x in [_block(docs, own, most) if own else None] if x is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for every benchmark item; awkward rows as in search."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
ORACLE = rf"""
with i as (select distinct item_id, unnest({_TERMS}) term from benchmark),
d as (select row_number() over () r, doc_id, {_TERMS} w from documents),
n as (select r, doc_id, len(w) n from d where len(w) > 0),
s as (select count(*) as n_docs, sum(n)::bigint as n_terms from n),
p as (select r, term, count(*) tf from (select r, unnest(w) term from d) where term in (select term from i) group by r, term),
g as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint w from p, s group by term, n_docs),
v as (select item_id, p.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::bigint score from i join p using (term) join g using (term) join n using (r), s group by item_id, p.r, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from v where score > 0 qualify rank <= 50
"""
