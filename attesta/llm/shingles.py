"""SimHash near-dedup by similarity: fingerprints propose, and bands where they cannot; whole shingle sets decide.

Texts whose fingerprints over five-word shingles differ in three bits at most are found by the popcount grid of
`simhash`. At a similarity of 0.8 fingerprints differ in about ten bits of 64, further than any grid reaches, so
minima of the same shingle hashes propose as well: each of 30 bands hashes five minima, and two texts of similarity
s share a band with probability 1 - (1 - s^5)^30, which at 0.8 leaves out 7 pairs in a million and fewer above.
Texts that a fingerprint or band links, at once or through others, form a cluster; shingle sets go to their cluster
once, and there every pair that matters is measured exactly. Large clusters are dealt as pairs of blocks, so a task
holds about two blocks and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.arrow import pieces
from attesta.llm.simhash import SEED, TEXT_KEY, Votes, fingerprint_links, shingle_hashes
from attesta.operators.components import connected_components
from attesta.store import spread, written

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 30, 5
#: Characters of a cluster's texts that make a block (a longer text is one alone).
BLOCK = 1 << 21

_RNG = np.random.default_rng(SEED)
_FLIP, _TIMES = _RNG.integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_TIMES |= np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the text's runs of `words` words; of all its words where it has fewer; none: empty."""
    found = [np.unique(h) for h in shingle_hashes(text, words)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def sketch(text: str | None, words: int = WORDS) -> tuple[int, list[int]]:
    """The text's fingerprint (as a signed long) and its bands' keys, from one pass over its shingles."""
    votes = Votes()
    found = [np.unique(votes.add(h)) for h in shingle_hashes(text, words)]
    bits = votes.bits()
    return bits - (1 << 64) if bits >> 63 else bits, bands(np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64))


def bands(grams: np.ndarray) -> list[int]:
    """The bands' keys as signed longs; none without shingles."""
    from xxhash import xxh64_intdigest

    if not len(grams):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 4096):
        least = np.minimum(least, ((grams[None, at : at + 4096] ^ _FLIP) * _TIMES).min(1))
    keys = [xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _links(keys: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Links of a spanning forest over the pairs of similarity `least` or more, by a search through those left."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    kinds, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts, marked = np.r_[0, np.cumsum(sizes)[:-1]], np.zeros(len(kinds), bool)
    left, found = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], front = False, [first]
        while front and left.any():
            one = front.pop()
            own = codes[starts[one] : starts[one] + sizes[one]]
            marked[own] = True
            both = np.add.reduceat(marked[codes], starts, dtype=np.int64)
            marked[own] = False
            hit = np.flatnonzero(left & (both >= least * (sizes + sizes[one] - both)))
            left[hit] = False
            front += hit.tolist()
            found.append(np.stack([np.full(len(hit), keys[one]), keys[hit]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def similar_texts(texts: DataFrame, words: int = WORDS, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """texts (text_key long, text) -> links (u, v) whose components are those of all similar pairs.

    A key stands for one text, however many rows have it. Texts without a word have no links.
    """

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sketches = [sketch(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array([f for f, _ in sketches], pa.int64()), pa.array([b for _, b in sketches], pa.list_(pa.int64()))], ["text_key", "fp", "bands"])

    rows = written(spread(texts.select("text_key", "text")).mapInArrow(band, "text_key long, fp long, bands array<long>").where("size(bands) > 0"), "bands")
    # texts of equal fingerprints hang on the least of them, and the fingerprints' links on these
    first = written(rows.groupBy("fp").agg(F.min("text_key").alias("at")), "distinct-fp")
    copies = rows.join(first, "fp").where("text_key <> at").select(F.col("at").alias("u"), F.col("text_key").alias("v"))
    links = fingerprint_links(first.select("fp"))
    near = links.join(first.select(F.col("fp").alias("u"), F.col("at").alias("x")), "u").join(first.select(F.col("fp").alias("v"), F.col("at").alias("y")), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    banded = rows.dropDuplicates(["text_key"]).select("text_key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("text_key").alias("u"), F.max("text_key").alias("most")).where("u < most").select(F.col("band").alias("_b"), "u")
    banded = banded.join(shared, F.col("band") == F.col("_b")).where("text_key <> u").select("u", F.col("text_key").alias("v"))
    clusters = connected_components(banded.unionByName(near).unionByName(copies))

    members = texts.select("text_key", "text").join(clusters, F.col("text_key") == F.col("node")).select("label", "text_key", "text").dropDuplicates(["text_key"])
    sizes = members.groupBy("label").agg(F.ceil(F.sum(F.length("text").cast("long")) / block).cast("int").alias("parts")).select(F.col("label").alias("_l"), "parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingles(t.as_py(), words).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("text_key"), pa.array(sets, pa.list_(pa.int64()))], ["label", "text_key", "grams"])

    own = F.pmod(F.xxhash64("text_key"), F.col("parts")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least(F.col("own"), other).alias("i"), F.greatest(F.col("own"), other).alias("j"))))
    dealt = members.mapInArrow(cut, "label long, text_key long, grams array<long>").join(sizes, F.col("label") == F.col("_l")).withColumn("own", own)
    dealt = dealt.select("text_key", "grams", "label", pairs.alias("p")).select("text_key", "grams", F.xxhash64("label", "p.i", "p.j").alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            for at, key, grams in zip(batch.column("cell").to_pylist(), batch.column("text_key").to_pylist(), batch.column("grams"), strict=True):
                if at != cell:
                    yield from linked(held)
                    cell, held = at, {}
                held[key] = grams.values.to_numpy()
        yield from linked(held)

    def linked(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            both = _links(np.fromiter(held, np.int64, len(held)), list(held.values()), least)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")


def similar_documents(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs (doc_id, text, ...) -> a row for each: doc_id, text_key, label, equal for documents linked by that similarity.

    Exact copies share their text_key. Null, empty and wordless texts are one group. Null and repeated ids are rows
    like any other, very long texts are read whole, and an empty table gives an empty one.
    """
    keyed = docs.select("doc_id", F.expr(TEXT_KEY).alias("text_key"), "text")
    labels = connected_components(similar_texts(keyed, words, least))
    wordless = F.when(~F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False)), F.lit(0))
    labelled = keyed.select("doc_id", "text_key", wordless.alias("wordless")).join(labels, F.col("text_key") == F.col("node"), "left")
    return labelled.select("doc_id", "text_key", F.coalesce("label", "wordless", "text_key").alias("label"))
