"""Near duplicates by SimHash, joined through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the bit count of each segment,
packed as two-bit fields of one long. One differing bit changes one count by one, and two differing bits in a
segment change it by two or not at all, so the Manhattan distance of embeddings never exceeds the Hamming
distance. The 32 dimensions form six faces. Fingerprints within distance 3 disagree in at most three faces, so
they share a grid cell: one of the 20 choices of three faces with equal counts there. Inside a cell the
Manhattan distance is the first test and the Hamming distance the exact one.

Only distinct fingerprints are joined. A cell sends out a spanning forest of its links, never all its pairs; a
cell larger than `block` is dealt as pairs of blocks, so a task holds at most about two blocks of a cell and
no link is lost. Components of the links are found by rounds of grouped minima.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.arrow import pieces
from attesta.operators.components import connected_components
from attesta.llm.words import utf8, word_pieces
from attesta.store import spread, table, written

SEED = 42
#: Two-bit fields (segments) of each face, from the lowest bit.
FACES = (6, 6, 5, 5, 5, 5)
#: Members of a cell up to which pairs are compared by offset rather than by search.
SMALL = 12
#: What stands for a text where rows are told apart: ids may be null or repeated.
TEXT_KEY = "xxhash64(text)"

_EVEN = 0x5555555555555555
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, in the order of np.unpackbits over big-endian bytes."""
    lanes = _SPREAD[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's runs of `words` words, repeats included, in pieces; of all its words where it has fewer."""
    from xxhash import xxh64_intdigest

    some, carry = False, []
    for piece in word_pieces(utf8(text).lower()):
        carry += piece
        if len(carry) < words:
            continue
        ends = np.cumsum(np.fromiter(map(len, carry), np.int64, len(carry)) + 1)
        starts, joined = (ends - np.diff(ends, prepend=0)).tolist(), b" ".join(carry)
        yield np.fromiter([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends - 1).tolist()[words - 1 :])], np.uint64)
        some, carry = True, carry[-(words - 1) :] if words > 1 else []
    if not some and carry:
        yield np.array([xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


class Votes:
    """A fingerprint as it is gathered: how many hashes have each bit."""

    def __init__(self):
        self.ones, self.total = np.zeros(64, np.int64), 0

    def add(self, hashes: np.ndarray) -> np.ndarray:
        self.ones, self.total = self.ones + _ones(hashes), self.total + len(hashes)
        return hashes

    def bits(self) -> int:
        return int.from_bytes(np.packbits(2 * self.ones > self.total).tobytes(), "big") if self.total else 0


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the text's word shingles: bit set if set in over half of their XXH64, repeats counted; none: 0."""
    votes = Votes()
    for hashes in shingle_hashes(text, words):
        votes.add(hashes)
    return votes.bits()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, text_key, fp (the 64 bits as a signed long); null and wordless texts: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    rows = docs.select("doc_id", F.expr(TEXT_KEY).alias("text_key"), "text")
    return spread(rows).mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_key long, fp long")


def _masks() -> list[int]:
    faces, at = [], 0
    for n in FACES:
        faces.append(((1 << (2 * n)) - 1) << (2 * at))
        at += n
    return [sum(faces[i] for i in chosen) for chosen in combinations(range(len(FACES)), 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _embedded(fp: np.ndarray) -> np.ndarray:
    return fp - ((fp >> np.uint64(1)) & np.uint64(_EVEN))


def _unary(e: np.ndarray) -> np.ndarray:
    """Each count as so many set bits, so that differing bits of two codes are the counts' distance."""
    return e | ((e >> np.uint64(1)) & np.uint64(_EVEN))


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which pairs link: Manhattan distance of the embeddings first, the Hamming distance for what is left."""
    hit = np.bitwise_count(_unary(_embedded(a)) ^ _unary(_embedded(b))) <= most
    if hit.any():
        a, b = np.broadcast_arrays(a, b)
        hit[hit] = np.bitwise_count(a[hit] ^ b[hit]) <= most
    return hit


def _forest(fps: np.ndarray, most: int) -> list[np.ndarray]:
    """Links of a spanning forest: a search that compares each visited member with those not yet visited."""
    left, found = fps, []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            after = []
            for one in front:
                hit = _near(one, left, most)
                if hit.any():
                    after.append(left[hit])
                    found.append(np.stack([np.full(len(after[-1]), one), after[-1]], 1))
                    left = left[~hit]
                    if not len(left):
                        break
            front = np.concatenate(after) if after else front[:0]
    return found


def _cell_links(group: np.ndarray, fps: np.ndarray, most: int) -> list[np.ndarray]:
    """group: sorted cell numbers; links inside each cell."""
    if not len(fps):
        return []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(fps)])
    found, small = [], np.repeat(sizes <= SMALL, sizes)
    g, f = group[small], fps[small]
    for k in range(1, SMALL):
        same = np.flatnonzero(g[k:] == g[:-k])
        if not len(same):
            break
        hit = same[_near(f[same], f[same + k], most)]
        found.append(np.stack([f[hit], f[hit + k]], 1))
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        found += _forest(fps[s : s + n], most)
    return found


def fingerprint_links(distinct: DataFrame, most: int = 3, block: int = 4096) -> DataFrame:
    """distinct (fp long) -> links (u, v) whose components are those of all pairs within `most` bits; most <= 3."""
    if not 0 <= most <= 3:
        raise ValueError("the grid's faces are made for 3 bits at most")
    low, high, even = F.col("fp"), F.shiftrightunsigned("fp", 1), F.lit(_EVEN)
    embedded = low.bitwiseXOR(high).bitwiseAND(even).bitwiseOR(F.shiftleft(low.bitwiseAND(high).bitwiseAND(even), 1))
    cells = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("face"), F.col("e").bitwiseAND(F.lit(_signed(m))).alias("counts")) for i, m in enumerate(_masks())]))
    rows = distinct.select("fp", embedded.alias("e")).select("fp", cells.alias("c")).select("fp", "c.face", "c.counts")
    sizes = rows.groupBy("face", "counts").agg(F.count("*").alias("n")).where("n > 1").select(F.col("face").alias("f2"), F.col("counts").alias("c2"), F.ceil(F.col("n") / block).cast("int").alias("parts"))
    rows = rows.join(sizes, (F.col("face") == F.col("f2")) & (F.col("counts") == F.col("c2")))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least(F.col("own"), other).alias("i"), F.greatest(F.col("own"), other).alias("j"))))
    dealt = rows.withColumn("own", own).select("fp", "face", "counts", pairs.alias("p")).select("fp", F.xxhash64("face", "counts", "p.i", "p.j").alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            group = np.r_[group, batch.column("cell").to_numpy()]
            fps = np.r_[fps, batch.column("fp").to_numpy().view(np.uint64)]
            whole = int(np.searchsorted(group == group[-1], True)) if len(group) else 0  # the last cell may go on
            yield from _batches(_cell_links(group[:whole], fps[:whole], most))
            group, fps = group[whole:], fps[whole:]
        yield from _batches(_cell_links(group, fps, most))

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")


def _batches(links: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if links:
        both = np.concatenate(links).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3, block: int = 4096) -> DataFrame:
    """docs (doc_id, text, ...) -> a row for each: doc_id, text_key, fp, label, component_id (the least doc_id reachable).

    Equal fingerprints are one member, so exact copies cost nothing beyond their row. Null and wordless texts
    have fingerprint zero and link like any other; null ids are never a component_id unless all of it are null. The
    label tells components apart, also where they share a doc_id or have none. Rows that repeat an id with another
    text have that text's fingerprint each; very long texts are read whole; an empty table gives an empty one.
    """
    marked = written(fingerprints(docs, words), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fp")
    labels = connected_components(fingerprint_links(distinct, most, block))
    labelled = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = labelled.join(least, "label").select(F.col("fp").alias("_fp"), "label", "component_id")
    return marked.join(by_fp, F.col("fp") == F.col("_fp")).select("doc_id", "text_key", "fp", "label", "component_id")


def representatives(near: DataFrame) -> DataFrame:
    """near (doc_id, text_key, label) -> doc_id, text_key, times: each label's row of the least doc_id (nulls last, ties by
    text_key), and how many rows are the same."""
    same = near.groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    first = same.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "times")).alias("x"))
    return first.select("x.doc_id", "x.text_key", "x.times")


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of docs for each of chosen (doc_id, text_key, times), where these have different texts.

    Only where rows repeat are whole rows exchanged to leave one of them.
    """
    keyed, chosen = docs.withColumn("_key", F.expr(TEXT_KEY)), written(chosen, "chosen")

    def rows(which: DataFrame) -> DataFrame:
        keep = which.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"))
        return keyed.join(keep, F.col("_key").eqNullSafe(F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")

    return rows(chosen.where("times = 1")).unionByName(rows(chosen.where("times > 1")).dropDuplicates(["_key"])).drop("_key")


def one_of_each(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The documents that stand for their component, one row each: that of the least doc_id, a null id where all are null."""
    return rows_of(docs, representatives(near))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; awkward rows as in near_duplicates."""
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
