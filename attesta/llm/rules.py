"""Quality rules: exact document statistics, two fixed rules, and gradient-boosted trees for what these leave.

The trees are fitted with logistic loss and Newton steps; along a feature with a sign they only rise or only
fall. For scoring, all trees lie in node arrays (feature, threshold, children, value) that a batch of documents
walks down level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from attesta.llm.arrow import pieces
from attesta.llm.sample import labelled_sample
from attesta.llm.words import BLANKS, PIECE, utf8, word_pieces
from attesta.store import spread, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Fixed rules: fewer words fail; so do texts with more than this percentage of repeated words.
LEAST_WORDS, MOST_REPEATED = 20, 30
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees see, and which way the score may go as they grow (0: either).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": 0, "shouts": -1, "bars": -1, "same_again": -1, "line_words": 0, "digits": 0}
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def _repeated(h: np.ndarray) -> int:
    """Words covered by windows that are found twice or more (windows compared by 64-bit hashes of their words)."""
    n = len(h) - WINDOW + 1
    if n < 2:
        return 0
    v = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        v += h[k : k + n] * _FACTORS[k]
    order = np.argsort(v)
    same = v[order[1:]] == v[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(h) + 1, np.int64)
    starts = np.unique(np.r_[order[1:][same], order[:-1][same]])
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base statistics and the trees' features of a whole text (null: as the empty text)."""
    data = utf8(text)
    counts = np.zeros(256, np.int64)
    for at in range(0, len(data), PIECE):
        counts += np.bincount(np.frombuffer(data, np.uint8, min(PIECE, len(data) - at), at), minlength=256)
    h = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64) for w in word_pieces(data))])
    n, seen, dup, lines = len(h), set(), 0, 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    chars = int(counts.sum() - counts[128:192].sum() - sum(int(counts[b]) for b in BLANKS))
    symbols, repeated = sum(int(counts[b]) for b in SYMBOLS), _repeated(h)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    words = max(n, 1)
    features = [np.log1p(n), chars / words, symbols / words, dup / max(lines, 1), repeated / words, upper / max(upper + lower, 1), int(counts[33]) / words, int(counts[124]) / words, float((h[1:] == h[:-1]).sum()) / words, n / max(lines, 1), int(counts[48:58].sum()) / words]
    return [n, chars, symbols, dup, repeated], features


class Trees:
    """Boosted trees in flat arrays; node 0 of each tree is at roots, leaves point at themselves."""

    def __init__(self, base: float):
        self.base, self.roots, self.depth = base, [], 0
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def node(self) -> int:
        i = len(self.value)
        for a, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, i), (self.right, i), (self.value, 0.0)):
            a.append(x)
        return i

    def flat(self) -> Trees:
        for name, kind in (("roots", np.int64), ("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("value", float)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good for each row of features."""
        at = np.repeat(np.asarray(self.roots, np.int64)[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def boost(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 5.0, ridge: float = 1.0, bins: int = 48) -> Trees:
    """Fit on features x and labels y (0 or 1), both classes weighing the same."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    place = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    model, total = Trees(0.0), np.zeros(len(x))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left: int) -> int:
        at, (sg, sh) = model.node(), (g[rows].sum(), h[rows].sum())
        own = float(np.clip(sg / (sh + ridge), low, high))
        model.value[at] = rate * own
        best, gain = None, 1e-6
        for j, cut in enumerate(cuts) if left else ():
            if not len(cut):
                continue
            lg = np.cumsum(np.bincount(place[rows, j], g[rows], len(cut) + 1))[:-1]
            lh = np.cumsum(np.bincount(place[rows, j], h[rows], len(cut) + 1))[:-1]
            rg, rh = sg - lg, sh - lh
            a, b = np.clip(lg / (lh + ridge), low, high), np.clip(rg / (rh + ridge), low, high)
            # loss of a leaf with value v: h v^2 / 2 - g v
            gains = (lg * a - (lh + ridge) * a * a / 2) + (rg * b - (rh + ridge) * b * b / 2) - (sg * own - (sh + ridge) * own * own / 2)
            gains[(lh < least) | (rh < least) | (signs[j] * (b - a) < 0)] = -np.inf
            k = int(gains.argmax())
            if gains[k] > gain:
                best, gain = (j, k, a[k], b[k]), gains[k]
        if best:
            j, k, a, b = best
            goes, mid = place[rows, j] <= k, (a + b) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[signs[j]]
            one, two = grow(rows[goes], g, h, *bounds[0], left - 1), grow(rows[~goes], g, h, *bounds[1], left - 1)
            model.feature[at], model.threshold[at], model.left[at], model.right[at], model.value[at] = j, cuts[j][k], one, two, 0.0
        return at

    model.depth = depth
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-total))
        root = grow(np.arange(len(x)), weight * (y - p), weight * p * (1 - p), -np.inf, np.inf, depth)
        model.roots.append(root)
        one = Trees(0.0)
        one.roots, one.depth = [root], depth
        one.feature, one.threshold, one.left, one.right, one.value = (np.array(a) for a in (model.feature, model.threshold, model.left, model.right, model.value))
        p = one.score(x)
        total += np.log(p / (1 - p))
    return model.flat()


def fit_rules(docs: DataFrame, labels: DataFrame, each: int = 1500) -> Trees:
    """Fitted on labels.quality of at most about `each` documents a class; without both classes every score is 1/2."""
    sample = labelled_sample(docs, labels, "quality", each)
    y = np.array([k for k, _ in sample], float)
    if not 0 < y.mean() < 1 if len(y) else True:
        return Trees(0.0).flat()
    return boost(np.array([statistics(t)[1] for _, t in sample]), y, list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees, least_score: float = 0.5) -> DataFrame:
    """docs (text, ...) -> its columns, the base statistics, base_failed, rules_score and kept; same names are replaced.

    Null and empty texts have zero statistics and fail the base rules. Whole texts are measured.
    """
    added = [*BASE, "base_failed", "rules_score", "kept"]
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            both = [statistics(t.as_py()) for t in batch.column("text")]
            base = np.array([b for b, _ in both], np.int64).reshape(-1, len(BASE))
            score = shared.value.score(np.array([f for _, f in both]).reshape(-1, len(FEATURES)))
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in base.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least_score))], [*batch.schema.names, *added])

    out = StructType([*docs.schema.fields])
    for name in BASE:
        out = out.add(name, LongType())
    return spread(docs).mapInArrow(run, out.add("base_failed", BooleanType()).add("rules_score", DoubleType()).add("kept", BooleanType()))


def op7_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit_rules(docs, table(spark, sf_dir, "labels"))).drop("text").withColumnRenamed("rules_score", "score").select("doc_id", *BASE, "base_failed", "kept", F.col("score"))
