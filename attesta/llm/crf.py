"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad; its features are its own and those of the lines before and after it, and a
transition weight ties neighbours. A document's share of good is the mean of its lines' forward-backward
marginals, weighted by length, and a logistic curve turns the share into a score. Labels exist for documents
only: lines begin with their document's label, and between rounds of fitting a bad document's lines that look
good are relabelled, its worst line excepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from attesta.llm.arrow import pieces
from attesta.llm.sample import fold, labelled_sample
from attesta.llm.words import BLANKS, utf8
from attesta.store import spread, table

#: Bytes of whole lines that are measured at once.
BLOCK = 1 << 20
OWN = ("log_words", "word_length", "upper", "shouts", "symbols", "bars", "same_again", "ends", "digits", "seen")
WIDTH = 3 * len(OWN) + 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _lut(chars: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(chars)] = True
    return lut


_BLANK, _UPPER, _LOWER, _DIGIT = _lut(BLANKS), _lut(bytes(range(65, 91))), _lut(bytes(range(97, 123))), _lut(bytes(range(48, 58)))
_SHOUT, _SYMBOL, _BAR, _END = _lut(b"!"), _lut(b"#*$%&<>"), _lut(b"|"), _lut(b".!?")


COUNTS = ("words", "chars", "upper", "lower", "shouts", "symbols", "bars", "again", "digits")


def _measure(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """block: lines that each end in a newline. Their counts, whether a sentence ends with them, hashes, bytes, and the hashes of their
    first and last words (0 without one)."""
    arr = np.frombuffer(block, np.uint8)
    ends = np.flatnonzero(arr == 10)
    starts = np.r_[0, ends[:-1] + 1]
    count = lambda lut: np.add.reduceat(lut[arr], starts, dtype=np.int64)
    blank = _BLANK[arr]
    first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    after = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    power, back = np.cumprod(np.full(len(arr), _BASE)), np.cumprod(np.full(len(arr) + 1, _BACK))
    sums = np.r_[np.uint64(0), np.cumsum((arr + np.uint64(1)) * power)]
    words = (sums[after] - sums[first]) * back[first]
    line = np.searchsorted(ends, first)
    again = line[1:][(words[1:] == words[:-1]) & (line[1:] == line[:-1])]
    n, chars = np.bincount(line, minlength=len(ends)), (ends - starts + 1) - count(_BLANK)
    closes = _END[arr[np.maximum(ends - 1, 0)]] & (ends > starts)
    outer = np.zeros((len(ends), 2), np.uint64)
    if len(line):
        new = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        outer[line[new], 0], outer[line[new], 1] = words[new], words[np.r_[new[1:] - 1, len(words) - 1]]
    counts = np.stack([n, chars, count(_UPPER), count(_LOWER), count(_SHOUT), count(_SYMBOL), count(_BAR), np.bincount(again, minlength=len(ends)), count(_DIGIT)], 1)
    return counts, closes, (sums[ends] - sums[starts]) * back[starts], ends - starts, outer


def _whole_lines(parts: list[tuple], open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, closes and hashes of lines from those of their parts; open_: a part goes on in the next one, with a blank between words."""
    counts, closes, h, size, outer = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.flatnonzero(np.r_[True, ~open_[:-1]])
    last = np.r_[first[1:] - 1, len(open_) - 1]
    total = np.add.reduceat(counts, first, axis=0)
    whole = h[first]
    for i in np.flatnonzero(last > first).tolist():
        code, at, word = 0, 0, None
        for k in range(first[i], last[i] + 1):
            code, at = (code + int(h[k]) * pow(int(_BASE), int(at), 1 << 64)) % (1 << 64), at + int(size[k])
            if counts[k, 0]:
                total[i, 7] += word == outer[k, 0]
                word = outer[k, 1]
        whole[i] = code
    return total, closes[last], whole


def _own(counts: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """The features of OWN without `seen`."""
    n, chars, upper, lower, shouts, symbols, bars, again, digits = counts.T
    w = np.maximum(n, 1)
    return np.stack([np.log1p(n), chars / w / 10, upper / np.maximum(upper + lower, 1), shouts / w, symbols / w, bars / w, again / w, closes, digits / np.maximum(chars, 1)], 1)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word, their lengths, and the text each belongs to. Whole texts are measured, long lines in parts
    cut at blanks, so what is held beyond a text is some forty times BLOCK, or its longest word."""
    parts, opens, docs, block, held, owners = [], [], [], [], 0, []

    def flush() -> None:
        nonlocal block, held, owners
        if block:
            parts.append(_measure(b"".join(block)))
            opens.append(np.concatenate([np.r_[np.zeros(n - 1, bool), goes_on] for _, n, goes_on in owners]))
            docs.append(np.repeat([i for i, _, _ in owners], [n for _, n, _ in owners]))
        block, held, owners = [], 0, []

    for i, text in enumerate(texts):
        data, at = utf8(text) + b"\n", 0
        while at < len(data):
            end = len(data) if len(data) - at <= BLOCK else data.rfind(b"\n", at, at + BLOCK) + 1
            goes_on = not end
            if goes_on:  # no line ends here: the part ends before a blank, which the next one begins with
                end = at + BLOCK
                while data[end] not in BLANKS:
                    end += 1
                goes_on = data[end] != 10
                end += not goes_on
            part = data[at:end] + b"\n" * goes_on
            block.append(part)
            owners.append((i, part.count(b"\n"), goes_on))
            held += len(part)
            at = end
            if held >= BLOCK:
                flush()
    flush()
    open_ = np.concatenate(opens)
    counts, closes, h = _whole_lines(parts, open_)
    own, length, doc = _own(counts, closes), counts[:, 1], np.concatenate(docs)[np.r_[True, ~open_[:-1]]]
    some = length > 0
    own, length, h, doc = own[some], length[some], h[some], doc[some]
    order = np.lexsort((h, doc))
    seen = np.zeros(len(h))
    seen[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    own = np.c_[own, seen]
    start, end = np.r_[True, doc[1:] != doc[:-1]], np.r_[doc[1:] != doc[:-1], True]
    start, end = start[: len(doc)], end[: len(doc)]
    before, following = np.roll(own, 1, 0) * ~start[:, None], np.roll(own, -1, 0) * ~end[:, None]
    return np.c_[own, before, following, start, end, np.ones(len(doc))], length, doc


class Chains:
    """Lines of many documents as rectangles: documents in order of length, step t holding those still running."""

    def __init__(self, doc: np.ndarray):
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(doc)])
        order = np.argsort(-sizes, kind="stable")
        self.order = order
        self.starts, self.sizes = starts[order], sizes[order]
        self.alive = np.searchsorted(-self.sizes, -np.arange(1, (self.sizes[0] if len(sizes) else 0) + 1), side="right")

    def marginals(self, odds: np.ndarray, move: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """odds: log-odds of good by line; move: 2 x 2 transition scores; weight: of each document, or 1. Probability
        of good by line, and weighted sums over documents: expected transitions and the log of the partition sum."""
        k, n = len(self.alive), len(self.sizes)
        node = np.stack([np.zeros_like(odds), odds], 1)
        ahead, behind = np.zeros_like(node), np.zeros_like(node)
        own = np.ones(n) if weight is None else weight[self.order]
        for t in range(k):
            at = self.starts[: self.alive[t]] + t
            if t == 0:
                ahead[at] = node[at]
            else:
                x = ahead[at - 1][:, :, None] + move[None]
                ahead[at] = node[at] + np.logaddexp(x[:, 0], x[:, 1])
        last = self.starts + self.sizes - 1
        partition = np.logaddexp(ahead[last, 0], ahead[last, 1]) if n else np.zeros(0)
        whole = float((own * partition).sum())
        expected = np.zeros((2, 2))
        for t in range(k - 2, -1, -1):
            at = self.starts[: self.alive[t + 1]] + t
            x = move[None] + (node[at + 1] + behind[at + 1])[:, None, :]
            behind[at] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            expected += (own[: len(at), None, None] * np.exp(ahead[at][:, :, None] + x - partition[: len(at), None, None])).sum(0)
        both = ahead + behind
        return 1 / (1 + np.exp(both[:, 0] - both[:, 1])), expected, whole


class LineModel:
    """Weights of the field and of the curve from the share of good lines to a score."""

    def __init__(self):
        self.weight, self.move = np.zeros(WIDTH), np.zeros((2, 2))
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.curve = (0.0, 0.0)

    def lines(self, x: np.ndarray, chains: Chains) -> np.ndarray:
        return chains.marginals((x - self.mean) / self.scale @ self.weight, self.move)[0]

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted share of good by text; nan without a line that has a word."""
        x, length, doc = line_features(texts)
        good = self.lines(x, Chains(doc))
        with np.errstate(invalid="ignore"):
            return np.bincount(doc, good * length, len(texts)) / np.bincount(doc, length, len(texts))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        share = self.shares(texts)
        score = 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * share)))
        return np.where(np.isnan(share), 0.0, score)


def likelihood(theta: np.ndarray, z: np.ndarray, chains: Chains, y: np.ndarray, weight: np.ndarray, doc: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The field's log-likelihood of the line labels y, documents weighted, a mean over lines less the ridge; and its gradient.

    weight: of each document that has lines, in order; doc: the document of each line, in order.
    """
    chain = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    next_, line, k = doc[1:] == doc[:-1], weight[chain], y.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (k[:-1][next_], k[1:][next_]), line[1:][next_])
    odds, move = z @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    good, expected, whole = chains.marginals(odds, move, weight)
    value = ((line * y * odds).sum() + (seen * move).sum() - whole) / len(y) - ridge / 2 * theta @ theta
    return float(value), np.r_[z.T @ (line * (y - good)), (seen - expected).ravel()] / len(y) - ridge * theta


def _fit_lines(model: LineModel, x: np.ndarray, chains: Chains, y: np.ndarray, weight: np.ndarray, doc: np.ndarray, steps: int, rate: float, ridge: float) -> None:
    """Ascend the likelihood of line labels y by Adam."""
    z, theta = (x - model.mean) / model.scale, np.r_[model.weight, model.move.ravel()]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = likelihood(theta, z, chains, y, weight, doc, ridge)[1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weight, model.move = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)


def fit_lines(sample: list[tuple[int, str]], rounds: int = 3, steps: int = 60) -> LineModel:
    """sample (label 0 or 1, text); without both labels the score is the label's own, or 1/2 of none."""
    model, labels = LineModel(), np.array([k for k, _ in sample], float)
    if not len(labels) or labels.min() == labels.max():
        model.curve = (0.0 if not len(labels) else (4.0 if labels[0] else -4.0), 0.0)
        return model
    texts = [t for _, t in sample]
    x, length, doc = line_features(texts)
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.mean[-1], model.scale[-1] = 0.0, 1.0
    chains, own = Chains(doc), labels[doc]
    y, with_lines = own.copy(), labels[np.unique(doc)]
    lines_of = np.bincount(doc)[np.unique(doc)]
    for _ in range(rounds):
        # documents are weighted so that both labels have the same weight of lines
        good_lines = max(1, int(lines_of[with_lines == 1].sum())) / max(1, len(y))
        weight = np.where(with_lines == 1, 0.5 / good_lines, 0.5 / max(1 - good_lines, 1 / len(y)))
        _fit_lines(model, x, chains, y, weight, doc, steps, 0.1, 1e-4)
        good = model.lines(x, chains)
        worst = np.full(len(texts), np.inf)
        np.minimum.at(worst, doc, good)
        y = np.where((own == 0) & (good > 0.5) & (good > worst[doc]), 1.0, own)
    share = model.shares(texts)
    ok = ~np.isnan(share)
    s, k, w = share[ok], labels[ok], np.zeros(2)
    z = np.c_[np.ones(len(s)), s]
    for _ in range(30):  # Newton steps of a logistic fit
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), z.T @ (k - p) - 1e-2 * w)
    model.curve = (float(w[0]), float(w[1]))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, each: int = 900) -> LineModel:
    """Fitted on at most about `each` documents a label, none of them in fold 2 of 4."""
    return fit_lines(labelled_sample(docs, labels.where(fold(F.col("doc_id"), 4) != 2), "quality", each, max_chars=20_000))


def score_documents(docs: DataFrame, model: LineModel) -> DataFrame:
    """docs (text, ...) -> its columns and quality_score (0 to 1); a column of that name is replaced.

    Null texts, empty ones and those without a word score 0. Equal texts score alike, whatever their ids; very
    long texts are measured whole, in blocks, and so are very long lines; an empty table gives an empty one.
    """
    docs = docs.drop("quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column("text").to_pylist()))], [*batch.schema.names, "quality_score"])

    return spread(docs).mapInArrow(run, StructType([*docs.schema.fields]).add("quality_score", DoubleType()))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every document, by a field fitted outside fold 2 of 4 of their ids; awkward rows as in score_documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))
