"""Language identification by interpolated Kneser-Ney character models.

One model a language, of order 5 over code points: every letter and mark in lower case is a symbol of its own,
all else is a gap. Counts and interpolation terms lie in arrays sorted by 64-bit n-gram hash, probed by binary
search. A text goes to the language of the lowest cross-entropy per scored character. It is rejected where even
that is nearer to shuffled letters than to the language, by limits calibrated on texts kept out of the counts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from attesta.llm.arrow import pieces
from attesta.llm.sample import bounded_sample, fold
from attesta.store import spread, table

ORDER = 5
DISCOUNT = 0.75
#: Characters of a batch of texts that are scored at once.
PIECE = 1 << 18
SLOT_BITS = 18
UNKNOWN = "und"
#: Added to the code point of a combining mark: a symbol of the models, but no letter.
MARK = 1 << 21
#: A text is rejected where its cross-entropy lies this far on the way from the language's texts to the same
#: letters shuffled, beyond three standard errors of a mean over so many characters.
UNLIKE, NOISE = 0.75, 2.0
#: Multiplier of the n-gram hashes (odd, so that no position is lost).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(ORDER)]


def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 (a gap) for what is neither letter nor mark."""
    lut = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            lut[i] = ord(low) if len(low) == 1 else i
        elif unicodedata.category(c)[0] == "M":
            lut[i] = i | MARK
    return lut


_LUT: list[np.ndarray] = []


def _read(text: str) -> np.ndarray:
    """The text's symbols, one for each code point."""
    if not _LUT:
        _LUT.append(_symbols())
    return _LUT[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _scored(symbols: np.ndarray) -> np.ndarray:
    """Which positions are scored: not where a gap follows a gap."""
    return (symbols > 0) | np.r_[False, symbols[:-1] > 0]


def _grams(symbols: np.ndarray) -> np.ndarray:
    """Hash of the ORDER symbols that end at each position."""
    code, s = np.zeros(len(symbols), np.uint64), symbols.astype(np.uint64)
    for k in range(min(ORDER, len(s))):
        code[k:] += s[: len(s) - k] * _POWERS[k]
    return code


def _tail(last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """last: the ORDER symbols up to each position, newest first, a row each. Hash of the last n symbols, and of these without
    the newest (the context)."""
    gram = context = np.zeros(len(last), np.uint64)
    for k in range(n):
        s = last[:, k].astype(np.uint64)
        gram = gram + s * _POWERS[k]
        if k:
            context = context + s * _POWERS[k - 1]
    return gram, context


class Model:
    """Probabilities of one language, from the last ORDER symbols at counted positions (newest first) and how often each
    row occurs."""

    def __init__(self, last: np.ndarray, times: np.ndarray, kinds: int):
        self.kinds = kinds  # symbols known to any language, and one for all others
        self.levels = []
        count = times.astype(np.float64)
        for n in range(ORDER, 0, -1):
            gram, context = _tail(last, n)
            code, first, at = np.unique(gram, return_index=True, return_inverse=True)
            count, last = np.bincount(at, count), last[first]
            context, where = np.unique(context[first], return_inverse=True)
            total, follow = np.bincount(where, count), np.bincount(where)
            self.levels.append((code, np.maximum(count - DISCOUNT, 0) / total[where], context, DISCOUNT * follow / total))
            count = np.ones(len(code))  # lower orders count the contexts that a gram continues

    def logs(self, last: np.ndarray) -> np.ndarray:
        p = np.full(len(last), 1.0 / self.kinds)
        for n in range(1, ORDER + 1):
            gram, before = _tail(last, n)
            code, own, context, rest = self.levels[ORDER - n]
            at = np.minimum(np.searchsorted(code, gram), len(code) - 1)
            above = np.minimum(np.searchsorted(context, before), len(context) - 1)
            known = context[above] == before
            p = np.where(known, np.where(code[at] == gram, own[at], 0.0) + rest[above] * p, p)
        return -np.log(p)


def _last(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ORDER symbols up to each of these positions, newest first; before the beginning there are gaps."""
    padded = np.r_[np.zeros(ORDER - 1, np.uint32), symbols]
    return np.stack([padded[at + ORDER - 1 - k] for k in range(ORDER)], 1)


class Identifier:
    """Models of all languages, the calibrated limits, and a table of n-grams already scored."""

    def __init__(self, langs: list[str], models: list[Model], limits: list[tuple[float, float]]):
        self.langs, self.models, self.limits = langs, models, limits
        self.keys: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "models": self.models, "limits": self.limits, "keys": None}

    def _cost(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Cost by language of the symbol at each of these positions."""
        if self.keys is None:
            self.keys, self.costs = np.full(1 << SLOT_BITS, 2**64 - 1, np.uint64), np.full((1 << SLOT_BITS, len(self.langs)), np.nan, np.float32)
        grams = _grams(symbols)[at]
        slot = (grams * _BASE) >> np.uint64(64 - SLOT_BITS)
        out = self.costs[slot]
        missing = np.flatnonzero(self.keys[slot] != grams)
        if len(missing):
            new, first, where = np.unique(grams[missing], return_index=True, return_inverse=True)
            last = _last(symbols, at[missing[first]])
            cost = np.stack([m.logs(last) for m in self.models], 1).astype(np.float32)
            out[missing] = cost[where]
            place = slot[missing[first]]
            self.keys[place] = new
            self.costs[place] = cost  # of two new grams in one slot the last written stays, in both tables alike
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: summed cost by language, scored characters, letters."""
        sums, scored, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        batch, owners, held, skips = [], [], 0, []

        def flush() -> None:
            nonlocal batch, owners, held, skips
            if not batch:
                return
            pad = np.zeros(ORDER - 1, np.uint32)
            lens = [len(x) + len(pad) for x in batch]
            symbols, who = np.concatenate([y for x in batch for y in (pad, x)]), np.repeat(owners, lens)
            fresh = np.concatenate([np.r_[np.zeros(skip, bool), np.ones(n - skip, bool)] for n, skip in zip(lens, skips, strict=True)])
            at = np.flatnonzero(_scored(symbols) & fresh)
            who = who[at]
            if len(who):
                cost = self._cost(symbols, at)
                starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                sums[who[starts]] += np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
                scored[who[starts]] += np.diff(np.r_[starts, len(who)])
                own = symbols[at]
                letters[:] += np.bincount(who, (own > 0) & (own < MARK), minlength=len(texts)).astype(np.int64)
            batch, owners, held, skips = [], [], 0, []

        for i, text in enumerate(texts):
            text = text or ""
            for at in range(0, len(text), PIECE):
                back = min(at, ORDER)  # a piece begins with the end of the one before, which is not scored again
                batch.append(_read(text[at - back : at + PIECE]))
                owners.append(i)
                skips.append(ORDER - 1 + back)
                held += len(batch[-1])
                if held >= PIECE:
                    flush()
        flush()
        return sums, scored, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0..1 and whether the text is rejected (no letter, or unlike every language)."""
        sums, n, letters = self.entropies(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        mean = sums / np.maximum(n, 1)[:, None]
        best = mean.argmin(1)
        sharp = np.minimum(n, 40)[:, None]
        score = 1 / np.exp(-(mean - mean.min(1, keepdims=True)) * sharp).sum(1)
        own, shuffled = np.array(self.limits).T[:, best]
        far = mean.min(1) > own + UNLIKE * (shuffled - own) + 3 * NOISE / np.sqrt(np.maximum(n, 1))
        none = letters == 0
        return [UNKNOWN if x else self.langs[k] for k, x in zip(best.tolist(), none.tolist(), strict=True)], np.where(none, 0.0, score), far | none


def fit(samples: list[tuple[str, str]]) -> Identifier:
    """samples (language, text). A fifth of each language's texts calibrates its limits, the rest is counted."""
    langs = sorted({k for k, _ in samples})
    known = np.zeros(1, np.uint32)
    for _, text in samples:
        known = np.union1d(known, np.unique(_read(text)))
    models, kept, pad = [], [], np.zeros(ORDER - 1, np.uint32)
    for lang in langs:
        own = [t for k, t in samples if k == lang]
        kept.append(own[::5] if len(own) >= 10 else own)
        counted = [t for i, t in enumerate(own) if i % 5] if len(own) >= 10 else own
        symbols = np.concatenate([pad, np.zeros(1, np.uint32), *[y for t in counted for y in (pad, _read(t))]])
        at = np.r_[ORDER - 1, np.flatnonzero(_scored(symbols))]
        _, first, times = np.unique(_grams(symbols)[at], return_index=True, return_counts=True)
        models.append(Model(_last(symbols, at[first]), times, len(known) + 1))
    first = Identifier(langs, models, [(0.0, 0.0)] * len(langs))
    limits, rng = [], np.random.default_rng(3)
    for k, texts in enumerate(kept):
        sums, n, _ = first.entropies(texts)
        mixed, m, _ = first.entropies(["".join(rng.permutation(list(t))) for t in texts])
        limits.append((float(sums[:, k].sum() / max(n.sum(), 1)), float(mixed[:, k].sum() / max(m.sum(), 1))))
    return Identifier(langs, models, limits)


def fit_on(docs: DataFrame, each: int = 300) -> Identifier:
    """Fitted on at most about `each` documents a language (doc_id, text, lang) outside fold 0 of 5."""
    return fit(bounded_sample(docs.where(fold(F.col("doc_id"), 5) != 0), "lang", each))


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """docs (text, ...) -> its columns and lang_pred, lang_score, lang_rejected; columns of these names are replaced.

    Null texts and texts without a letter are `und`, with score 0, and rejected. Very long texts are scored in
    pieces; equal texts get equal results; an empty table gives an empty one. Of languages with equal
    cross-entropy the first by name is taken.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages * n-grams of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lang, score, rejected = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    out = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("lang_score", DoubleType()).add("lang_rejected", BooleanType())
    return spread(docs).mapInArrow(run, out)


def op8_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by models learned outside fold 0 of 5 of their ids; awkward rows as in identify."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fit_on(docs)).select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
