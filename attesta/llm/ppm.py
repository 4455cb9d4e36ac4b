"""Language-model scoring by prediction by partial matching, beside a smoothed unigram model.

The pretrained model is a trie of byte contexts of up to 4 symbols, counted over every training document. A symbol
is looked for in the longest known context; where it has not been seen there, an escape is paid for, the symbols
of that context are excluded, and the next shorter context is asked, down to all 257 symbols alike. The escape
weighs as much as the context has kinds of symbols (method C). The code lengths of all bytes and of the end add up to the text's.

Counts are made by tasks and summed by Spark; every gram is kept. What a gram's symbol costs depends on the grams that end
in the same two context symbols, and on counts of single symbols and pairs (257 * 258 at most, sent to every task), so grams
are dealt by these two symbols and costs found there. Grams and words that make up one in 2**22 symbols, 2**18 words, or more
are sent to every task with their costs, all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from attesta.llm.arrow import pieces
from attesta.llm.sample import fold
from attesta.llm.words import BLANKS, utf8
from attesta.store import dealt, spread, table, written

ORDER = 4
#: Symbols beyond the bytes: the end of a text, and what stands before its beginning (never predicted).
END, START, KINDS = 256, 257, 257
BITS = 9
#: A gram, a word enters the tables sent to every task if at least one in 2**NODES symbols, 2**WORDS words is it.
NODES, WORDS = 22, 18
#: Symbols handled at once; counts held by a task before it hands them on.
PIECE, HELD = 1 << 19, 1 << 16
#: The token that ends every text (no word is empty).
STOP = b""
DISCOUNT = 0.1
SLOT_BITS = 19
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def grams(data: bytes) -> Iterator[np.ndarray]:
    """For every byte of the text and its end: that symbol in the lowest 9 bits, above it the ORDER symbols before it, newest lowest."""
    n = len(data)
    for a in range(0, n + 1, PIECE):
        b = min(n + 1, a + PIECE)
        symbols, lead, first = np.full(b - a + ORDER, START, np.int64), max(0, ORDER - a), max(0, a - ORDER)
        body = np.frombuffer(data, np.uint8, min(b, n) - first, first)
        symbols[lead : lead + len(body)] = body
        if b > n:
            symbols[-1] = END
        code = np.zeros(b - a, np.int64)
        for k in range(ORDER + 1):
            code = code << BITS | symbols[k : k + b - a]
        yield code


def _level(k: int) -> int:
    """Mask of a gram's last k + 1 symbols."""
    return (1 << BITS * (k + 1)) - 1


class Cached:
    """Costs of grams, those already met in a table."""

    keys: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("keys", "known")}

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context; grams already met are found in a table."""
        if self.keys is None:
            self.keys, self.known = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS)
        slot = (codes.view(np.uint64) * _SPREAD) >> np.uint64(64 - SLOT_BITS)
        out = self.known[slot]
        missing = np.flatnonzero(self.keys[slot] != codes)
        if len(missing):
            new, first, where = np.unique(codes[missing], return_index=True, return_inverse=True)
            cost = self._cost(new)
            out[missing] = cost[where]
            place = slot[missing[first]]
            self.keys[place] = new
            self.known[place] = cost  # of two new grams in one slot the last written stays, in both tables alike
        return out


class Trie(Cached):
    """Nodes by order in sorted arrays: grams and their counts; contexts with the sum and number of their nodes, what they have
    beyond these, and what their symbols' counts come to in the next shorter context."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]]):
        """nodes and contexts: (sorted codes, counts) of each order from 0; every context of a node is among the contexts."""
        self.levels, last = [], np.iinfo(np.int64).max
        for k in range(ORDER + 1):
            gram, n = (np.r_[x, y].astype(np.int64) for x, y in zip(nodes[k], (last, 0), strict=True))  # a last entry that nothing equals
            context, first = np.unique(gram[:-1] >> BITS, return_index=True)
            total, kinds = np.add.reduceat(n[:-1], first) if len(first) else first, np.diff(np.r_[first, len(gram) - 1])
            rest = contexts[k][1][np.searchsorted(contexts[k][0], context)] - total
            below = np.zeros(len(context))
            if k and len(context):
                shorter, counts = self.levels[-1][:2]
                below = np.add.reduceat(counts[np.searchsorted(shorter, gram[:-1] & _level(k - 1))], first)
            self.levels.append((gram, n, np.r_[context, last], *(np.r_[x, 0].astype(np.float64) for x in (total, kinds, rest, below))))

    def _cost(self, codes: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        gone, gone_kinds = np.zeros(len(codes)), np.zeros(len(codes))  # counts and kinds excluded by the longer context
        for k in range(ORDER, -1, -1):
            gram, n, context, total, kinds, rest, below = self.levels[k]
            own = codes & _level(k)
            at, c = np.searchsorted(gram, own), np.searchsorted(context, own >> BITS)
            known = context[c] == own >> BITS
            hit = open_ & known & (gram[at] == own)
            escape = kinds[c] - gone_kinds + rest[c]
            if k == 0:
                escape = np.where(kinds[c] < KINDS, escape, 0.0)  # with every symbol seen there is nothing to escape to
            whole = total[c] - gone + escape
            out[hit] += np.log10(n[at[hit]] / whole[hit])
            missed = open_ & known & ~hit & (escape > 0)
            out[missed] += np.log10(escape[missed] / whole[missed])
            gone, gone_kinds = np.where(known, below[c], gone), np.where(known, kinds[c], gone_kinds)
            open_ &= ~hit
        if open_.any():
            out[open_] -= np.log10(KINDS - self.levels[0][4][0])
        return out


class Costs(Cached):
    """log10 probabilities of some grams; nan for all others."""

    def __init__(self, gram: np.ndarray, log: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.log = np.r_[gram[order], np.iinfo(np.int64).max].astype(np.int64), np.r_[log[order], np.nan].astype(np.float64)

    def _cost(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.gram, codes)
        return np.where(self.gram[at] == codes, self.log[at], np.nan)

    def read(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """In pieces, many short texts at once: what each text's known grams add, and of the others the text, gram and times."""
        held, owners, size = [], [], 0
        for i, data in enumerate(texts):
            for code in grams(data):
                held.append(code)
                owners.append(i)
                size += len(code)
                if size >= PIECE:
                    yield self._sums(held, owners, len(texts))
                    held, owners, size = [], [], 0
        if held:
            yield self._sums(held, owners, len(texts))

    def _sums(self, held: list[np.ndarray], owners: list[int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        codes, owner = np.concatenate(held), np.repeat(owners, [len(c) for c in held])
        logs = self.logs(codes)
        other = np.flatnonzero(np.isnan(logs))
        logs[other] = 0.0
        kinds, at = np.unique(codes[other], return_inverse=True)
        pair, times = np.unique(owner[other] * len(kinds) + at, return_counts=True)
        who, what = np.divmod(pair, max(1, len(kinds)))
        return np.bincount(owner, logs, n), who, kinds[what], times


class Model(NamedTuple):
    tokens: DataFrame  # token, everywhere, learned: its count among all and among training tokens
    n_tokens: int
    n_kinds: int
    frequent: pa.Table  # token, learned of the words that are frequent anywhere
    grams: DataFrame  # gram, everywhere, learned: its count among all and among training symbols
    short: tuple[np.ndarray, np.ndarray]  # all learned grams of two symbols, sorted, and their counts
    known: Costs  # grams that are frequent anywhere


def _segments(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(which text, part of it) in lists of about PIECE bytes; long texts are cut at white space."""
    out, held = [], 0
    for i, data in enumerate(texts):
        at = 0
        while True:
            end = at + PIECE
            while end < len(data) and data[end] not in BLANKS:
                end += 1
            part = data[at:end]
            out.append((i, part))
            held += len(part)
            if held >= PIECE:
                yield out
                out, held = [], 0
            at = end
            if at >= len(data):
                break
    if out:
        yield out


_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS, np.uint8))


def _words(parts: list[tuple[int, bytes]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the parts, and for each word in order which of these it is and whose text it is in."""
    data = b" ".join(p for _, p in parts)
    blank = np.r_[True, _BLANK[np.frombuffer(data, np.uint8)], True]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    begins = np.cumsum([0, *(len(p) + 1 for _, p in parts)])[:-1]
    owner = np.array([i for i, _ in parts], np.int64)[np.searchsorted(begins, starts, "right") - 1]
    offsets = np.r_[0, np.cumsum(ends - starts)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data.translate(None, BLANKS))])
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64), owner


def _counts(docs: DataFrame) -> DataFrame:
    """docs (text, learn) -> partial counts: token and gram (one of them null), everywhere, learned."""
    schema = pa.schema([("token", pa.binary()), ("gram", pa.int64()), ("everywhere", pa.int64()), ("learned", pa.int64())])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return code, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def symbols(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        # the lowest bit tells whether the gram was learned from
        return pa.RecordBatch.from_arrays([pa.nulls(len(code), pa.binary()), pa.array(code >> 1), pa.array(n), pa.array(n * (code & 1))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ends, learned_ends = [], 0, 0
        for batch in pieces(batches, most=2 << 20):
            texts = [utf8(t.as_py()).lower() for t in batch.column("text")]
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
            ends, learned_ends = ends + len(texts), learned_ends + int(learn.sum())
            found = []
            for group in _segments(texts):
                kinds, code, owner = _words(group)
                found.append(pa.table({"token": kinds, "everywhere": np.bincount(code, minlength=len(kinds)), "learned": np.bincount(code, learn[owner], len(kinds)).astype(np.int64)}))
            for part in pa.concat_tables(found).group_by("token").aggregate([("everywhere", "sum"), ("learned", "sum")]).to_batches():
                yield pa.RecordBatch.from_arrays([part.column("token"), pa.nulls(part.num_rows, pa.int64()), part.column("everywhere_sum"), part.column("learned_sum")], schema=schema)
            fresh, held = [], 0
            for data, use in zip(texts, learn.tolist(), strict=True):
                for code in grams(data):
                    fresh.append(code << 1 | use)
                    held += len(code)
                    if held >= PIECE:
                        parts.append(np.unique(np.concatenate(fresh), return_counts=True))
                        fresh, held = [], 0
            if fresh:
                parts.append(np.unique(np.concatenate(fresh), return_counts=True))
            if sum(len(c) for c, _ in parts) > 4 * HELD:
                parts = [merged(parts)]
                if len(parts[0][0]) > 2 * HELD:
                    yield symbols(*parts.pop())
        yield pa.RecordBatch.from_arrays([pa.array([STOP], pa.binary()), pa.nulls(1, pa.int64()), pa.array([ends]), pa.array([learned_ends])], schema=schema)
        if parts:
            yield symbols(*merged(parts))

    return spread(docs).mapInArrow(run, "token binary, gram long, everywhere long, learned long")


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(code, return_inverse=True)
    return kinds, np.bincount(at, n, len(kinds)).astype(np.int64)


def _costs(rows: DataFrame, short: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rows (gram, learned, asked), all learned grams among them, each once -> (gram, log) of those asked for.

    A task holds the grams of two context symbols at once: what it holds is bounded by the alphabet, not by the corpus.
    """
    shared = rows.sparkSession.sparkContext.broadcast(short)  # 257 * 258 grams at most

    def priced(code: np.ndarray, n: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
        seen = n > 0
        nodes = [_summed(shared.value[0] & _level(0), shared.value[1]), shared.value]
        nodes += [_summed(code[seen] & _level(k), n[seen]) for k in range(2, ORDER + 1)]
        trie = Trie(nodes, [_summed(c >> BITS, x) for c, x in nodes])
        return pa.RecordBatch.from_arrays([pa.array(code[asked]), pa.array(trie._cost(code[asked]))], ["gram", "log"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "learned", "asked")])
            size += batch.num_rows
            if size >= 4 * HELD:
                code, n, asked = map(np.concatenate, zip(*held, strict=True))
                pair = code >> BITS & _level(1)
                end = int(np.flatnonzero(pair != pair[-1])[-1]) + 1 if pair[0] != pair[-1] else 0  # the last pair may go on
                if end:
                    yield priced(code[:end], n[:end], asked[:end])
                held, size = [[code[end:], n[end:], asked[end:]]], len(code) - end
        if held:
            yield priced(*map(np.concatenate, zip(*held, strict=True)))

    pair = F.shiftright("gram", BITS).bitwiseAND(F.lit(_level(1)))
    return dealt(rows.withColumn("pair", pair), "pair").sortWithinPartitions("pair").mapInArrow(run, "gram long, log double")


def fit(docs: DataFrame, learn: Column) -> Model:
    """Counts of every document (text) and of those where learn is true, and the costs of frequent grams; null texts are empty ones."""
    partial = written(_counts(docs.select("text", F.coalesce(learn, F.lit(False)).alias("learn"))), "ppm-partial")
    tokens, full = (written(partial.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum("everywhere").alias("everywhere"), F.sum("learned").alias("learned")), f"ppm-{c}s") for c in ("token", "gram"))
    everywhere, n_tokens, n_kinds = tokens.agg(F.sum("everywhere"), F.coalesce(F.sum("learned"), F.lit(0)), F.count(F.when(F.col("learned") > 0, 1))).first()
    # at most 2**WORDS words have that share of all, together at most 2**WORDS times as long as the mean word
    frequent = tokens.where(F.col("everywhere") >= F.lit(-(-(everywhere or 0) // (1 << WORDS)))).select("token", "learned").toArrow()
    pairs = full.where(F.col("learned") > 0).groupBy(F.col("gram").bitwiseAND(F.lit(_level(1))).alias("code")).agg(F.sum("learned").alias("n")).toArrow()  # 257 * 258 at most
    short = _summed(pairs.column("code").to_numpy().astype(np.int64), pairs.column("n").to_numpy())
    # counts add up to the total, so at most 2**NODES grams have that share
    total = full.agg(F.sum("everywhere")).first()[0] or 0
    known = _costs(full.select("gram", "learned", (F.col("everywhere") >= F.lit(-(-total // (1 << NODES)))).alias("asked")), short).toArrow()
    return Model(tokens, n_tokens, n_kinds, frequent, full, short, Costs(known.column("gram").to_numpy(), known.column("log").to_numpy()))


def _base(count: Column | np.ndarray, model: Model) -> Column | np.ndarray:
    """log10 of a token's smoothed unigram probability."""
    whole = model.n_tokens + DISCOUNT * (model.n_kinds + 1)
    return F.log10((count + DISCOUNT) / whole) if isinstance(count, Column) else np.log10((count + DISCOUNT) / whole)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (text, ...) -> its columns and n_tokens, n_known, train_tokens, base_score, score; columns of these names are replaced.

    keep: the columns of docs that are carried along (they are written on the way), all unless given.
    Null and empty texts are scored as a text's end alone. Very long texts are scored whole, piece by piece. Equal
    texts get equal scores, but for the order of additions; an empty table gives an empty one. A model of no
    documents gives every symbol 1/257.
    """
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "_row", "_token", "_gram", "_times", "_known", "_base", "_more_known", "_more_base", "_more_score")
    docs = docs.drop(*added)
    learned = model.frequent.column("learned").to_numpy().astype(np.float64)
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.frequent.column("token").combine_chunks(), learned > 0, _base(learned, model)))  # bounds as in fit
    names = [c for c in docs.columns if keep is None or c in keep]
    out = StructType([StructField(f.name, f.dataType) for f in docs.schema if f.name in names])
    for name, kind in (("_row", "long"), ("n_tokens", "long"), ("_known", "long"), ("_base", "double"), ("score", "double"), ("_token", "binary"), ("_gram", "long"), ("_times", "long")):
        out = out.add(name, kind)

    def rare(batch: pa.RecordBatch, row: np.ndarray, times: np.ndarray, token: pa.Array | None = None, gram: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(row)
        return pa.RecordBatch.from_arrays([*(pa.nulls(n, batch.column(c).type) for c in names), pa.array(row), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.nulls(n, pa.binary()) if token is None else token, pa.nulls(n, pa.int64()) if gram is None else pa.array(gram), pa.array(times)], [*names, *out.names[len(names) :]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, frequent, seen, logs = shared.value
        first = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, most=2 << 20):
            texts = [utf8(t.as_py()).lower() for t in batch.column("text")]
            n = len(texts)
            total, known, base = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            ending = pa.array([STOP], pa.binary()), np.zeros(n, np.int64), np.arange(n)  # the end of every text
            for kinds, code, owner in chain(map(_words, _segments(texts)), [ending]):
                total += np.bincount(owner, minlength=n)
                at = pc.index_in(kinds, frequent).fill_null(-1).to_numpy().astype(np.int64)[code]
                often, row = at >= 0, owner[at >= 0]
                known += np.bincount(row, seen[at[often]], n)
                base += np.bincount(row, logs[at[often]], n)
                pair, times = np.unique(owner[~often] * len(kinds) + code[~often], return_counts=True)
                for a in range(0, len(pair), HELD):
                    r, w = np.divmod(pair[a : a + HELD], len(kinds))
                    yield rare(batch, first + r, times[a : a + HELD], token=kinds.take(pa.array(w)))
            total_log = np.zeros(n)
            for sums, who, code, times in costs.read(texts):
                total_log += sums
                for a in range(0, len(who), HELD):
                    yield rare(batch, first + who[a : a + HELD], times[a : a + HELD], gram=code[a : a + HELD])
            stats = (first + np.arange(n), total, known.astype(np.int64), base, total_log)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, stats), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], [*names, *out.names[len(names) :]])
            first += n

    # a row for every document, and one for each of its words and grams that are not frequent: such a word has less than one in
    # 2**WORDS rows of these, a gram less than one in 2**NODES
    rows = written(spread(docs).mapInArrow(run, out), "ppm-rows")
    words = rows.where(F.col("_token").isNotNull()).select("_row", F.col("_token").alias("token"), "_times").join(model.tokens.select("token", "learned"), "token")
    words = words.select("_row", F.when(F.col("learned") > 0, F.col("_times")).otherwise(0).alias("_more_known"), (F.col("_times") * _base(F.col("learned"), model)).alias("_more_base"), F.lit(0.0).alias("_more_score"))
    grams_of = rows.where(F.col("_gram").isNotNull()).select("_row", F.col("_gram").alias("gram"), "_times")
    both = model.grams.select("gram", "learned", F.lit(False).alias("asked")).unionByName(grams_of.select("gram", F.lit(0).cast("long").alias("learned"), F.lit(True).alias("asked")).distinct())
    costs = _costs(written(both.groupBy("gram").agg(F.max("learned").alias("learned"), F.max("asked").alias("asked")), "ppm-asked"), model.short)
    grams_of = grams_of.join(costs, "gram").select("_row", F.lit(0).cast("long").alias("_more_known"), F.lit(0.0).alias("_more_base"), (F.col("_times") * F.col("log")).alias("_more_score"))
    more = ("_more_known", "_more_base", "_more_score")
    sums = words.unionByName(grams_of).groupBy("_row").agg(*[F.sum(c).alias(c) for c in more])
    scored = rows.where(F.col("n_tokens").isNotNull()).join(sums, "_row", "left")
    return scored.select(*names, "n_tokens", (F.col("_known") + F.coalesce("_more_known", F.lit(0))).alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), (F.col("_base") + F.coalesce("_more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("_more_score", F.lit(0.0))).alias("score"))


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Both scores of every document, learned from those outside fold 0 of 10 of their ids; rows without an id are scored
    but not learned from, and not held out. Other awkward rows as in score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 10) == 0, F.lit(False))
    model = fit(docs, fold(F.col("doc_id"), 10) != 0)
    return score(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"]).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
