"""SentencePiece encoding and decoding by batched Viterbi over numpy arrays.

Words that are not cached advance together with all others of their length. Hashes of their substrings come
from prefix hashes and are probed in the sorted keys of the vocabulary; at each position the maximum over the
pieces that end there is taken for all words at once and kept as a backpointer.

A unigram model sums piece scores. A BPE model's encoding is not the best sum, but it is a best path too: a
sequence of pieces is the encoding exactly where each neighbouring pair is (the pair's own encoding is that
pair), so a step to a piece counts only where it fits the last piece of the path it extends. Whether two pieces
fit is settled once a pair, by replaying the merges inside both, and kept.

Words end before a space mark that follows another character, which no piece may cross (checked on loading). A
very long word of a BPE model is cut into overlapping chunks that advance together; two neighbours are joined at
a place where both have a seam and the pieces beside it fit, which by the above makes the whole the encoding.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from attesta.llm.arrow import pieces as cut
from attesta.store import spread, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Types of pieces in the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words kept with their ids, in two halves: when the newer is full the older is dropped, but for what is met again.
CACHED = 400_000
#: Words of one length that advance together.
TOGETHER = 4096
#: Words longer than LONG are cut: a chunk begins every STRIDE characters (a multiple of common periods, so that
#: repeated patterns keep step) and ends OVERLAP behind the next one's beginning.
LONG, STRIDE, OVERLAP = 1024, 720, 64
#: Bits of the table of pairs of pieces kept with whether they fit.
PAIR_BITS = 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + n]
            at += n


class Pieces:
    """A vocabulary with what encoding and decoding need; made from the bytes of a model file."""

    def __init__(self, model: bytes):
        self.model = model
        self.kind, self.prefix = UNIGRAM, True
        names, scores, types, norm = [], [], [], {}
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                names.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                types.append(own.get(3, NORMAL))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                norm = dict(_fields(value))
        self.prefix = bool(norm.get(3, 1))
        if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("only models without normalisation rules are supported")
        if self.kind not in (UNIGRAM, BPE) or USER_DEFINED in types or UNUSED in types:
            raise ValueError("only unigram and BPE models without user-defined or unused pieces are supported")
        self.names, self.size = names, len(names)
        self.score = {p: s for p, s, t in zip(names, scores, types, strict=True) if t == NORMAL}
        self.ids = {p: i for i, (p, t) in enumerate(zip(names, types, strict=True)) if t == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses the start of a word")
        self.unknown = types.index(UNKNOWN)
        by_byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(names, types, strict=True)) if t == BYTE}
        self.bytes = [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None
        text_of = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}
        self.text = [text_of[t](p) for p, t in zip(names, types, strict=True)]
        # pieces that can come out: of BPE only those that their own characters merge to
        self.history = {p: self._merges(p) for p in self.ids} if self.kind == BPE else {}
        usable = [p for p in self.ids if self.kind == UNIGRAM or self.history[p] is not None]
        self.longest = max(map(len, usable), default=1)
        keys = np.array([self._hash(p) for p in usable], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if len(np.unique(self.keys)) != len(usable):
            raise ValueError("two pieces share a hash")
        self.key_ids = np.array([self.ids[p] for p in usable], np.int64)[order]
        low = min(self.score.values(), default=0.0)
        self.weights = np.array([self.score.get(p, 0.0) for p in names] + [low - 10.0])
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys >> np.uint64(44)] = True
        self.pair_keys, self.pair_fits = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __reduce__(self):
        return Pieces, (self.model,)

    # hashes

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def _probe(self, points: np.ndarray) -> list[np.ndarray]:
        """points: code points, a column a word. For each length n, ids of the substrings of n at each start, or -1."""
        width, rows = points.shape
        sums = np.zeros((width + 1, rows), np.uint64)
        for i in range(width):
            sums[i + 1] = sums[i] * _BASE + points[i] + np.uint64(1)
        found, power = [], 1
        for n in range(1, min(width, self.longest) + 1):
            power = power * int(_BASE) & (2**64 - 1)
            h = sums[n:] - sums[:-n] * np.uint64(power)
            ids = np.full(h.shape, -1)
            some = self.seen[h >> np.uint64(44)]  # few substrings get as far as the search
            h = h[some]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            ids[some] = np.where(self.keys[at] == h, self.key_ids[at], -1)
            found.append(ids)
        return found

    # pairs of BPE pieces

    def _merges(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """The merges that make a piece from its characters: priorities, and its first and last part before each
        of them and at the end. None if they end in something else."""
        parts, order, first, last = list(piece), [], [piece[0]], [piece[-1]]
        while len(parts) > 1:
            best, at = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == -np.inf:
                return None
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            order.append(-best)
            first.append(parts[0])
            last.append(parts[-1])
        return order, first, last

    def fits(self, left: int, right: int) -> bool:
        """Whether encoding the two pieces' text gives these two pieces: no merge crosses the seam at any time."""
        a, _, ends = self.history[self.names[left]]
        b, starts, _ = self.history[self.names[right]]
        i = j = 0
        while True:
            x, y = a[i] if i < len(a) else np.inf, b[j] if j < len(b) else np.inf
            across = -self.score.get(ends[i] + starts[j], -np.inf)
            if across < x and across <= y:
                return False
            if x == y == np.inf:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * (self.size + 1) + right
        slot = ((keys.astype(np.uint64) * _BASE) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_fits[slot]
        missing = np.flatnonzero(self.pair_keys[slot] != keys)
        if len(missing):
            new, first, at = np.unique(keys[missing], return_index=True, return_inverse=True)
            fits = np.array([a == self.size or b == self.size or self.fits(a, b) for a, b in (divmod(k, self.size + 1) for k in new.tolist())])
            out[missing] = fits[at]
            place = slot[missing[first]]
            self.pair_keys[place], self.pair_fits[place] = new, fits
        return out

    # encoding

    def _best(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each end position and word: the id of the best path's last piece (size: unknown character) and its length."""
        width, rows = points.shape
        found = self._probe(points)
        found[0] = np.where(found[0] < 0, self.size, found[0])
        last, back = np.full((width + 1, rows), -1), np.zeros((width + 1, rows), np.int64)
        total = np.full((width + 1, rows), -np.inf)
        total[0] = 0.0
        for i in range(1, width + 1):
            for n in range(1, min(i, self.longest) + 1):
                ids = found[n - 1][i - n]
                who = np.flatnonzero((ids >= 0) & (total[i - n] > -np.inf))
                if not len(who):
                    continue
                ids = ids[who]
                if self.kind == BPE:
                    if i > n:
                        ok = self._fit(last[i - n, who], ids)
                        who, ids = who[ok], ids[ok]
                    score = np.zeros(len(who))
                else:
                    score = total[i - n, who] + self.weights[ids]
                better = score > total[i, who]
                who, ids = who[better], ids[better]
                total[i, who], last[i, who], back[i, who] = score[better], ids, n
        return last, back

    def _paths(self, last: np.ndarray, back: np.ndarray, words: list[str], spell: bool = True) -> list[bytes]:
        """The ids along the backpointers, all words walking back together; unknown characters as `size` unless spelled."""
        width, rows = last.shape[0] - 1, np.arange(len(words))
        ids, count, at = np.zeros((len(words), width), "<i4"), np.zeros(len(words), np.int64), np.full(len(words), width)
        odd = np.zeros(len(words), bool)
        for step in range(1, width + 1):
            own = last[at, rows]
            ids[rows, width - step] = own
            odd[rows] |= own == self.size
            count[rows] = step
            at = at - back[at, rows]
            if not at.all():
                rows, at = rows[at > 0], at[at > 0]
                if not len(rows):
                    break
        flat, row = ids.tobytes(), 4 * width
        out = [flat[(r + 1) * row - 4 * n : (r + 1) * row] for r, n in enumerate(count.tolist())]
        for r in np.flatnonzero(odd & spell).tolist():
            out[r] = self._spelled(ids[r, width - count[r] :].tolist(), words[r])
        return out

    def _spelled(self, ids: list[int], word: str) -> bytes:
        """Unknown characters as bytes, or a run of them as one unknown piece."""
        out, at = [], 0
        for k in ids:
            if k < self.size:
                out.append(k)
                at += len(self.names[k])
                continue
            if self.bytes is not None:
                out += [self.bytes[b] for b in word[at].encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at += 1
        return np.array(out, "<i4").tobytes()

    def _learn(self, words: list[str], into: dict[str, bytes], spell: bool = True) -> None:
        """Put the ids of these words (with their leading space mark) into a cache."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for width, same in by_length.items():
            step = max(1, TOGETHER // (1 + width // 32))
            for start in range(0, len(same), step):
                group = same[start : start + step]
                points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(group), width).T.astype(np.uint64)
                into.update(zip(group, self._paths(*self._best(points), group, spell), strict=True))

    def _long(self, word: str) -> bytes:
        """The ids of a very long word, from chunks joined where neighbours agree on a seam."""
        starts = list(range(0, len(word) - OVERLAP, STRIDE))
        ends = [*(s + OVERLAP for s in starts[1:]), len(word)]
        known: dict[str, bytes] = {}
        self._learn(list({word[a:b] for a, b in zip(starts, ends, strict=True)}), known, False)
        sizes = np.array([*map(len, self.names), 1])

        def cut(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            """The pieces of a part of the word, and where each ends."""
            if (part := word[a:b]) not in known:
                self._learn([part], known, False)
            ids = np.frombuffer(known[part], "<i4").astype(np.int64)
            return ids, a + np.cumsum(sizes[ids])

        joined, base, first, k = [], 0, 0, 1
        ids, to = cut(starts[0], ends[0])
        while k < len(starts):
            after, to_after = cut(starts[k], ends[k])
            seams, i, j = np.intersect1d(to[:-1], to_after[:-1], assume_unique=True, return_indices=True)
            fit = np.flatnonzero(self._fit(ids[i], after[j + 1])) if len(seams) else seams
            if len(fit):
                at = fit[np.abs(seams[fit] - starts[k] - OVERLAP // 2).argmin()]
                joined.append(ids[: i[at] + 1])
                ids, to, base, first = after[j[at] + 1 :], to_after[j[at] + 1 :], int(seams[at]), k
                k += 1
                continue
            # no seam: this and as many chunks more as lie behind the last one are encoded as one
            k = min(len(starts), 2 * k - first + 1)
            ids, to = cut(base, ends[k - 1])
            while joined and not self._fit(joined[-1][-1:], ids[:1])[0]:
                base -= int(sizes[joined.pop()].sum())
                ids, to = cut(base, ends[k - 1])
        whole = np.concatenate([*joined, ids])
        return self._spelled(whole.tolist(), word) if (whole == self.size).any() else whole.astype("<i4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers; none for a null or empty text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        split = []
        for text in texts:
            if not text:
                split.append([])
                continue
            whole = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
            if SPACE * 2 in whole or whole[-1] == SPACE or not self.prefix:
                split.append(_WORDS.findall(whole))
            else:
                split.append([SPACE + w for w in whole[1:].split(SPACE)])
        if len(self.words) > CACHED // 2:
            self.older, self.words = self.words, {}
        new = []
        for w in {w for words in split for w in words}.difference(self.words):
            if (ids := self.older.get(w)) is not None:
                self.words[w] = ids
            else:
                new.append(w)
        long = {w: b"" for w in new if len(w) > LONG and self.kind == BPE}
        self._learn([w for w in new if w not in long], self.words)
        get = self.words.__getitem__
        if long:  # not cached: they may be as large as a text
            for w in long:
                long[w] = self._long(w)
            get = lambda w: long[w] if w in long else self.words[w]
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return (text[1:] if self.prefix and text.startswith(b" ") else text).decode("utf-8", "replace")


def load(path: str = MODEL) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


def _listed(encoded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in encoded)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode_documents(docs: DataFrame, model: Pieces) -> DataFrame:
    """docs (text, ...) -> its columns and token_ids array<int>, n_tokens, decoded_crc32, round_trip.

    Null and empty texts have no ids. decoded_crc32 is of the UTF-8 of the ids decoded again, round_trip whether
    that is the text itself (a text that holds the space mark itself comes back with a space, as the
    model's format has it). Columns of the input with one of the new names are replaced. Texts of any length, also
    without a space, are encoded whole; equal texts get equal ids; an empty table gives an empty one.
    """
    docs = docs.drop("token_ids", "n_tokens", "decoded_crc32", "round_trip")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in cut(batches, most=1 << 20):
            texts = batch.column("text").to_pylist()
            encoded = m.encode_all(texts)
            decoded = [m.decode(x) for x in encoded]
            crc = [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in decoded]
            same = [a == (b or "") for a, b in zip(decoded, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _listed(encoded), pa.array([len(x) // 4 for x in encoded], pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], [*batch.schema.names, "token_ids", "n_tokens", "decoded_crc32", "round_trip"])

    out = StructType([*docs.schema.fields]).add("token_ids", ArrayType(IntegerType())).add("n_tokens", LongType()).add("decoded_crc32", LongType()).add("round_trip", "boolean")
    return spread(docs).mapInArrow(run, out)


def decode_documents(rows: DataFrame, model: Pieces) -> DataFrame:
    """rows (token_ids array<int>, ...) -> its columns and text (null ids: null)."""
    rows = rows.drop("text")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else shared.value.decode(np.array(x, "<i4").tobytes()) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("text", StringType()))


def op1_sentencepiece(spark, sf_dir: str, path: str = MODEL) -> DataFrame:
    """Token ids of every whole document and their round trip; awkward rows as in encode_documents."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), load(path)).select("doc_id", "n_tokens", "token_ids", F.col("decoded_crc32"), "round_trip")
