"""Sharding by histogram sort: splitters are refined from exact byte counts until they meet a tolerance.

Rows are ordered by a 63-bit key, the upper 40 bits from the text and the lower 23 from the document id, and then
by a number of their own, so equal texts lie together and a hot text or a hot row can still be cut. Each round
counts, over all partitions, the exact bytes below candidate boundaries inside the intervals that still hold a
splitter; only these counts (at most shards * 2**bits rows a round) reach the driver. Then the rows are exchanged
once, for the slots.
Native: DataFrame functions only.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.store import table, written

KEY_BITS = 63
DOC_BITS = 23


def order_key(text: Column, doc_id: Column) -> Column:
    upper = F.shiftrightunsigned(F.xxhash64(text), 64 - (KEY_BITS - DOC_BITS))
    lower = F.shiftrightunsigned(F.xxhash64(doc_id, text), 64 - DOC_BITS)
    return F.shiftleft(upper, DOC_BITS).bitwiseOR(lower)


def _bin(step: int) -> Column:
    """Upper bits of (key, row) down to bit `step`, beside the key where the row's bits are asked for."""
    if step >= KEY_BITS:
        return F.struct(F.shiftrightunsigned("key", step - KEY_BITS).alias("b"), F.lit(0).cast("long").alias("r"))
    return F.struct(F.col("key").alias("b"), F.shiftrightunsigned("row", step).alias("r"))


def _inside(starts: list[int], left: int) -> Column:
    """Rows of the intervals of width 2**left that begin at these (key, row)."""
    if left >= KEY_BITS:
        return F.shiftrightunsigned("key", left - KEY_BITS).isin([s >> left for s in starts])
    return reduce(Column.__or__, [(F.col("key") == (s >> KEY_BITS)) & (F.shiftrightunsigned("row", left) == (s % (1 << KEY_BITS) >> left)) for s in starts])


def find_splitters(rows: DataFrame, shards: int, tolerance: float = 0.002, bits: int = 12) -> list[int]:
    """rows (key, size, row) -> shards - 1 boundaries, ascending; a row goes to the shard bisect_right(boundaries, key << 63 | row).

    row: numbers below 2**63 that tell rows of one key apart; without the column, rows of one key stay together and boundaries are keys.
    tolerance: allowed distance of each boundary's exact bytes from its aim, as a share of a mean shard.
    Where one row (or one key) weighs more than that, the boundary next to it that is nearer the aim is taken.
    """
    end = 0 if "row" in rows.columns else KEY_BITS
    total = rows.agg(F.sum("size")).first()[0] or 0
    aims = [total * (i + 1) / shards for i in range(shards - 1)]
    slack = tolerance * total / shards
    found: dict[int, int] = {}
    open_ = {0: (0, list(range(shards - 1)))}  # start of an interval of width 2**left -> (bytes below it, splitters in it)
    left = 2 * KEY_BITS
    while open_:
        step = max(KEY_BITS if left > KEY_BITS else end, left - bits)
        counted = rows if left == 2 * KEY_BITS else rows.where(_inside(list(open_), left))
        bins: dict[int, list[tuple[int, int]]] = {}
        for (b, r), size in counted.groupBy(_bin(step).alias("bin")).agg(F.sum("size")).collect():
            start = b << step if step >= KEY_BITS else b << KEY_BITS | r << step
            bins.setdefault(start >> left, []).append((start, size))
        after: dict[int, tuple[int, list[int]]] = {}
        for start, (below, splitters) in open_.items():
            own = sorted(bins.get(start >> left, []))
            sums = [below, *accumulate((size for _, size in own), initial=below)][1:]
            for i in splitters:
                at = min(max(bisect_right(sums, aims[i]) - 1, 0), max(0, len(own) - 1))
                if not own:
                    found[i] = start
                    continue
                low, high = sums[at], sums[at + 1]
                near, bound = min((abs(low - aims[i]), own[at][0]), (abs(high - aims[i]), own[at][0] + (1 << step)))
                if near <= slack or step == end:
                    found[i] = bound
                else:
                    after.setdefault(own[at][0], (low, []))[1].append(i)
        open_, left = after, step
    return [found[i] >> end for i in range(shards - 1)]


def _chosen(bounds: list[int], low: int = 0) -> Column:
    """The number of boundaries at or below (key, row), as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    key, row = divmod(min(bounds[mid], (1 << 2 * KEY_BITS) - 1), 1 << KEY_BITS)
    before = (F.col("key") < F.lit(key).cast("long")) | ((F.col("key") == F.lit(key).cast("long")) & (F.col("row") < F.lit(row).cast("long")))
    return F.when(before, _chosen(bounds[:mid], low)).otherwise(_chosen(bounds[mid + 1 :], low + mid + 1))


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, lanes: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> its columns and shard_size, text_crc32, shard, slot (law: bytes).

    Sizes are UTF-8 bytes of the text plus 8 (null text: 8). Slots run gapless from 0 in each shard. Null
    ids and texts, empty texts and empty tables are sharded like any other. Repeated rows are told apart by a number
    that each row gets when the columns are written, so shards are cut between them as between other rows. Columns of
    the input that carry one of the new names are replaced. keep: the columns carried along (they are written on the way), all unless given.
    lanes: parts of a shard that number their rows side by side; one for every 200,000 rows of a mean shard, at
    least 64, unless given.
    """
    own = ("shard_size", "text_crc32", "shard", "slot", "key", "row", "lane", "base")
    docs = docs.drop(*own)
    carried = [c for c in docs.columns if keep is None or c in keep]
    keyed = docs.select(*carried, (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("shard_size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), order_key(F.col("text"), F.col("doc_id")).alias("key"))
    # the number is fixed by being written: whatever task reads the row again finds the same one
    keyed = written(keyed.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    narrow = keyed.select("key", "row", F.col("shard_size").alias("size"))
    bounds = find_splitters(narrow, shards, tolerance)
    lanes = lanes or max(64, -(-narrow.count() // (200_000 * shards)))
    placed = keyed.withColumn("shard", _chosen(bounds)).withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int"))
    counts = placed.groupBy("shard", "lane").count().collect()
    first: dict[tuple[int, int], int] = {}
    for s in range(shards):
        at = 0
        for _, b, n in sorted(x for x in counts if x[0] == s):
            first[s, b] = at
            at += n
    base = docs.sparkSession.createDataFrame([(s, b, n) for (s, b), n in first.items()] or [(0, 0, 0)], "shard int, lane int, base long")
    ranked = placed.withColumn("slot", F.row_number().over(Window.partitionBy("shard", "lane").orderBy("key", "row")) - 1)
    # base: at most shards * lanes rows, one for 200,000 documents beyond the least
    return ranked.join(F.broadcast(base), ["shard", "lane"]).select(*carried, "shard_size", "text_crc32", "shard", (F.col("slot") + F.col("base")).cast("long").alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes; awkward rows as in shard_documents."""
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).select("doc_id", F.col("shard_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
