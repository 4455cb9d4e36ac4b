"""Approximate nearest neighbours: inverted lists scanned by adaptive dimension blocks.

Vectors go to the nearest of k-means centres fitted on a bounded sample, for each dimension on its own. A query
visits the lists nearest to it: as many as the true nearest neighbours, among all rows, of a few sampled queries
need for the recall asked for. In a list, vectors and queries are rotated by one random orthogonal matrix, so the
first d of D coordinates hold about d / D of a squared distance. Column block by column block a test drops every
pair whose partial distance is already too large, beyond chance, for the query's tenth best so far: the first
block is one matrix product for many queries, later ones are measured for the pairs that are left. What survives
is measured exactly, in double precision on the original vectors. Long lists are cut in chunks and busy ones in
groups of queries, so a task holds bounded blocks of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.store import table, written

#: Vectors of a list, and queries, that meet in one group at most (about).
CHUNK, ASKED = 20_000, 4_000
#: Coordinates of a block, and how many standard deviations a partial distance may lie above its share.
STEP, DOUBT = 16, 3.0
#: Share of pairs left from which a block is one matrix product for all of them.
DENSE = 0.2
#: Pairs of a query and a vector whose partial distances are held at once.
PAIRS = 1 << 20


@dataclass
class Lists:
    """Centres and rotation of one dimension; lists are numbered from `first` on."""

    centres: np.ndarray
    rotation: np.ndarray
    first: int
    probes: int = 1

    @property
    def dim(self) -> int:
        return self.rotation.shape[0]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (self.centres**2).sum(1)[None] - 2 * x @ self.centres.T


#: The lists of every dimension.
Index = dict[int, Lists]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: no null, no null or non-finite component, not all zero."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0))


def fit_lists(vectors: DataFrame, lists: int | None = None, sample: int = 20_000, most_lists: int = 4096, rounds: int = 8, seed: int = 11) -> Index:
    """Centres for every dimension, from at most about `sample` vectors in all, by hash of their ids.

    lists of a dimension: half the root of its rows unless given. An empty table has an empty index. As many
    centres of a dimension as its share of the sample has different vectors, at most.
    """
    dims = [(r[0], r[1]) for r in vectors.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()]  # a row a dimension
    total, index, first = sum(n for _, n in dims), {}, 0
    if not dims:
        return index
    u = F.shiftrightunsigned(F.xxhash64("vec_id"), 34) / float(1 << 30)
    shares = [(d, min(1.0, max(sample * n / total, sample / 10 / len(dims)) / n)) for d, n in dims]
    plan = vectors.sparkSession.createDataFrame(shares, "d int, share double")
    drawn = vectors.join(F.broadcast(plan), F.size("embedding") == F.col("d")).where(u < F.col("share")).select("d", "vec_id", "embedding").limit(3 * sample).toArrow()
    held, owner = drawn.column("embedding").combine_chunks(), drawn.column("d").to_numpy()
    rng = np.random.default_rng(seed)
    for dim, rows in dims:
        x = held.filter(pa.array(owner == dim)).flatten().to_numpy().reshape(-1, dim)
        x = np.unique(x, axis=0) if len(x) else np.zeros((1, dim))
        centres = x[rng.permutation(len(x))[: min(most_lists, lists or max(1, int(np.sqrt(rows) / 2)))]]
        for _ in range(rounds):
            near = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
            order = near.argsort(kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
            filled = near[order][starts]
            centres = centres.copy()
            centres[filled] = np.add.reduceat(x[order], starts, axis=0) / np.bincount(near, minlength=len(centres))[filled, None]
        index[dim] = Lists(centres, np.linalg.qr(rng.standard_normal((dim, dim)))[0], first)
        first += len(centres)
    return index


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The dimensions in a batch, each with its row numbers and its vectors as a matrix."""
    column = batch.column("embedding")
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)[:-1]]
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, values[starts[rows][:, None] + np.arange(dim)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _share(b: int, dim: int, doubt: float) -> float:
    """The hypothesis test: of a squared distance, b of dim randomly rotated coordinates hold a share of Beta(b/2, (dim-b)/2);
    the share that is passed by chance only, `doubt` standard deviations above the mean."""
    return 1 + 1e-9 if b >= dim else min(1.0, b / dim + doubt * np.sqrt(2 * b * (dim - b) / (dim + 2)) / dim)


def nearest_in(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, rotation: np.ndarray, k: int, doubt: float = DOUBT) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The k nearest of x of every query, by adaptive scan: query ids, vector ids, distances, and how many pairs
    were left before each block and at the end. Own ids are left out; an id counts once, with its nearest vector."""
    dim, times = x.shape[1], int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1
    xr, qr, first = x @ rotation, q @ rotation, min(STEP, dim)
    lengths = (xr[:, :first] ** 2).sum(1)
    blocks = [(a, min(a + STEP, dim)) for a in range(first, dim, STEP)]
    pick, out, seen = min(k * times + times, len(ids)), [], [0] * (len(blocks) + 2)
    for at in range(0, len(asked), max(1, PAIRS // max(1, len(ids)))):
        who = slice(at, at + max(1, PAIRS // max(1, len(ids))))
        own, near = asked[who], (qr[who, :first] ** 2).sum(1)[:, None] + lengths[None] - 2 * qr[who, :first] @ xr[:, :first].T
        near[own[:, None] == ids[None]] = np.inf
        seen[0] += near.size
        # a bound for the k-th distance: the k least by the first block, measured whole
        some = np.argpartition(near, pick - 1, axis=1)[:, :pick]
        whole = ((x[some] - q[who][:, None]) ** 2).sum(2)
        whole[~np.isfinite(np.take_along_axis(near, some, 1))] = np.inf
        whole.sort(axis=1)
        # k different ids are among any k * times of them
        limit = whole[:, k * times - 1] if pick >= k * times else np.full(len(own), np.inf)
        bound = np.where(np.isfinite(limit), limit, np.finfo(float).max / 4)
        rows, columns = np.nonzero(near <= (bound * _share(first, dim, doubt) + 1e-12)[:, None])
        partial = near[rows, columns]
        for n, (a, b) in enumerate(blocks, 1):
            seen[n] += len(rows)
            if len(rows) > DENSE * near.size:
                part = (qr[who, a:b] ** 2).sum(1)[:, None] + (xr[:, a:b] ** 2).sum(1)[None] - 2 * qr[who, a:b] @ xr[:, a:b].T
                partial = partial + part[rows, columns]
            else:
                partial = partial + ((xr[columns, a:b] - qr[who][rows, a:b]) ** 2).sum(1)
            stay = partial <= (bound * _share(b, dim, doubt) + 1e-12)[rows]
            rows, columns, partial = rows[stay], columns[stay], partial[stay]
        seen[-1] += len(rows)
        far = np.sqrt(((x[columns] - q[who][rows]) ** 2).sum(1))
        order = np.lexsort((ids[columns], far, rows))
        rows, found, far = rows[order], ids[columns[order]], far[order]
        if times > 1:
            once = np.sort(np.unique(np.stack([rows, found]), axis=1, return_index=True)[1])
            rows, found, far = rows[once], found[once], far[once]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        out.append((own[rows[rank < k]], found[rank < k], far[rank < k]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), seen
    return *(np.concatenate(c) for c in zip(*out, strict=True)), seen


def _placed(vectors: DataFrame, index: Index) -> DataFrame:
    """vectors with the number of the list of their nearest centre; those of a dimension without lists left out."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # at most most_lists centres a dimension

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = np.full(batch.num_rows, -1, np.int32)
            for dim, rows, x in _by_dim(batch):
                if dim in shared.value:
                    lists[rows] = shared.value[dim].first + shared.value[dim].distances(x).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists)], [*batch.schema.names, "list"])

    return vectors.select("vec_id", "embedding").mapInArrow(assign, "vec_id long, embedding array<double>, list int").where("list >= 0")


def calibrate(placed: DataFrame, index: Index, k: int = 10, recall: float = 0.97, asked: int = 300) -> Index:
    """The index with the number of lists to visit: so many that the k nearest of about `asked` vectors a dimension, found by
    brute force among all rows of placed (vec_id, embedding, list), lie in them with that probability."""
    ids, u = {}, F.xxhash64("vec_id", F.lit(7))
    for dim, own in index.items():
        drawn = placed.where(F.col("list").between(own.first, own.first + len(own.centres) - 1)).orderBy(u, "vec_id").select("vec_id", "embedding").limit(asked).toArrow()
        if drawn.num_rows:
            ids[dim] = drawn.column("vec_id").to_numpy(), _matrix(drawn.column("embedding"))
    shared = placed.sparkSession.sparkContext.broadcast(ids)  # `asked` vectors a dimension

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            at, vec = batch.column("list").to_numpy(), batch.column("vec_id").to_numpy()
            for dim, rows, x in _by_dim(batch):
                if dim not in shared.value:
                    continue
                own, q = shared.value[dim]
                far = (x**2).sum(1)[None] - 2 * q @ x.T
                far[own[:, None] == vec[rows][None]] = np.inf
                lists = np.broadcast_to(at[rows], far.shape)
                if dim in best:
                    far, lists = np.c_[best[dim][0], far], np.c_[best[dim][1], lists]
                pick = np.argpartition(far, min(k, far.shape[1]) - 1, axis=1)[:, :k]
                best[dim] = np.take_along_axis(far, pick, 1), np.take_along_axis(lists, pick, 1)
        for dim, (far, lists) in best.items():
            who = np.repeat(np.arange(len(far)), far.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(far.size, dim, np.int32)), pa.array(who.astype(np.int32)), pa.array(far.ravel()), pa.array(lists.ravel().astype(np.int32))], ["dim", "who", "far", "list"])

    found = placed.mapInArrow(nearest, "dim int, who int, far double, list int").where("far < double('inf')")
    first = F.row_number().over(Window.partitionBy("dim", "who").orderBy("far", "list"))
    met: dict[int, list] = {}
    for r in found.withColumn("n", first).where(F.col("n") <= k).select("dim", "who", "list").collect():  # k rows a sampled vector
        met.setdefault(r["dim"], []).append((r["who"], r["list"]))
    for dim, pairs in met.items():
        own = index[dim]
        near = own.distances(ids[dim][1]).argsort(1, kind="stable").argsort(1, kind="stable")
        who, lists = np.array(pairs).T
        own.probes = int(np.quantile(near[who, lists - own.first], recall, method="higher")) + 1
    return index


def search(vectors: DataFrame, queries: DataFrame, index: Index, k: int = 10, probes: int | None = None, least: int = 40, doubt: float = DOUBT, recall: float = 0.97) -> DataFrame:
    """vectors and queries (vec_id, embedding), as usable() gives them -> query_id, rank, vec_id, score.

    The k nearest found among the vectors of the query's dimension, nearest first, ties to the smaller vec_id; a
    query's own id is no candidate. It visits the `probes` nearest lists (calibrated for the recall unless given) and
    further ones until they hold least * k vectors, so small tables are searched whole. Repeated rows of an id count
    once, with the vector nearest to the query (of a query's own rows, the least vector is asked). A dimension that
    the index doesn't know takes no part; an empty table gives an empty result.
    """
    spark, empty = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    if not index:
        return spark.createDataFrame([], empty)
    placed = written(_placed(vectors, index), "ann-lists")
    if probes is None:
        index = calibrate(placed, index, k, recall)
    shared = spark.sparkContext.broadcast(index)  # at most most_lists centres a dimension
    sizes = np.zeros(sum(len(x.centres) for x in index.values()), np.int64)
    for at, n in placed.groupBy("list").count().collect():  # a row a list
        sizes[at] = n

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list = [[]] * batch.num_rows
            for dim, rows, x in _by_dim(batch):
                if (own := shared.value.get(dim)) is None:
                    continue
                held = sizes[own.first : own.first + len(own.centres)]
                near = own.distances(x).argsort(1, kind="stable")
                upto = np.maximum(probes or own.probes, (np.cumsum(held[near], 1) < least * k).sum(1) + 1)
                for r, row, n in zip(rows.tolist(), near, upto.tolist(), strict=True):
                    lists[r] = (own.first + row[:n][held[row[:n]] > 0]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "lists"])

    asked = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = written(asked.mapInArrow(visit, "vec_id long, embedding array<double>, lists array<int>"), "ann-asked")
    busy = np.zeros(len(sizes), np.int64)
    for at, n in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect():
        busy[at] = n
    parts, groups = np.maximum(1, -(-sizes // CHUNK)), np.maximum(1, -(-busy // ASKED))
    plan = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(sizes), dtype=np.int32), "parts": parts.astype(np.int32), "groups": groups.astype(np.int32)}), "list int, parts int, groups int")  # a row a list
    salt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(F.broadcast(plan), "list").withColumn("part", salt("parts")).select("list", "part", upto("groups").alias("of"), "vec_id", "embedding")
    right = asked.select("vec_id", "embedding", F.explode("lists").alias("list")).join(F.broadcast(plan), "list").withColumn("of", salt("groups")).select("list", upto("parts").alias("part"), "of", "vec_id", "embedding")

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        own, ids, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if x.num_rows and q.num_rows:
            at = _matrix(x.column("embedding"))
            own, ids, far, _ = nearest_in(x.column("vec_id").to_numpy(), at, q.column("vec_id").to_numpy(), _matrix(q.column("embedding")), shared.value[at.shape[1]].rotation, k, doubt)
        return pa.table({"query_id": own, "vec_id": ids, "score": far})

    keys = ["list", "part", "of"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    ranked = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all vectors; awkward rows as in usable and search."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("vec_id % 100 = 0"), fit_lists(vectors))
