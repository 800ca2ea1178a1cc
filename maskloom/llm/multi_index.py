"""Approximate nearest neighbours by inner product with an inverted multi-index.

Both halves of a vector are quantised by their own centroids, so K + K centroids make K * K cells. A query
walks cells by falling sum of its two half products, with a heap over the two sorted lists, until the
cells hold a share of all entries; the entries found are ranked on original vectors in double precision.
The share is the least that finds enough of the sample's own neighbours. Equal vectors are one entry with their
least ids, of which more can never be among the best.

Queries travel to the shards of the index that they probe, each with one bit per cell of the shard. An entry
travels once, and once more for each further `CHUNK` queries that probe its shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.shared import written

#: Rows that centroids are fitted on, at most, and bounds of the centroids of a half (half the root of the entries).
SAMPLE = 20_000
LEAST_CENTROIDS = 40
MOST_CENTROIDS = 256
#: Recall that the share of entries to look at is fitted for, and the queries it is fitted on, at most.
RECALL = 0.95
FIT_QUERIES = 256
#: Entries and queries that one task compares.
SHARD = 8192
CHUNK = 8192
#: Queries that one task walks cells for.
WALKS = 256


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): rows that take part. Null ids, null or zero vectors, null or non-finite components do not.

    Vectors of another length than most (the shorter at a tie) have no inner product with the rest.
    """
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
        .filter(F.exists(v, lambda x: x != 0))
    )
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (most[0].n if most else 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def entries_of(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): distinct vectors with their `keep` least ids; each batch trims its own first."""

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = batch.column("vec_id").to_numpy(), _matrix(batch.column("v")) + 0.0
            raw = np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1] * 8))).ravel()
            _, first, group = np.unique(raw, return_index=True, return_inverse=True)
            order = np.lexsort((ids, group))
            ids, group = ids[order], group[order]
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])
            ids, group = ids[new], group[new]
            sizes = np.bincount(group, minlength=len(first))
            place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids, group = ids[place < keep], group[place < keep]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(first)))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("v").take(pa.array(first)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], ["v", "ids"]
            )

    least = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return rows.mapInArrow(trim, "v array<double>, ids array<long>").groupBy("v").agg(least.alias("ids"))


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spread rows; a centroid without rows stays where it is."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells (i * len(b) + j) by falling a[i] + b[j] until they hold `want` entries; empty ones are left out."""
    i_order, j_order = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    xs, ys = (-a[i_order]).tolist(), (-b[j_order]).tolist()
    heap, found, held, n = [(xs[0] + ys[0], 0, 0)], [], 0, len(ys)
    counts = counts.tolist()
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        cell = i_order[i] * n + j_order[j]
        if counts[cell]:
            found.append(cell)
            held += counts[cell]
        if j + 1 < n:
            heapq.heappush(heap, (xs[i] + ys[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(xs):
            heapq.heappush(heap, (xs[i + 1] + ys[0], i + 1, 0))
    return found


def fitted_share(x: np.ndarray, books: list[np.ndarray], k: int, recall: float = RECALL) -> float:
    """The least share of the rows of `x` that a walk has to hold to find `recall` of their k nearest, on evenly spread queries.

    More rows than the sample bring neighbours nearer, so that the share errs to the safe side for larger tables.
    """
    if len(x) < 2:
        return 1.0
    half = x.shape[1] // 2
    cells, cell, counts = np.unique(nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:], books[1]), return_inverse=True, return_counts=True)
    i, j = np.divmod(cells, len(books[1]))
    needed = []
    for q in np.linspace(0, len(x) - 1, min(FIT_QUERIES, len(x))).astype(int):
        order = np.argsort(-((books[0] @ x[q, :half])[i] + (books[1] @ x[q, half:])[j]), kind="stable")
        until = np.empty(len(cells), np.int64)
        until[order] = np.cumsum(counts[order])
        scores = x @ x[q]
        scores[q] = -np.inf
        needed.append(until[cell[best(scores, np.arange(len(x)), min(k, len(x) - 1))]])
    return float(np.quantile(np.concatenate(needed), recall, method="higher")) / len(x)


def best(scores: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller of `least`; -inf takes no part."""
    at = np.flatnonzero(scores > -np.inf)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((least[at], -scores[at]))][:k]


def search(vectors: DataFrame, every: int = 20, k: int = 20, share: float | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each usable row whose id `every` divides.

    Candidates are all usable rows but those with the query's own id. Rows that repeat id and vector count
    once. Cells are walked until they hold `share` of the entries (unset: fitted on the sample), and k others at least. Fewer candidates give fewer rows; no usable row gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, vec_id, embedding))
    entries = written(entries_of(rows, k + 1))
    n = entries.count()
    half_k = int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, round(n**0.5 / 2))))
    sample = entries.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
    x = np.array([r.v for r in sample], dtype=float) if sample else np.zeros((0, 0))
    half = x.shape[1] // 2
    books = [centroids(x[:, :half], half_k), centroids(x[:, half:], half_k)] if n else [np.zeros((1, 0))] * 2
    wide = len(books[1])

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v"))
                cell = nearest(m[:, :half], books[0]) * wide + nearest(m[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["v", "ids", "cell"])

    index = written(entries.mapInArrow(quantise, "v array<double>, ids array<long>, cell long"))
    counts = np.zeros(len(books[0]) * wide, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most MOST_CENTROIDS squared rows
        counts[r.cell] = r["count"]
    first = np.cumsum(counts) - counts  # cells in order, cut into shards of SHARD entries; a large cell spans several
    queries = rows.filter(F.col("vec_id") % every == 0).distinct()
    asked = written(queries.groupBy("v").agg(F.min("vec_id").alias("asked")))
    share = fitted_share(x, books, k) if share is None else share
    want = min(n, max(k + 1, int(np.ceil(share * n))))  # cells that hold too few others would lose neighbours

    def cells_of(shard: int) -> slice:
        """The cells of which a shard holds entries."""
        low = np.searchsorted(first + counts, shard * SHARD, side="right")
        return slice(int(low), int(np.searchsorted(first, (shard + 1) * SHARD)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, h = batch.column("cell").to_numpy(), batch.column("h").to_numpy()
            shard = (first[cell] + h % np.maximum(counts[cell], 1)) // SHARD
            yield pa.RecordBatch.from_arrays([pa.array(shard), *(batch.column(c) for c in ("cell", "v", "ids"))], ["shard", "cell", "v", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"))
            for r in range(batch.num_rows):
                found = np.array(walk(books[0] @ m[r, :half], books[1] @ m[r, half:], counts, want), np.int64)
                mark = np.zeros(len(counts), dtype=bool)
                mark[found] = True
                ends = np.zeros(-(-n // SHARD) + 1, np.int64)  # how many of the found cells start and end in each shard
                np.add.at(ends, first[found] // SHARD, 1)
                np.add.at(ends, (first[found] + counts[found] - 1) // SHARD + 1, -1)
                shards = np.flatnonzero(np.cumsum(ends))
                bits = [np.packbits(mark[cells_of(s)]).tobytes() for s in shards]
                at = pa.array(np.full(len(shards), r))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int64()), batch.column("asked").take(at), batch.column("v").take(at), pa.array(bits, pa.binary())], ["shard", "asked", "v", "cells"]
                )

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"asked": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            held = cells_of(left["shard"][0].as_py())
            e, which, ids = _matrix(left["v"]), left["cell"].to_numpy() - held.start, left["ids"].to_pylist()
            least = np.array([i[0] for i in ids])
            size = np.sqrt((e * e).sum(axis=1).max())
            q, asked = _matrix(right["v"]), right["asked"].to_pylist()
            for low in range(0, len(q), 128):
                some = q[low : low + 128]
                bits = np.frombuffer(b"".join(right["cells"].slice(low, 128).to_pylist()), np.uint8).reshape(len(some), -1)
                probed = np.unpackbits(bits, axis=1)[:, which].astype(bool)
                near = np.flatnonzero(probed.any(axis=0))
                scores = np.where(probed[:, near], some @ e[near].T, -np.inf)
                for i in range(len(some)):
                    at = np.flatnonzero(scores[i] > -np.inf)
                    if len(at) > k + 1:  # a product of matrices may differ in its last bits, so near ties stay in
                        edge = np.partition(scores[i, at], len(at) - k - 1)[len(at) - k - 1]
                        at = at[scores[i, at] >= edge - 1e-12 * size * np.sqrt((some[i] ** 2).sum())]
                    exact = (e[near[at]] * some[i]).sum(axis=1)
                    items = [(-exact[j], v) for j in best(exact, least[near[at]], k + 1) for v in ids[near[at[j]]]]
                    for s, v in heapq.nsmallest(k + 1, items):
                        out["asked"].append(asked[low + i])
                        out["vec_id"].append(v)
                        out["score"].append(-s)
        return pa.table([pa.array(out["asked"], pa.int64()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.float64())], list(out))

    placed = index.select("cell", "v", "ids", F.shiftrightunsigned(F.xxhash64("v", F.lit(1)), 1).alias("h")).mapInArrow(
        place, "shard long, cell long, v array<double>, ids array<long>"
    )
    tasks = max(1, -(-asked.count() // WALKS))  # a number of its own, since small rows with long walks would be put together again
    probes = written(asked.select("asked", "v").repartition(tasks, "asked").mapInArrow(probe, "shard long, asked long, v array<double>, cells binary"))
    chunks = written(probes.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    copies = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    left = placed.join(chunks, "shard").select("shard", copies.alias("chunk"), "cell", "v", "ids")
    right = probes.join(chunks, "shard").select("shard", F.expr("cast(pmod(xxhash64(asked), chunks) AS int)").alias("chunk"), "asked", "v", "cells")
    found = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInArrow(rerank, "asked long, vec_id long, score double")
    order = [F.desc("score"), F.col("vec_id")]
    top = found.withColumn("_r", F.row_number().over(Window.partitionBy("asked").orderBy(*order))).filter(F.col("_r") <= k + 1).drop("_r")
    answers = queries.join(asked, "v").select(F.col("vec_id").alias("query_id"), "asked").join(top, "asked").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
