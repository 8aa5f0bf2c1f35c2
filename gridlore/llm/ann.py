"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by a codebook of their own; a cell is a pair of centroids. A query walks the
pairs by summed nearness with a heap (multi-sequence) until it has seen its share of the rows, and the rows of the
visited cells are ranked again on the original vectors. Cells lie together in shards of bounded size: a small cell is
in one shard, a large one is split over several, so that no cell makes a task large.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.topk import finite, matrix, widest

#: Centroids of a half; rows that the codebooks are fitted on, at most (by hash order); rows of a shard; queries walked in a task.
CENTROIDS, SAMPLE, SHARD, ASKS = 256, 20_000, 8192, 128
#: A query visits cells until they hold this share of all rows. The given vectors are spread evenly over a sphere of 64
#: dimensions, where no index does with few; the README has recall by share.
VISIT = 0.33


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    k = min(k, len(x))
    c = x[np.sort(np.random.Generator(np.random.PCG64(seed)).choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        near = assign(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], 1) if x.shape[1] else np.zeros((k, 0))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(1) - 2 * (x @ c.T), axis=1) if len(x) else np.zeros(0, np.int64)


def walk(s1: np.ndarray, s2: np.ndarray, counts: list[int], enough: int, cap: int) -> tuple[list[int], float]:
    """Cells (a * len(s2) + b) by falling s1[a] + s2[b] until they hold enough rows, and the sum of the last; of a cell,
    cap rows count at most, so that one crowded cell doesn't use up a query's share. Empty cells are passed over."""
    o1, o2 = np.argsort(-s1, kind="stable"), np.argsort(-s2, kind="stable")
    a, b, w = (-s1[o1]).tolist(), (-s2[o2]).tolist(), len(s2)
    o1, o2 = (o1 * w).tolist(), o2.tolist()
    heap, out, seen, last = [(a[0] + b[0], 0, 0)], [], 0, 0.0
    while heap and seen < enough:
        last, i, j = heap[0]
        cell = o1[i] + o2[j]
        if counts[cell]:
            out.append(cell)
            seen += min(cap, counts[cell])
        if j + 1 < w:  # a row of the pairs goes on; the next row opens with its first
            heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out, -last


def rank(ids: np.ndarray, x: np.ndarray, cells: np.ndarray, query_ids: np.ndarray, q: np.ndarray, visited: np.ndarray, k: int):
    """The k best of x for each row of q, of the cells it visits; visited: queries x cells. Scores add from left to right."""
    out = []
    order = np.argsort(cells, kind="stable")
    ids, x, cells = ids[order], x[order], cells[order]
    cut = np.searchsorted(cells, np.arange(visited.shape[1] + 1)).tolist()
    for lo in range(0, len(q), 128):
        some = visited[lo : lo + 128]
        near = np.full((len(some), len(x)), -np.inf)
        for c in np.flatnonzero(some.any(0)).tolist():  # a query meets the rows of the cells that it visits
            asks = np.flatnonzero(some[:, c])
            near[asks, cut[c] : cut[c + 1]] = q[lo + asks] @ x[cut[c] : cut[c + 1]].T
        ok = some[:, cells] & (ids[None, :] != query_ids[lo : lo + 128, None])
        near[~ok] = -np.inf
        for j in range(len(near)):
            row, n = near[j], int(ok[j].sum())
            if not n:
                continue
            if n > k:
                kth = np.partition(row, len(row) - k)[len(row) - k]
                at = np.flatnonzero(row >= kth - 1e-9 * (1 + abs(kth)))
            else:
                at = np.flatnonzero(ok[j])
            score = np.cumsum(x[at] * q[lo + j], axis=1)[:, -1]
            best = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(best), query_ids[lo + j]), ids[at[best]], score[best]))
    return tuple(np.concatenate([o[z] for o in out]) if out else np.zeros(0, (np.int64, np.int64, float)[z]) for z in range(3))


def ann_topk(vectors: DataFrame, is_query: Column, k: int, visit: float = VISIT, centroids: int = CENTROIDS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score (inner product) of the k nearest found for each query row among all other rows.

    Rows with a null id take no part; nor do vectors that are null, zero, or hold null or non-finite components.
    Shorter vectors are filled with zeros. Ties go to the smaller id. Repeated rows stand for themselves as candidates
    and ask once as queries. Empty table: no rows. The codebooks are fitted on at most `sample` rows and every row
    is indexed; what is sent to all tasks (codebooks, cell counts) is bounded by `centroids`.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0))
    fit = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()["embedding"]
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(fit):
        return spark.createDataFrame([], schema)
    dim = max(1, rows.agg(F.max(F.size("embedding"))).first()[0])
    half, x = dim // 2, matrix(fit, dim)
    books = [kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)]
    width = len(books[1])

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(pa.chunked_array([b.column("embedding")]), dim)
            cell = assign(v[:, :half], books[0]) * width + assign(v[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(cell, pa.int32())], ["vec_id", "embedding", "cell"])

    items = rows.mapInArrow(cells_of, "vec_id long, embedding array<double>, cell int")
    counts = np.zeros(len(books[0]) * width, np.int64)
    for cell, n in items.groupBy("cell").count().collect():  # centroids^2 rows at most
        counts[cell] = n
    base, parts, at, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, SHARD
    for c in np.flatnonzero(counts):
        if counts[c] > SHARD:  # shards of its own
            parts[c] = -(-counts[c] // SHARD)
            at, base[c] = at + 1 + parts[c], at + 1
            room = SHARD
        else:
            if counts[c] > room:
                at, room = at + 1, SHARD
            base[c], room = at, room - counts[c]
    total = int(counts.sum())
    enough, cap = max(int(visit * total), 2 * k), max(2 * k, 8 * total // max(1, int((counts > 0).sum())))
    shards = spark.createDataFrame(pa.table({"cell": pa.array(np.flatnonzero(counts), pa.int32()), "base": base[counts > 0], "parts": parts[counts > 0]}))
    items = items.join(F.broadcast(shards), "cell").select("vec_id", "embedding", "cell", (F.col("base") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("shard"))
    lists = spark.sparkContext.broadcast((books, counts.tolist(), base, parts))  # centroids^2 numbers

    def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = lists.value[0]
        return v[:, :half] @ own[0].T, v[:, half:] @ own[1].T

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, counted, first, many = lists.value
        for b in batches:
            s1, s2 = halves(matrix(pa.chunked_array([b.column("embedding")]), dim))
            to, shard, floor = [], [], []
            for i in range(len(b)):
                cells, last = walk(s1[i], s2[i], counted, enough, cap)
                begin, n = first[cells], many[cells]
                own = np.unique(np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                to.append(np.full(len(own), i)), shard.append(own), floor.append(np.full(len(own), last))
            to, shard, floor = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (to, shard, floor))
            at = pa.array(to.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("embedding").take(at), pa.array(floor, pa.float64()), pa.array(shard, pa.int64())], ["vec_id", "embedding", "floor", "shard"])

    asks = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asks = asks.repartition(max(1, -(-rows.where(is_query).count() // ASKS))).mapInArrow(probe, "vec_id long, embedding array<double>, floor double, shard long")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(left) and len(right):
            own, cell = np.unique(left["cell"].to_numpy(), return_inverse=True)
            q = matrix(right["embedding"], dim)
            s1, s2 = halves(q)
            visited = s1[:, own // width] + s2[:, own % width] >= right["floor"].to_numpy()[:, None] - 1e-12
            found = rank(left["vec_id"].to_numpy(), matrix(left["embedding"], dim), cell, right["vec_id"].to_numpy(), q, visited, k)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    near = items.groupBy("shard").cogroup(asks.groupBy("shard")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann_multi_index(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann_topk(e, F.col("vec_id") % 20 == 0, 20)
