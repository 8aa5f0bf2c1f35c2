"""Exact top-k by inner product: columnar branch-and-bound.

Vectors lie in cells of bounded size by falling length, dimension by dimension. A block of queries meets a cell; scores grow one block
of dimensions at a time, and after each block only candidates stay whose score so far plus the most that the rest can
add (Cauchy-Schwarz on the remaining masses) reaches the k-th best score known.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from gridlore.llm.common import materialize

#: Candidates of a cell, queries of a block, dimensions of a step; blocks of queries that one task takes to a cell;
#: ranges of length.
CELL, QUERIES, STEP, BLOCKS, RANGES = 16384, 4096, 8, 16, 256


def finite(v: str) -> Column:
    """The vector is there, and so are all its components, none of them infinite or NaN."""
    x = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))
    return F.col(v).isNotNull() & F.forall(F.col(v), x)


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter ones are filled with zeros."""
    out = np.zeros((len(column), dim))
    i = 0
    for chunk in column.chunks:
        values, n = chunk.flatten().to_numpy(zero_copy_only=False), len(chunk)
        sizes = np.diff(chunk.offsets.to_numpy())
        if n and (sizes == dim).all():
            out[i : i + n] = values.reshape(n, dim)
        else:
            at = np.repeat(np.arange(n), sizes)
            out[i + at, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
        i += n
    return out


def widest(*columns: pa.ChunkedArray) -> int:
    return max([0, *(int(np.diff(c.offsets.to_numpy()).max()) for col in columns for c in col.chunks if len(c))])


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id and score of the k best of x for each row of q, the query's own id left out. Integers in doubles."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if top >= 2.0**53:
        return wide_search(ids, x, query_ids, q, k)
    order = np.argsort(-np.abs(x).sum(0), kind="stable")  # heavy dimensions first: bounds close early
    x, q = x[:, order], q[:, order]
    cols = np.ascontiguousarray(x.T)
    cuts = [*range(0, x.shape[1], STEP), x.shape[1]]
    x_rest = [np.sqrt((x[:, c:] ** 2).sum(1)) * (1 + 1e-9) for c in cuts[1:]]
    q_rest = [np.sqrt((q[:, c:] ** 2).sum(1)) * (1 + 1e-9) for c in cuts[1:]]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q), 64):
        first = q[lo : lo + 64, : cuts[1]] @ cols[: cuts[1]]
        for j in range(len(first)):
            i, part = lo + j, first[j]
            live = np.flatnonzero(ids != query_ids[i])
            if len(live) > k:
                part = part[live]
                seed = live[np.argpartition(-part, min(4 * k, len(live) - 1))[: 4 * k]]
                floor = np.partition(x[seed] @ q[i], len(seed) - k)[len(seed) - k]  # k rows reach it
                for b in range(len(cuts) - 1):
                    if b:
                        rows = slice(cuts[b], cuts[b + 1])
                        part += q[i, rows] @ cols[rows][:, live] if len(live) < 0.3 * len(ids) else (q[i, rows] @ cols[rows])[live]
                    keep = part + (q_rest[b][i] * x_rest[b][live] + 1e-6) >= floor
                    if not keep.all():
                        live, part = live[keep], part[keep]
            else:
                part = x[live] @ q[i]
            best = np.lexsort((ids[live], -part))[:k]
            out.append((live[best], part[best]))
    n = [len(a) for a, _ in out]
    at, score = (np.concatenate([o[z] for o in out]) if out else np.zeros(0) for z in (0, 1))
    return np.repeat(query_ids, n), ids[at.astype(np.int64)], np.rint(score).astype(np.int64)


def wide_search(ids, x, query_ids, q, k):
    """The same in whole numbers of any width, for components too large for doubles; scores past 64 bits are the largest
    or least number that fits, and equal then."""
    rows = [[int(v) for v in r] for r in x]
    out = []
    for qid, r in zip(query_ids.tolist(), q):
        r = [int(v) for v in r]
        scores = ((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(r, s)))), i) for i, s in zip(ids.tolist(), rows) if i != qid)
        out += [(qid, i, s) for s, i in heapq.nsmallest(k, scores, key=lambda p: (-p[0], p[1]))]
    cols = list(zip(*out)) or [(), (), ()]
    return tuple(np.array(c, dtype=np.int64) for c in cols)


def exact_topk(vectors: DataFrame, is_query: Column, k: int, cell: int = CELL, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query row's k best rows among all others of vectors (vec_id, embedding).

    Components are whole numbers. Rows with a null id take no part; nor do vectors that are null or hold null or
    non-finite components. A query's own are the rows of its id. Ties go to the smaller id; repeated rows stand for
    themselves as candidates and ask once as queries (of unlike vectors with one id, the least asks). Shorter vectors are
    filled with zeros. Scores past 64 bits stand at the largest or least number. Empty table: no rows.

    Cells are ranges of length, long vectors first. The first cell gives each query a floor, the k-th best score there;
    a query goes on to those cells alone whose longest vector can reach it, and within a cell bounds close dimension by
    dimension. Only queries are copied: a block of them meets a cell in one task.
    """
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & finite("embedding"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("length", length)
    n, n_q = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, ranges = max(1, -(-n_q // block)), min(RANGES, max(1, -(-n // cell)))
    cuts = rows.agg(F.percentile_approx("length", [float(1 - i / ranges) for i in range(1, ranges)] or [0.5], 10_000)).first()[0] if ranges > 1 else []
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(cuts or []))]).cast("array<double>")
    placed = rows.withColumn("range", F.size(F.filter(cuts, lambda c: c > F.col("length"))))
    held = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("most")).orderBy("range").collect()  # RANGES rows at most
    if not held:
        held = [Row(range=0, n=0, most=0.0)]
    # a range of many rows (of one length, say) is several cells, by hash
    parts = F.create_map(*[F.lit(x) for r in held for x in (r["range"], max(1, -(-r["n"] // (2 * cell))))])
    top = held[0]["range"]
    items = placed.select("vec_id", "embedding", "range", F.pmod(F.xxhash64("vec_id", "embedding"), parts[F.col("range")]).cast("int").alias("sub"))
    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    asked = asked.select("query_id", F.col("embedding").alias("query"), length.alias("length"), F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"))
    schema = "query_id long, vec_id long, score long"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if len(left) and len(right):
            dim = max(1, widest(left["embedding"], right["query"]))
            x, ids = matrix(left["embedding"], dim), left["vec_id"].to_numpy()
            some = []
            for i in range(0, len(right), block):  # blocks of queries, one after another
                own = right.slice(i, block)
                some.append(search(ids, x, own["query_id"].to_numpy(), matrix(own["query"], dim), k))
            found = [np.concatenate([f[j] for f in some]) for j in range(3)]
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    def over(some: DataFrame, asking: DataFrame) -> DataFrame:
        """Cells meet the queries that go to them; of very many queries, BLOCKS blocks in a task."""
        return some.groupBy("range", "sub", "part").cogroup(asking.groupBy("range", "sub", "part")).applyInArrow(meet, schema)

    part = F.floor(F.col("block") / BLOCKS).cast("int").alias("part")
    items = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // BLOCKS))))
    first = (F.col("range") == top) & (F.col("sub") == 0)
    best = over(items.where(first), asked.select("query_id", "query", F.lit(top).alias("range"), F.lit(0).alias("sub"), part))
    if n > cell:
        best = materialize(best, "topk-first")
        floor = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        reach = F.array_compact(F.array(*[F.when(F.col("floor").isNull() | (F.col("length") * F.lit(r["most"]) * (1 + 1e-9) + 1e-6 >= F.col("floor")), F.lit(r["range"])) for r in held]))
        more = asked.join(floor, "query_id", "left").select("query_id", "query", F.explode(reach).alias("range"), part)
        more = more.withColumn("sub", F.explode(F.sequence(F.lit(0), (parts[F.col("range")] - 1).cast("int"))))
        best = best.union(over(items.where(~first), more.where(~first)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").where(finite("embedding"))
    y = lambda x: F.lit(256.0) * x.cast("double")  # noqa: E731  doubles of 2^53 and over are whole
    return e.select("vec_id", F.transform("embedding", lambda x: F.when(F.abs(y(x)) < 2.0**53, F.floor(y(x)).cast("double")).otherwise(y(x))).alias("embedding"))


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    return exact_topk(quantised(spark, sf_dir), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
